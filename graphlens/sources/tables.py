"""The test tables seen as a code graph: vertices, edges, changes, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import runtime


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, path, kind, name, qname)"""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    # Regions and nations are fixed tables of 5 and 25 rows.
    place = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    geo = F.concat(F.lit("geo/"), F.col("r_name"))
    out = region.select(_id("region", "r_regionkey").alias("node_id"), geo.alias("path"), F.lit("class").alias("kind"), F.col("r_name").alias("name"), F.col("r_name").alias("qname"))
    out = out.unionByName(place.select(_id("nation", "n_nationkey").alias("node_id"), geo.alias("path"), F.lit("method").alias("kind"), F.col("n_name").alias("name"), F.concat("r_name", F.lit("::"), "n_name").alias("qname")))
    names = F.broadcast(nation.select(F.col("n_nationkey").alias("nk"), "n_name"))
    for table, p in (("supplier", "s"), ("customer", "c")):
        key = "suppkey" if p == "s" else "custkey"
        rows = read(spark, sf_dir, table).join(names, F.col(f"{p}_nationkey") == F.col("nk"))
        out = out.unionByName(rows.select(_id(table, f"{p}_{key}").alias("node_id"), F.concat(F.lit(f"{table}/"), F.col("n_name")).alias("path"), F.lit("function").alias("kind"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_name").alias("qname")))
    part = read(spark, sf_dir, "part")
    return out.unionByName(part.select(_id("part", "p_partkey").alias("node_id"), F.concat(F.lit("part/"), F.col("p_brand")).alias("path"), F.lit("constant").alias("kind"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("::"), "p_name").alias("qname")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_node_id, kind, target_node_id, provenance, confidence)"""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nation = read(spark, sf_dir, "nation")
    pair = lambda s, kind, t: (s.alias("source_node_id"), F.lit(kind).alias("kind"), t.alias("target_node_id"))
    trade = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    trade = trade.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    top = Window.partitionBy("s_nationkey").orderBy(F.col("n").desc(), "c_nationkey")
    out = trade.withColumn("r", F.row_number().over(top)).filter("r <= 2").select(*pair(_id("nation", "s_nationkey"), "calls", _id("nation", "c_nationkey")))
    out = out.unionByName(nation.select(*pair(_id("nation", "n_nationkey"), "inherits", _id("region", "n_regionkey"))))
    out = out.unionByName(supplier.select(*pair(_id("supplier", "s_suppkey"), "implements", _id("nation", "s_nationkey"))))
    out = out.unionByName(customer.select(*pair(_id("customer", "c_custkey"), "references", _id("nation", "c_nationkey"))))
    made = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    # The supplier with the most lines, of several the first: one pass, no sort.
    made = made.groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct(-F.col("n"), "l_suppkey")).alias("s"))
    out = out.unionByName(made.select(*pair(_id("part", "l_partkey"), "renders", _id("supplier", "s"))))
    part = read(spark, sf_dir, "part")
    out = out.unionByName(part.select(*pair(F.concat(F.lit("file:part/"), F.col("p_brand")), "imports", _id("part", "p_partkey"))))
    return out.withColumn("provenance", F.lit("parser_extract")).withColumn("confidence", F.lit(80))


_GRAPHS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges), indexed once a session: written as a snapshot that all queries
    read, as an index is built once and asked many times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = (runtime.written(vertices(spark, sf_dir), "vertices"), runtime.written(edges(spark, sf_dir), "edges"))
    return _GRAPHS[key]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, generation, kind, ts, seq) of the events table."""
    rows = read(spark, sf_dir, "events")
    return rows.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("generation"), F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("seq"))
