"""The graph's tables as versioned snapshots in one folder.

A snapshot is a folder of Parquet tables; the file CURRENT names the one that readers
take.  A change writes a new snapshot beside the old one and then replaces CURRENT, so a
reader sees the whole of one version or the whole of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schema

TABLES = {
    "facts": schema.EXTRACTED,
    "active_file": schema.ACTIVE_FILE,
    "active_node": schema.ACTIVE_NODE,
    "edge": schema.EDGE,
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if self.version() is None:
            self.truncate()

    # Files through Hadoop, so that any store that Spark reads will do.

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """Name of the current snapshot."""
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def _publish(self, name: str) -> None:
        jvm, fs = self._fs()
        Path = jvm.org.apache.hadoop.fs.Path
        new = Path(f"{self.path}/CURRENT.{name}")
        out = fs.create(new, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, Path(f"{self.path}/CURRENT"), options)

    # Tables ----------------------------------------------------------------------------

    def relations(self) -> DataFrame:
        """(relation, columns) of the store's tables and views."""
        rows = [(n, ", ".join(k.names)) for n, k in TABLES.items()] + [("content_file", ", ".join(schema.CONTENT_FILE.names)), ("symbol", ", ".join(schema.SYMBOL.names))]
        return self.spark.createDataFrame(sorted(rows), "relation string, columns string")

    def schema_version(self) -> int:
        return schema.SCHEMA_VERSION

    def active_file_hash(self, path: str) -> bytes | None:
        """Stored content hash of a path that is not deleted."""
        row = self.files().filter(F.col("path") == path).select("content_hash").first()
        return None if row is None else bytes(row.content_hash)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{self.version()}/{table}")

    def write(self, **tables: DataFrame) -> str:
        """A new snapshot with these tables; tables not given are taken over."""
        name = uuid.uuid4().hex
        for table, kind in TABLES.items():
            df = tables[table] if table in tables else self.read(table)
            df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind)).write.parquet(f"{self.path}/{name}/{table}")
        self._publish(name)
        return name

    def truncate(self) -> None:
        self.write(**{t: self.spark.createDataFrame([], k) for t, k in TABLES.items()})

    # Views -----------------------------------------------------------------------------

    def files(self) -> DataFrame:
        return self.read("active_file").filter("not deleted")

    def nodes(self) -> DataFrame:
        """One row per node_id: files with equal content share their nodes, and the first
        path stands for them."""
        rows = self.read("active_node")
        columns = [c for c in rows.columns if c != "node_id"]
        return rows.groupBy("node_id").agg(F.min_by(F.struct(*columns), F.col("path")).alias("n")).select("node_id", "n.*")

    def edges(self) -> DataFrame:
        return self.read("edge")

    def symbols(self) -> DataFrame:
        return self.nodes().select("name", "kind", "node_id", "qname", "path")

    def content_files(self, parser_version: int) -> DataFrame:
        rows = self.read("facts").select("content_hash", "language", F.lit(parser_version).alias("parser_version"), "diagnostics")
        return rows.dropDuplicates(["content_hash"])
