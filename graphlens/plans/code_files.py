"""Extraction, indexing and streaming over the test tables: each part becomes a source
file of each language, so that SQL can say what must be found in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import extract, index, runtime
from ..functions import text as T
from ..operators import changes as ops
from ..operators.resolve import Project
from ..sources.tables import changes, read

#: language -> (suffix, source, definitions (kind, name, qname), references (kind, name,
#: qname)).  `{k}` is the part's key, `{n}` the next one's.
FILES: dict[str, tuple[str, str, list[tuple[str, str, str]], list[tuple[str, str, str | None]]]] = {
    "python": (
        "py",
        "from pkg.m{n} import f{n} as other\nLIMIT_{k} = {k}\n\nclass C{k}(Base{k}):\n    def m{k}(self):\n        return other(self.x{k}(1))\n\n@deco{k}\ndef f{k}():\n    pass\n",
        [("constant", "LIMIT_{k}", "LIMIT_{k}"), ("class", "C{k}", "C{k}"), ("method", "m{k}", "C{k}.m{k}"), ("function", "f{k}", "f{k}")],
        [("import", "f{n}", "pkg.m{n}.f{n}"), ("inheritance", "Base{k}", None), ("call", "other", None), ("call", "self.x{k}", None), ("decorator", "deco{k}", None)],
    ),
    "tsx": (
        "tsx",
        "import {{ f{n} }} from './m{n}';\nexport function f{k}() {{ return f{n}(); }}\nexport const V{k} = () => <B{k}>it's {{f{k}()}}</B{k}>;\nclass K{k} {{ go() {{ return this.a.b(1); }} }}\n",
        [("function", "f{k}", "f{k}"), ("arrow_function", "V{k}", "V{k}"), ("class", "K{k}", "K{k}"), ("method", "go", "go")],
        [("import_esm", "./m{n}", None), ("import_named", "f{n}", "./m{n}"), ("export_esm", "f{k}", None), ("call", "f{n}", "./m{n}#f{n}"), ("export_esm", "V{k}", None), ("jsx_component", "B{k}", None), ("call", "f{k}", None), ("member_call", "b", None), ("member_access", "a", None)],
    ),
    "php": (
        "php",
        "<?php\nnamespace App;\nuse Lib\\N{n};\nclass P{k} extends Q{k} {{\n    public function run(N{n} $a) {{ $a->go({k}); self::make(); help{k}(); }}\n}}\n",
        [("namespace", "App", "App"), ("class", "P{k}", "App\\P{k}"), ("method", "run", "App\\P{k}::run")],
        [("import", "N{n}", "Lib\\N{n}"), ("extends", "Q{k}", "Q{k}"), ("method_call", "go", "Lib\\N{n}::go"), ("static_call", "make", "App\\P{k}::make"), ("call", "help{k}", "help{k}")],
    ),
    "go": (
        "go",
        'package m\n\nimport x "example.com/app/n{n}"\n\ntype S{k} struct {{ a int }}\n\nfunc (s *S{k}) Run() int {{ return x.F{n}(1) + own{k}() }}\n',
        [("struct", "S{k}", "S{k}"), ("method", "Run", "S{k}.Run")],
        [("import_go", "example.com/app/n{n}", None), ("go_selector_call", "F{n}", "x#F{n}"), ("call", "own{k}", None)],
    ),
    "rust": (
        "rs",
        "use crate::n{n}::stop;\npub struct S{k} {{ a: u32 }}\nimpl Run for S{k} {{ fn run(&self) {{ stop(); T{k}::new(); }} }}\n",
        [("struct", "S{k}", "S{k}"), ("method", "run", "S{k}.run")],
        [("import_rust", "stop", "crate::n{n}::stop"), ("implements", "Run", None), ("rust_call", "stop", None), ("rust_call", "new", "T{k}::new")],
    ),
    "blade": (
        "blade.php",
        "@extends('l{k}')\n@section('s{k}')\n@include('v{n}')\n<x-c{k}/> {{{{ $a }}}}\n@endsection\n",
        [("blade_section", "s{k}", "")],
        [("blade_extends", "l{k}", None), ("blade_view", "v{n}", None), ("blade_x_component", "c{k}", None), ("blade_php_expression", "$a", None)],
    ),
}


def _pieces(template: str) -> list[tuple[bool, str]]:
    """(whether a key, text) pieces of a template."""
    import string

    out = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            out.append((False, text))
        if name:
            out.append((True, name))
    return out


def _column(template: str) -> Column:
    return F.concat(F.lit(""), *(F.col(x).cast("string") if key else F.lit(x) for key, x in _pieces(template)))


def _sql(template: str | None) -> str:
    if template is None:
        return "NULL"
    parts = [f"CAST({x} AS VARCHAR)" if key else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for key, x in _pieces(template)]
    return " || ".join(["''", *parts])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    total = part.count()
    return part.select(F.col("p_partkey").alias("k"), F.pmod(F.col("p_partkey") + 1, F.lit(total)).alias("n"))


_PARTS = "d AS (SELECT p_partkey AS k, (p_partkey + 1) % (SELECT count(*) FROM part) AS n FROM part)"


def files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    suffix, source, _, _ = FILES[language]
    content = _column(source).cast("binary")
    rows = _parts(spark, sf_dir).select(_column(f"pkg/m{{k}}.{suffix}").alias("path"), F.lit(language).alias("language"), content.alias("content"))
    return rows.withColumn("content_hash", T.content_hash("content"))


def _nodes(language):
    def query(spark, sf_dir):
        return extract.nodes(extract.extracted(files(spark, sf_dir, language))).select("path", "kind", "name", "qname")

    suffix, _, nodes, _ = FILES[language]
    rows = [f"SELECT {_sql(f'pkg/m{{k}}.{suffix}')} AS path, '{kind}' AS kind, {_sql(name)} AS name, {_sql(qname)} AS qname FROM d" for kind, name, qname in nodes]
    return query, f"WITH {_PARTS} " + " UNION ALL ".join(rows)


def _refs(language):
    def query(spark, sf_dir):
        return extract.refs(extract.extracted(files(spark, sf_dir, language))).select("path", "kind", "name", F.coalesce("qname", F.lit("")).alias("qname"))

    suffix, _, _, refs = FILES[language]
    rows = [f"SELECT {_sql(f'pkg/m{{k}}.{suffix}')} AS path, '{kind}' AS kind, {_sql(name)} AS name, {_sql(qname or '')} AS qname FROM d" for kind, name, qname in refs]
    return query, f"WITH {_PARTS} " + " UNION ALL ".join(rows)


def _graph(spark, sf_dir):
    """Resolved edges of the TSX files, from bytes to edges."""
    facts = runtime.written(extract.extracted(files(spark, sf_dir, "tsx")), "facts")
    _, edges = index.graph(facts, Project())
    return edges


_TSX = _sql(FILES["tsx"][1])
_GRAPH = f"""WITH {_PARTS}, f AS (SELECT k, n, 'pkg/m' || k || '.tsx' AS path, sha256({_TSX}) AS hash FROM d),
e AS (
  SELECT a.hash || ':0' AS s, 'calls' AS kind, b.hash || ':0' AS t FROM f AS a JOIN f AS b ON a.n = b.k
  UNION ALL SELECT hash || ':1', 'calls', hash || ':0' FROM f
  UNION ALL SELECT 'file:' || a.path, 'imports', b.hash || ':0' FROM f AS a JOIN f AS b ON a.n = b.k
  UNION ALL SELECT 'file:' || path, 'exports', hash || ':0' FROM f UNION ALL SELECT 'file:' || path, 'exports', hash || ':1' FROM f
)
SELECT s AS source_node_id, kind, t AS target_node_id, 'parser_extract' AS provenance, CAST(80 AS INTEGER) AS confidence FROM e
UNION ALL SELECT 'lh:V' || k, 'react_component', 'lh:react.component', 'laravel_heuristic', CAST(90 AS INTEGER) FROM f"""


def _stream(spark, sf_dir):
    """Events as a stream of micro-batches into a table with the latest row of each path."""
    shape = changes(spark, sf_dir)
    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1)
    stream = source.parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("generation"), F.col("event_type").alias("kind"))
    state = {"table": spark.createDataFrame([], shape.select("path", "generation", "kind").schema)}

    def apply(batch: DataFrame, batch_id: int) -> None:
        new = ops.latest(batch, "path", "generation")
        merged = ops.latest(state["table"].unionByName(new), "path", "generation")
        state["table"] = runtime.written(merged, "stream")

    checkpoint = f"{runtime.shared_dir(spark)}/graphlens/stream-{spark.sparkContext.applicationId}-{abs(hash((sf_dir, id(state))))}"
    rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return state["table"]


QUERIES = {f"extract_{language}_nodes": _nodes(language) for language in FILES}
QUERIES |= {f"extract_{language}_refs": _refs(language) for language in FILES}
QUERIES |= {
    "index_graph": (_graph, _GRAPH),
    "stream_latest_per_path": (_stream, "SELECT 'user/' || user_id AS path, max(event_id) AS generation, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id"),
}
