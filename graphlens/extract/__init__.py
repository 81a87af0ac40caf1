"""Extraction: source files to definitions, references and diagnostics.

register_language adds an extractor; extracted() runs them over a table of files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import runtime, schema
from ..functions import text as T
from . import blade, golang, javascript, php, python, rust
from .base import Facts

PARSER_VERSION = 1
Extractor = Callable[[bytes, str], Facts]

LANGUAGES: dict[str, Extractor] = {
    "python": python.extract,
    "javascript": lambda c, p: javascript.extract(c, p, "javascript"),
    "typescript": lambda c, p: javascript.extract(c, p, "typescript"),
    "tsx": lambda c, p: javascript.extract(c, p, "tsx"),
    "php": php.extract,
    "go": golang.extract,
    "rust": rust.extract,
    "blade": blade.extract,
}


def register_language(name: str, extractor: Extractor) -> None:
    """Adds or replaces the extractor of a language; call it on the driver before
    extracted(), which sends the extractors to the executors."""
    LANGUAGES[name] = extractor


def facts(content: bytes, path: str, language: str, extractors: dict[str, Extractor] | None = None) -> Facts:
    """Facts of one file; an extractor that fails gives a diagnostic, never an error."""
    try:
        return (extractors or LANGUAGES)[language](content, path)
    except Exception as e:  # noqa: BLE001  one file must not end the job
        out = Facts(content.decode("latin-1"))
        out.error(f"{type(e).__name__}: {e}", 0)
        return out


def extracted(files: DataFrame) -> DataFrame:
    """One row of nested facts (schema.EXTRACTED) for each file (path, language,
    content_hash, content) of a known language."""
    from pyspark.sql.pandas.types import to_arrow_schema

    runtime.ship(files.sparkSession)
    target = to_arrow_schema(schema.EXTRACTED)
    own = dict(LANGUAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, digest, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = facts(content or b"", path, language, own)
                rows.append({"path": path, "language": language, "content_hash": digest, "nodes": f.nodes, "refs": f.refs, "diagnostics": f.diagnostics, "calls": f.calls})
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    known = files.filter(F.col("language").isin(*own)).select("path", "language", "content_hash", "content")
    return known.mapInArrow(run, schema.EXTRACTED)


def nodes(facts_: DataFrame) -> DataFrame:
    """(node_id, path, content_hash, local_node_id, kind, name, qname, span, parent, language)"""
    rows = facts_.select("path", "language", "content_hash", F.explode("nodes").alias("n"))
    return rows.select(T.node_id("content_hash", "n.id").alias("node_id"), "path", "content_hash", F.col("n.id").alias("local_node_id"), "n.kind", "n.name", "n.qname", "n.span", "n.parent", "language")


def refs(facts_: DataFrame) -> DataFrame:
    rows = facts_.select("path", "language", "content_hash", F.explode("refs").alias("r"))
    return rows.select("path", "language", "content_hash", "r.*")


def calls(facts_: DataFrame) -> DataFrame:
    return facts_.select("path", F.explode("calls").alias("c")).select("path", "c.*")


def diagnostics(facts_: DataFrame) -> DataFrame:
    return facts_.select("path", F.explode("diagnostics").alias("d")).select("path", "d.*")
