"""Scanning a source tree, and reading its configuration.

Spark's own file sources hide names that start with an underscore or a dot, and so a
package's __init__.py.  The tree is therefore listed folder by folder, each level as one
job over the folders found, and the files are read where they are listed, through
pyarrow's file systems (local, HDFS, S3, GCS by the URI).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import runtime
from ..functions import text as T
from ..operators.resolve import Project
from .ignore import BUILTIN, CUSTOM_FILE, EXCLUDE_FILE, GIT_FILE, IgnoreRules

_LISTING = "path string, folder boolean, size long, mtime timestamp"


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))


def listing(spark: SparkSession, root: str, builtin: tuple[str, ...] = BUILTIN) -> DataFrame:
    """(path, folder, size, mtime) of everything below root, relative to it; built-in
    folders are not entered, symbolic links not followed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = _filesystem(root)
        local = isinstance(files, fs.LocalFileSystem)
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                for info in files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                    if local and os.path.islink(info.path):
                        continue
                    if info.type not in (fs.FileType.Directory, fs.FileType.File):
                        continue
                    name = f"{folder}/{info.base_name}" if folder else info.base_name
                    rows.append({"path": name, "folder": info.type == fs.FileType.Directory, "size": info.size, "mtime": info.mtime})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))]))

    runtime.ship(spark)
    frontier = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        found = runtime.written(frontier.select("path").mapInArrow(run, _LISTING), "listing")
        levels.append(found)
        name = T.tail("path", "/")
        frontier = found.filter(F.col("folder") & ~name.isin(*builtin))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        frontier = frontier.repartition(max(1, min(frontier.count() // 64 + 1, 4 * spark.sparkContext.defaultParallelism)))


def _contents(files: DataFrame, root: str) -> DataFrame:
    """files with `content`; rows whose file is gone meanwhile are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(root)
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time: sizes are unknown
                row = batch.slice(i, 1)
                try:
                    with system.open_input_stream(f"{base}/{row.column(0)[0].as_py()}") as f:
                        data = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*row.schema.names, "content"])

    runtime.ship(files.sparkSession)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, content binary")


def _texts(listed: DataFrame, root: str, test) -> list[tuple[str, str]]:
    """Path and text of the few files that pass the test, on the driver."""
    rows = _contents(listed.filter(~F.col("folder") & test).select("path"), root).collect()
    return [(r.path, bytes(r.content).decode("utf-8", "replace")) for r in rows]


def ignore_rules(spark: SparkSession, root: str, listed: DataFrame) -> IgnoreRules:
    files = _texts(listed, root, T.tail("path", "/").isin(GIT_FILE, CUSTOM_FILE))
    # The exclude file lies in a folder that is not listed.
    system, base = _filesystem(root)
    from pyarrow import fs

    if system.get_file_info(f"{base}/{EXCLUDE_FILE}").type == fs.FileType.File:
        with system.open_input_stream(f"{base}/{EXCLUDE_FILE}") as f:
            files.append((EXCLUDE_FILE, f.read().decode("utf-8", "replace")))
    return IgnoreRules.of(files)


def kept(listed: DataFrame, rules: IgnoreRules) -> DataFrame:
    """The listed files that are not ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not rules.matched(p) for p in batch.column(0).to_pylist()], pa.bool_()))

    return listed.filter("not folder").mapInArrow(run, listed.schema)


def scan(spark: SparkSession, root: str, wide: bool = False, listed: DataFrame | None = None) -> DataFrame:
    """schema.SCANNED: the files of a tree that are not ignored, with hash and content for
    those of a known language; wide adds less usual suffixes."""
    listed = listing(spark, root) if listed is None else listed
    files = kept(listed, ignore_rules(spark, root, listed)).withColumn("language", T.language("path", wide))
    files = files.filter("language is not null")
    n = max(1, min(files.count() // 256 + 1, 64 * spark.sparkContext.defaultParallelism))
    read = _contents(files.select("path", "language", "mtime", "size").repartition(n), root)
    return read.select("path", "language", T.content_hash("content").alias("content_hash"), T.epoch_seconds("mtime").alias("mtime"), F.octet_length("content").cast("long").alias("size"), "content")


# --- Configuration ---------------------------------------------------------------------

_JSONC = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/|,(?=\s*(?://[^\n]*\s*|/\*.*?\*/\s*)*[}\]])', re.S)


def jsonc(text: str) -> object:
    """JSON with comments and trailing commas; None if it cannot be read."""
    try:
        return json.loads(_JSONC.sub(lambda m: m[1] or "", text))
    except ValueError:
        return None


def tsconfig(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(baseUrl, [(pattern, first target)]) in pattern order."""
    data = jsonc(text)
    options = data.get("compilerOptions") if isinstance(data, dict) else None
    options = options if isinstance(options, dict) else {}
    paths = options.get("paths")
    aliases = sorted((k, v[0]) for k, v in paths.items() if isinstance(v, list) and v and isinstance(v[0], str)) if isinstance(paths, dict) else []
    base = options.get("baseUrl", "")
    return (base if isinstance(base, str) else "").strip("./"), aliases


def go_module(text: str) -> str | None:
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        if line.startswith("module "):
            return line[7:].strip().strip("\"'") or None
    return None


def project(spark: SparkSession, root: str, listed: DataFrame | None = None) -> Project:
    """What tsconfig.json and go.mod at the root, and the Python packages, say."""
    listed = listing(spark, root) if listed is None else listed
    texts = dict(_texts(listed, root, F.col("path").isin("tsconfig.json", "go.mod")))
    base, aliases = tsconfig(texts.get("tsconfig.json", ""))
    packages = listed.filter(~F.col("folder") & (T.tail("path", "/") == "__init__.py")).select(T.directory("path").alias("p"))
    return Project(base, aliases, go_module(texts.get("go.mod", "")), [r.p for r in packages.collect()])
