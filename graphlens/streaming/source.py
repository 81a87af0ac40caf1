"""A stream of what changes in a source tree, as a Python data source.

Spark's file streams never tell of deletions.  This source lists the tree at each
trigger, compares the listing with the last one, and emits (path, kind, ts, seq) rows.
Each offset names a listing kept in the state folder, so that a restarted query reads
the same batches again; listings older than the committed one are removed.

    spark.dataSource.register(TreeChanges)
    events = spark.readStream.format("tree_changes").option("path", root).option("state", folder).load()
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "path string, kind string, ts timestamp, seq long"


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TreeChangesReader:  # noqa: N802  the interface's name
        return TreeChangesReader(self.options)


class TreeChangesReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        uri = lambda p: p if "://" in p else f"file://{p}"
        self.files, self.root = fs.FileSystem.from_uri(uri(options["path"]))
        self.states, self.state = fs.FileSystem.from_uri(uri(options["state"]))
        self.states.create_dir(self.state, recursive=True)

    # Listings --------------------------------------------------------------------------

    def _listing(self) -> dict[str, list]:
        from pyarrow import fs

        from ..sources.ignore import BUILTIN

        out, stack = {}, [""]
        while stack:
            folder = stack.pop()
            for info in self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True)):
                path = f"{folder}/{info.base_name}" if folder else info.base_name
                if info.type == fs.FileType.Directory:
                    if info.base_name not in BUILTIN:
                        stack.append(path)
                elif info.type == fs.FileType.File:
                    out[path] = [info.size, info.mtime_ns]
        return out

    def _place(self, n: int) -> str:
        return f"{self.state}/listing-{n}.json"

    def _load(self, n: int) -> dict:
        from pyarrow import fs

        if n == 0 or self.states.get_file_info(self._place(n)).type != fs.FileType.File:
            return {"at": 0.0, "files": {}}
        with self.states.open_input_stream(self._place(n)) as f:
            return json.loads(f.read())

    def _save(self, n: int, listing: dict) -> None:
        with self.states.open_output_stream(self._place(n) + ".new") as f:
            f.write(json.dumps(listing).encode())
        self.states.move(self._place(n) + ".new", self._place(n))

    @staticmethod
    def _rows(old: dict, new: dict, n: int) -> list[tuple]:
        from datetime import UTC, datetime

        at = datetime.fromtimestamp(new["at"], UTC)
        kinds = {p: "deleted" for p in old["files"].keys() - new["files"].keys()}
        kinds |= {p: "created" for p in new["files"].keys() - old["files"].keys()}
        kinds |= {p: "modified" for p in new["files"].keys() & old["files"].keys() if new["files"][p] != old["files"][p]}
        return [(p, k, at, n * 10_000_000 + i) for i, (p, k) in enumerate(sorted(kinds.items()))]

    # The interface ---------------------------------------------------------------------

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["listing"]
        old, new = self._load(n), {"at": time.time(), "files": self._listing()}
        if old["files"] == new["files"]:
            return iter(()), start
        self._save(n + 1, new)
        return iter(self._rows(old, new, n + 1)), {"listing": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows = []
        for n in range(start["listing"], end["listing"]):
            rows += self._rows(self._load(n), self._load(n + 1), n + 1)
        return iter(rows)

    def commit(self, end: dict) -> None:
        from pyarrow import fs

        for info in self.states.get_file_info(fs.FileSelector(self.state)):
            name = info.base_name
            if name.startswith("listing-") and name.endswith(".json") and int(name[8:-5]) < end["listing"] - 1:
                self.states.delete_file(info.path)
