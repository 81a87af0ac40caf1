"""GraphSession: one method for each tool, each giving a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import index, runtime
from .extract import PARSER_VERSION
from .operators import context, search, traverse
from .store import Store

# Bounds of parameters, in bytes and items.
TEXT_MAX, PATH_MAX, ID_MAX, KIND_MAX, IDS_MAX = 10_000, 4096, 1024, 128, 256
PAGE_DEFAULT, PAGE_MAX = 200, 1000
IMPACT_DEFAULT, IMPACT_MAX = 500, 5000


def _checked(name: str, value: str | None, most: int) -> str | None:
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{name} must be a string")
    if value is not None and len(value.encode()) > most:
        raise ValueError(f"{name} exceeds {most} bytes")
    return value


class GraphSession:
    """Queries over the code graph of one tree.

    `root` is the tree, `store` the folder of its snapshots; sync() or reindex() fill it.
    """

    def __init__(self, spark: SparkSession, root: str, store: str):
        runtime.ship(spark)
        self.spark, self.root, self.store = spark, root, Store(spark, store)
        self._version: str | None = None

    # Tables of the current snapshot, held while it is current.

    def _load(self) -> None:
        version = self.store.version()
        if version != self._version:
            for df in (getattr(self, "_nodes", None), getattr(self, "_edges", None)):
                if df is not None:
                    df.unpersist()
            self._nodes, self._edges, self._version = self.store.nodes().cache(), self.store.edges().cache(), version

    @property
    def nodes(self) -> DataFrame:
        self._load()
        return self._nodes

    @property
    def edges(self) -> DataFrame:
        self._load()
        return self._edges

    @property
    def contents(self) -> DataFrame:
        """(path, content) of the tree's files, read when asked."""
        from .sources import scan

        return scan._contents(self.store.files().select("path"), self.root)

    # Maintenance -----------------------------------------------------------------------

    def _summary(self, operation: str, out: dict) -> DataFrame:
        row = {"operation": operation, **out}
        return self.spark.createDataFrame([row], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in row.items()))

    def sync(self) -> DataFrame:
        return self._summary("sync", index.sync(self.spark, self.root, self.store))

    def reindex(self) -> DataFrame:
        return self._summary("reindex", index.reindex(self.spark, self.root, self.store))

    # Reads -----------------------------------------------------------------------------

    def find_symbol(self, name: str, kind: str | None = None) -> DataFrame:
        return search.find_symbol(self.nodes, _checked("name", name, TEXT_MAX), _checked("kind", kind, KIND_MAX)).orderBy("node_id")

    def search(self, name: str, mode: str = "contains", kind: str | None = None, path_prefix: str | None = None, limit: int = search.SEARCH_LIMIT) -> DataFrame:
        return search.search(self.nodes, _checked("name", name, TEXT_MAX), mode, _checked("kind", kind, KIND_MAX), _checked("path_prefix", path_prefix, PATH_MAX), limit)

    def _related(self, node_id: str, backward: bool, limit: int | None, offset: int) -> DataFrame:
        found = traverse.neighbours(self.edges, _checked("node_id", node_id, ID_MAX), backward)
        rows = traverse.page(found, ["node_id"], min(PAGE_DEFAULT if limit is None else limit, PAGE_MAX), offset)
        return traverse.with_summary(rows, self.nodes).orderBy("node_id")

    def callers_of(self, node_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self._related(node_id, True, limit, offset)

    def callees_of(self, node_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self._related(node_id, False, limit, offset)

    def nodes_in_file(self, path: str) -> DataFrame:
        return search.nodes_in_file(self.nodes, _checked("path", path, PATH_MAX))

    def node(self, node_id: str, related_limit: int = 20, snippet_bytes: int = 4096) -> DataFrame:
        ids = traverse.seed(self.spark, _checked("node_id", node_id, ID_MAX))
        out = context.node(self.nodes, self.edges, self.contents, ids, related_limit, snippet_bytes)
        own = search.members(self.nodes).filter(F.col("owner_id") == node_id).agg(F.array_sort(F.collect_list("member_id")).alias("members"))
        for name, backward in (("member_callers", True), ("member_callees", False)):
            own = own.join(search.member_calls(self.nodes, self.edges, node_id, backward).orderBy("node_id").limit(related_limit).agg(F.array_sort(F.collect_list("node_id")).alias(name)))  # one row
        return out.join(own)  # one row

    def files(self, prefix: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
        return search.files(self.nodes, _checked("prefix", prefix, PATH_MAX) or "", limit, offset)

    def status(self) -> DataFrame:
        return search.status(self.nodes, self.edges)

    def impact(self, node_id: str, max_depth: int = 0, limit: int | None = None, offset: int = 0) -> DataFrame:
        found = traverse.impact(self.edges, _checked("node_id", node_id, ID_MAX), max_depth).select("node_id")
        rows = traverse.page(found, ["node_id"], min(IMPACT_DEFAULT if limit is None else limit, IMPACT_MAX), offset)
        return traverse.with_summary(rows, self.nodes).orderBy("node_id")

    def context(self, name: str, **options) -> DataFrame:
        return context.context(self.nodes, self.edges, self.contents, _checked("name", name, TEXT_MAX), **options)

    def explore(self, node_ids: Sequence[str], **options) -> DataFrame:
        if len(node_ids) > IDS_MAX:
            raise ValueError(f"node_ids exceeds {IDS_MAX} items")
        return context.explore(self.nodes, self.edges, self.contents, [_checked("node_id", i, ID_MAX) for i in node_ids], **options)

    def trace(self, source: str, target: str, max_depth: int = 12) -> DataFrame:
        return traverse.trace(self.edges, _checked("from", source, ID_MAX), _checked("to", target, ID_MAX), max_depth)

    # Further graph queries ---------------------------------------------------------------

    def forward_impact(self, node_id: str, max_depth: int | None = None) -> DataFrame:
        return traverse.forward_impact(self.edges, node_id, max_depth)

    def dependency_cone(self, node_id: str) -> DataFrame:
        return traverse.dependency_cone(self.edges, node_id)

    def changes_if(self, node_id: str) -> DataFrame:
        return traverse.changes_if(self.edges, node_id)

    def cycles(self) -> DataFrame:
        return traverse.cycles(self.edges).orderBy("component", "node_id")

    def path_between(self, source: str, target: str) -> DataFrame:
        return traverse.shortest_path(self.edges, source, target)

    def module_boundary(self, source: str = "", target: str = "") -> DataFrame:
        return traverse.module_boundary(self.edges, self.nodes, source, target).orderBy("source_path", "target_path", "kind")

    def diagnostics(self) -> DataFrame:
        from . import extract

        return extract.diagnostics(self.store.read("facts"))

    def content_files(self) -> DataFrame:
        return self.store.content_files(PARSER_VERSION)

    # Dispatch by name ------------------------------------------------------------------

    @property
    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        names = ("find_symbol", "search", "callers_of", "callees_of", "nodes_in_file", "node", "files", "status", "impact", "context", "explore", "trace", "sync", "reindex")
        return {n: getattr(self, n) for n in names}

    def call(self, tool: str, **params) -> DataFrame:
        if tool not in self.tools:
            raise ValueError(f"unknown tool {tool}")
        return self.tools[tool](**params)


