"""Streams of changes: sources, debouncing, and applying batches to a store."""

from .changes import apply_stream, change_schema, changes_between, debounced_stream, freshness
from .source import TreeChanges

__all__ = ["TreeChanges", "apply_stream", "change_schema", "changes_between", "debounced_stream", "freshness"]
