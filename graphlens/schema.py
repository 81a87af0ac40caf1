"""Tables of the code graph, and the fixed vocabularies of kinds."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField
_s, _i, _l, _b = T.StringType(), T.IntegerType(), T.LongType(), T.BinaryType()

SPAN = T.StructType([_f("start_byte", _i), _f("end_byte", _i), _f("start_row", _i), _f("start_col", _i), _f("end_row", _i), _f("end_col", _i)])
NODE = T.StructType([_f("id", _i), _f("kind", _s), _f("name", _s), _f("qname", _s), _f("span", SPAN), _f("parent", _i)])
REF = T.StructType([_f("id", _i), _f("kind", _s), _f("name", _s), _f("qname", _s), _f("alias", _s), _f("span", SPAN), _f("container", _i)])
DIAGNOSTIC = T.StructType([_f("severity", _s), _f("message", _s), _f("span", SPAN)])
#: A call with its receiver and arguments, for the framework rules.
CALL = T.StructType(
    [
        _f("receiver_kind", _s),
        _f("receiver", _s),
        _f("method", _s),
        _f("scope", _s),
        _f("start", _i),
        _f("args", T.ArrayType(T.StructType([_f("kind", _s), _f("value", _s), _f("items", T.ArrayType(_s))]))),
    ]
)
EXTRACTED = T.StructType([_f("path", _s), _f("language", _s), _f("content_hash", _b), _f("nodes", T.ArrayType(NODE)), _f("refs", T.ArrayType(REF)), _f("diagnostics", T.ArrayType(DIAGNOSTIC)), _f("calls", T.ArrayType(CALL))])

SCANNED = T.StructType([_f("path", _s), _f("language", _s), _f("content_hash", _b), _f("mtime", _l), _f("size", _l), _f("content", _b)])
ACTIVE_FILE = T.StructType([_f("path", _s), _f("content_hash", _b), _f("mtime", _l), _f("size", _l), _f("generation", _l), _f("deleted", T.BooleanType())])
CONTENT_FILE = T.StructType([_f("content_hash", _b), _f("language", _s), _f("parser_version", _i), _f("diagnostics", T.ArrayType(DIAGNOSTIC))])
ACTIVE_NODE = T.StructType([_f("node_id", _s), _f("path", _s), _f("content_hash", _b), _f("local_node_id", _i), _f("kind", _s), _f("name", _s), _f("qname", _s), _f("span", SPAN), _f("parent", _i), _f("language", _s)])
EDGE = T.StructType([_f("source_node_id", _s), _f("kind", _s), _f("target_node_id", _s), _f("provenance", _s), _f("confidence", _i)])
SYMBOL = T.StructType([_f("name", _s), _f("kind", _s), _f("node_id", _s), _f("qname", _s), _f("path", _s)])
SCHEMA_VERSION = 1

# Kinds of edges.
CALL_KINDS = ("calls", "renders")
CONE_KINDS = ("calls", "renders", "inherits", "implements")
IMPACT_KINDS = ("calls", "renders", "inherits", "implements", "references")

# Languages whose symbols may refer to each other.
FAMILY = {"php": "php", "blade": "php", "javascript": "js", "typescript": "js", "tsx": "js", "python": "python", "go": "go", "rust": "rust"}
