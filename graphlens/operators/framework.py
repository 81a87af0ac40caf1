"""Framework edges: rules over PHP calls, Blade references and React definitions.

calls are rows (receiver_kind, receiver, method, scope, start, args) where args is an
array of (kind, value, items); refs and nodes are those of extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# Names the rules test for.
ROUTE_VERBS = ("get", "post", "put", "delete", "patch", "options", "any")
FACADES = ("Cache", "Log", "DB", "Auth", "Mail", "Queue", "Storage", "Session", "Redirect", "View", "Request", "Response", "Event")
QUERY_METHODS = ("find", "findOrFail", "findMany", "first", "firstOrFail", "where", "all", "create", "make", "updateOrCreate", "firstOrCreate", "firstOrNew")
RELATIONS = ("hasOne", "hasMany", "belongsTo", "belongsToMany", "morphTo", "morphOne", "morphMany", "morphToMany", "hasManyThrough", "hasOneThrough")
BINDINGS = ("bind", "singleton", "instance", "scoped")
JOB_FUNCTIONS = ("dispatch", "dispatch_now", "dispatch_sync")
BUILTIN_HOOKS = (
    "useActionState",
    "useCallback",
    "useContext",
    "useDebugValue",
    "useDeferredValue",
    "useEffect",
    "useFormStatus",
    "useId",
    "useImperativeHandle",
    "useInsertionEffect",
    "useLayoutEffect",
    "useMemo",
    "useOptimistic",
    "useReducer",
    "useRef",
    "useState",
    "useSyncExternalStore",
    "useTransition",
)
FUNCTION_KINDS = ("function", "arrow_function", "variable", "method")
COMPONENT_BASES = ("Component", "PureComponent", "React.Component", "React.PureComponent")
COMPONENT_WRAPPERS = ("memo", "forwardRef", "React.memo", "React.forwardRef")
LOW, MEDIUM, HIGH = 40, 70, 90
PROVENANCE = "laravel_heuristic"


def _edge(source: Column, target: Column, kind: str | Column, confidence: int | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, int) else confidence
    return F.struct(source.alias("source"), target.alias("target"), kind.alias("kind"), confidence.cast("int").alias("confidence"))


def _emitted(rows: DataFrame, edge: Column) -> DataFrame:
    """Edges of the rows for which `edge` is not null."""
    # Through explode, so that the filter does not repeat the whole rule.
    rows = rows.select(F.explode(F.array(edge)).alias("e")).filter("e is not null and e.target is not null and e.source is not null")
    return rows.select(F.concat(F.lit("lh:"), "e.source").alias("source_node_id"), F.col("e.kind").alias("kind"), F.concat(F.lit("lh:"), "e.target").alias("target_node_id"), F.lit(PROVENANCE).alias("provenance"), F.col("e.confidence").alias("confidence")).distinct()


def _arg(i: int) -> tuple[Column, Column, Column]:
    a = F.get("args", F.lit(i))
    return a["kind"], a["value"], a["items"]


def _class_arg(i: int) -> Column:
    kind, value, _ = _arg(i)
    return F.when(kind == "class", value)


def _route(path_at: int) -> Column:
    """A route to its action: [class, method], an invokable class, or 'Class@method'."""
    pk, pv, _ = _arg(path_at)
    kind, value, items = _arg(path_at + 1)
    verb = F.concat(F.lit("route:"), "method", F.lit(" "))
    source = F.concat(verb, F.when(pk == "string", pv).otherwise(F.concat(F.coalesce("scope", F.lit("")), F.lit("@"), F.col("start").cast("string"))))
    first, second = F.get(items, F.lit(0)), F.get(items, F.lit(1))
    pair = F.startswith(first, F.lit("class:")) & F.startswith(second, F.lit("string:"))
    at = F.instr(value, "@")
    return (
        F.when((kind == "array") & pair, _edge(source, F.concat(F.regexp_replace(first, "^class:", ""), F.lit("::"), F.regexp_replace(second, "^string:", "")), "routes_to", HIGH))
        .when(kind == "class", _edge(source, F.concat(value, F.lit("::__invoke")), "routes_to", HIGH))
        .when((kind == "string") & (at > 1) & (at < F.length(value)), _edge(source, F.concat(F.substring(value, F.lit(1), at - 1), F.lit("::"), F.substring(value, at + 1, F.length(value))), "routes_to", MEDIUM))
    )


def laravel_edge() -> Column:
    """The edge that a call means, or null; the first rule that fits decides."""
    kind, receiver, method = F.col("receiver_kind"), F.col("receiver"), F.col("method")
    scope = F.coalesce("scope", F.lit(""))
    k0, v0, _ = _arg(0)
    event = F.when(k0.isin("new", "class"), _edge(scope, v0, "dispatches_event", HIGH)).when(k0 == "string", _edge(scope, v0, "dispatches_event", MEDIUM))
    job = F.when(k0.isin("new", "class"), _edge(scope, v0, "dispatches_job", HIGH))
    none = F.lit(None).cast("struct<source:string,target:string,kind:string,confidence:int>")
    static = (
        F.when((receiver == "Route") & method.isin(*ROUTE_VERBS), _route(0))
        .when((receiver == "Route") & (method == "match"), _route(1))
        .when((receiver == "View") & (method == "make"), none)
        .when((receiver == "Event") & method.isin("dispatch", "fire"), event)
        .when((receiver == "Queue") & (method == "push"), job)
        .when(receiver.isin(*FACADES), _edge(scope, F.concat(receiver, F.lit("::"), method), "facade_call", HIGH))
        .when(method.isin(*QUERY_METHODS), _edge(scope, receiver, "uses_model", MEDIUM))
    )
    this = F.when(method.isin(*RELATIONS), _edge(scope, _class_arg(0), "relates_to", HIGH))
    container = F.when(method.isin(*BINDINGS), _edge(_class_arg(0), _class_arg(1), "binds", HIGH))
    function = F.when(method == "event", event).when(method.isin(*JOB_FUNCTIONS), job)
    return F.when(kind == "static", static).when(kind == "this", this).when(kind == "container", container).when(kind == "none", function)


def laravel(calls: DataFrame) -> DataFrame:
    return _emitted(calls, laravel_edge())


def views(calls: DataFrame) -> DataFrame:
    """(view, scope): views that calls name."""
    kind, value, _ = _arg(0)
    test = ((F.col("receiver_kind") == "none") & (F.col("method") == "view")) | ((F.col("receiver_kind") == "static") & (F.col("receiver") == "View") & (F.col("method") == "make"))
    return calls.filter(test & (kind == "string")).select(value.alias("view"), "scope")


def diagnostics(calls: DataFrame) -> DataFrame:
    """(scope, message) of calls that look like framework calls, but whose arguments do not
    say what they mean."""
    kind, receiver, method = F.col("receiver_kind"), F.col("receiver"), F.col("method")
    k0, _, _ = _arg(0)
    none, first_class = F.get("args", F.lit(0)).isNull(), F.coalesce(k0 == "class", F.lit(False))
    says = lambda text: F.concat(method, F.lit(f": {text}"))
    message = (
        F.when((kind == "this") & method.isin(*RELATIONS) & none, says("no related model"))
        .when((kind == "this") & method.isin(*RELATIONS) & ~first_class, says("the related model is not a class constant"))
        .when((kind == "container") & method.isin(*BINDINGS) & ~first_class, says("the abstract is not a class constant"))
        .when((kind == "container") & method.isin(*BINDINGS) & _class_arg(1).isNull(), says("the concrete is not a class constant"))
        .when((kind == "static") & (receiver == "Route") & method.isin(*ROUTE_VERBS) & (F.size("args") < 2), says("too few arguments of a route"))
        .when((kind == "static") & (receiver == "Route") & method.isin(*ROUTE_VERBS) & _route(0).isNull(), says("the action of a route is not literal"))
        .when((kind == "static") & (receiver == "Route") & (method == "match") & (F.size("args") < 3), says("too few arguments of a route"))
        .when((kind == "static") & (receiver == "Route") & (method == "match") & _route(1).isNull(), says("the action of a route is not literal"))
        .when((kind == "none") & (method == "view") & ~F.coalesce(k0 == "string", F.lit(False)), says("the view is not a string"))
        .when((kind == "none") & (method == "event") & ~F.coalesce(k0.isin("new", "class", "string"), F.lit(False)), says("the event is not literal"))
        .when((kind == "none") & method.isin(*JOB_FUNCTIONS) & ~F.coalesce(k0.isin("new", "class"), F.lit(False)), says("the job is not literal"))
    )
    return calls.select("scope", F.explode(F.array(message)).alias("message")).filter("message is not null")


def view_name(path: Column | str) -> Column:
    """view.a.b of resources/views/a/b.blade.php; null elsewhere."""
    rest = F.regexp_extract(T.col(path), r"(?:^|/)resources/views/(.+)$", 1)
    return F.when(rest != "", F.concat(F.lit("view."), F.replace(F.regexp_replace(rest, r"(\.blade)?\.php$", ""), F.lit("/"), F.lit("."))))


def blade(refs: DataFrame) -> DataFrame:
    """Edges of Blade references (path, kind, name)."""
    kind, name, source = F.col("kind"), F.col("name"), view_name("path")
    edge = (
        F.when(kind == "blade_extends", _edge(source, F.concat(F.lit("view."), name), "extends_view", HIGH))
        .when(kind == "blade_view", _edge(source, F.concat(F.lit("view."), name), "includes_view", HIGH))
        .when(kind.isin("blade_component", "blade_x_component"), _edge(source, F.concat(F.lit("component."), name), "uses_component", HIGH))
    )
    return _emitted(refs.filter("language = 'blade'"), edge)


def react(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Components, hooks and the hooks they use; nodes (path, local_node_id, kind, name,
    qname, parent), refs (path, kind, name, container)."""
    js = F.col("language").isin("javascript", "typescript", "tsx")
    inside = refs.filter(js & F.col("container").isNotNull()).select("path", F.col("container").alias("local_node_id"), F.col("kind").alias("rkind"), F.col("name").alias("rname"))
    jsx = inside.filter(F.col("rkind").isin("jsx_component", "jsx_element")).select("path", "local_node_id").distinct().withColumn("jsx", F.lit(True))
    defs = nodes.filter(js).join(jsx, ["path", "local_node_id"], "left")
    like = F.col("kind").isin(*FUNCTION_KINDS)
    hook = like & T.is_hook("name")
    # One leading underscore at most.
    component = like & F.col("name").rlike("^_?[A-Z]") & F.col("jsx").isNotNull()
    own = _emitted(defs, F.when(hook, _edge(F.col("qname"), F.lit("react.hook"), "react_hook", HIGH)).when(component, _edge(F.col("qname"), F.lit("react.component"), "react_component", HIGH)))
    held = defs.join(inside, ["path", "local_node_id"])
    used = F.concat(F.lit("react.hook."), "rname")
    builtin = F.col("rname").isin(*BUILTIN_HOOKS)
    uses = (F.col("rkind") == "call") & (hook | component)
    of_hook = F.when(uses & builtin, _edge(F.col("qname"), used, "react_uses_hook", HIGH)).when(uses & T.is_hook("rname"), _edge(F.col("qname"), used, "react_uses_hook", MEDIUM))
    by_class = F.when((F.col("kind") == "class") & F.col("rkind").isin("inheritance", "extends") & F.col("rname").isin(*COMPONENT_BASES), _edge(F.col("qname"), F.lit("react.component"), "react_component", HIGH))
    by_call = F.when(F.col("parent").isNull() & (F.col("rkind") == "call") & F.col("rname").isin(*COMPONENT_WRAPPERS), _edge(F.col("qname"), F.lit("react.component"), "react_component", MEDIUM))
    out = own
    for edge in (of_hook, by_class, by_call):
        out = out.unionByName(_emitted(held, edge))
    return out
