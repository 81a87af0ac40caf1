"""Results as Markdown."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Row


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def table(rows: Sequence[Row], columns: Sequence[str], titles: Sequence[str] | None = None) -> str:
    """A Markdown table; bars and line breaks in cells are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(titles or [c.replace("_", " ") for c in columns]) + " |"
    line = "|" + " --- |" * len(columns)
    return "\n".join([head, line, *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])


def _label(row: Row) -> str:
    if row["name"] is None:
        return f"`{row['node_id']}` (not in the index)"
    return f"**{row['qname'] or row['name']}** ({row['kind']}) `{row['node_id']}`"


def by_path(rows: Iterable[Row]) -> str:
    """Nodes under the heading of their file, files in first-seen order."""
    groups: dict[str | None, list[Row]] = {}
    for r in rows:
        groups.setdefault(r["path"], []).append(r)
    out = []
    for path, own in groups.items():
        out.append(f"### {path or 'unknown'} ({len(own)})")
        out += [f"- {_label(r)}" for r in own]
    return "\n".join(out)


def _page(title: str, rows: Sequence[Row]) -> str:
    total = rows[0]["total"] if rows else 0
    more = "\n\n_More follow; ask with an offset._" if rows and rows[0]["truncated"] else ""
    return f"## {title}: {plural(total, 'node')}\n\n{by_path(rows)}{more}".rstrip()


def _source(row: Row) -> str:
    if not row["source"]:
        return ""
    cut = "\n_cut_" if row["source_truncated"] else ""
    return f"\n```{row['language'] or ''}\n{row['source']}\n```{cut}"


def _node(row: Row) -> str:
    if row["name"] is None:
        return f"No node `{row['node_id']}`."
    out = [f"## {_label(row)}", f"{row['path']}, line {row['start_line']}" if "start_line" in row else str(row["path"]), _source(row)]
    for name in ("callers", "callees", "members"):
        if name in row and row[name]:
            out.append(f"{name}: " + ", ".join(f"`{x}`" for x in row[name]))
    return "\n".join(x for x in out if x)


def render(tool: str, rows: Sequence[Row], **params: object) -> str:
    """Markdown of a tool's rows."""
    if tool in ("find_symbol", "search"):
        return f"## {plural(len(rows), 'match', 'matches')}\n\n{by_path(rows)}".rstrip()
    if tool in ("callers_of", "callees_of"):
        return _page(f"{'Callers' if tool == 'callers_of' else 'Callees'} of `{params.get('node_id', '')}`", rows)
    if tool == "impact":
        files = len({r["path"] for r in rows if r["path"] is not None})
        return _page(f"Impact of `{params.get('node_id', '')}` over {plural(files, 'file')}", rows)
    if tool == "nodes_in_file":
        kinds: dict[str, list[Row]] = {}
        for r in rows:
            kinds.setdefault(r["kind"], []).append(r)
        parts = [f"### {k} ({len(v)})\n" + "\n".join(f"- {r['qname'] or r['name']} `{r['node_id']}`" for r in v) for k, v in kinds.items()]
        return f"## {params.get('path', '')}: {plural(len(rows), 'node')}\n\n" + "\n\n".join(parts)
    if tool == "files":
        total = rows[0]["total"] if rows else 0
        return f"## {plural(total, 'file')}\n\n" + "\n".join(f"- {r['path']}" for r in rows)
    if tool in ("node", "context"):
        return "\n\n".join(map(_node, rows)) or "No match."
    if tool == "explore":
        missing = [r["node_id"] for r in rows if not r["known"]]
        out = [f"## {plural(len(rows) - len(missing), 'node')}, {rows[0]['bytes_used']:,} of {rows[0]['bytes_budget']:,} bytes" if rows else "## 0 nodes"]
        out += [_node(r) for r in rows if r["known"]]
        if missing:
            out.append("Not found: " + ", ".join(f"`{m}`" for m in missing))
        return "\n\n".join(out)
    if tool == "trace":
        return f"## {plural(rows[0]['length'], 'step')}\n\n" + "\n".join(f"{i}. `{n}`" for i, n in enumerate(rows[0]["path"])) if rows else "No path."
    return table(rows, rows[0].__fields__) if rows else "Nothing."
