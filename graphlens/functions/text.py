"""Strings, paths and hashes as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(content: Column | str) -> Column:
    """The 256-bit digest of a file's bytes."""
    return F.unhex(F.sha2(col(content), 256))


def node_id(digest: Column | str, local: Column | str) -> Column:
    return F.concat(F.lower(F.hex(col(digest))), F.lit(":"), col(local).cast("string"))


def valid_utf8(content: Column) -> Column:
    """Text of bytes, with a replacement sign for each ill-formed piece."""
    return F.make_valid_utf8(content.cast("string"))


#: Suffixes of indexed files, the longest first, and the wider set.
SUFFIXES = (
    (".blade.php", "blade"),
    (".php", "php"),
    (".js", "javascript"),
    (".cjs", "javascript"),
    (".mjs", "javascript"),
    (".ts", "typescript"),
    (".tsx", "tsx"),
    (".py", "python"),
    (".go", "go"),
    (".rs", "rust"),
)
MORE_SUFFIXES = ((".jsx", "javascript"), (".mts", "typescript"), (".cts", "typescript"), (".pyi", "python"))


def language(path: Column | str, wide: bool = False) -> Column:
    """Language by the path's suffix, in any case; null for others."""
    low = F.lower(col(path))
    out = None
    for suffix, name in SUFFIXES + (MORE_SUFFIXES if wide else ()):
        test = F.endswith(low, F.lit(suffix))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def numbered(text: Column | str, first: Column | int = 1) -> Column:
    """Each line with its number and a tab; a final line break starts no line."""
    text = col(text)
    first = first if isinstance(first, Column) else F.lit(first)
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    lines = F.transform(F.split(body, "\n", -1), lambda x, i: F.concat((i + first).cast("string"), F.lit("\t"), F.regexp_replace(x, "\r$", ""), F.lit("\n")))
    return F.when(text == "", "").otherwise(F.array_join(lines, ""))


def normal_path(path: Column | str) -> Column:
    """A path without `.` and with `..` taken back; `..` at the top is dropped."""
    parts = F.filter(F.split(col(path), "/"), lambda p: (p != "") & (p != "."))
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walk, "/")


def directory(path: Column | str) -> Column:
    return F.regexp_replace(col(path), "(^|/)[^/]*$", "")


def without_extension(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"\.[^./]*$", "")


def tail(text: Column | str, separator: str) -> Column:
    return F.substring_index(col(text), separator, -1)


def unquoted(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "^[\"'`]|[\"'`]$", "")


def python_module(path: Column | str) -> Column:
    """Dotted module of a Python file; a package's __init__ is the package."""
    base = F.regexp_replace(without_extension(path), "(^|/)__init__$", "")
    return F.replace(base, F.lit("/"), F.lit("."))


def rust_module(path: Column | str) -> Column:
    """Module path of a Rust file: without a leading src and without lib, main or mod."""
    base = F.regexp_replace(F.regexp_replace(without_extension(path), "^src/", ""), "(^|/)(lib|main|mod)$", "")
    return F.replace(base, F.lit("/"), F.lit("::"))


def js_module(path: Column | str) -> Column:
    return without_extension(path)


def is_screaming(name: Column | str) -> Column:
    return col(name).rlike("^[A-Z0-9_]*[A-Z][A-Z0-9_]*$")


def is_identifier(name: Column | str) -> Column:
    return col(name).rlike("^[A-Za-z_$][A-Za-z0-9_$]*$")


def is_hook(name: Column | str) -> Column:
    return col(name).rlike("^use[A-Z]")


def is_component(name: Column | str) -> Column:
    return col(name).rlike("^_*[A-Z]")


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970; before it, the seconds are counted up and negated."""
    micros = F.unix_micros(col(ts))
    return F.when(micros >= 0, F.floor(micros / 1_000_000)).otherwise(-F.floor(-micros / 1_000_000)).cast("long")
