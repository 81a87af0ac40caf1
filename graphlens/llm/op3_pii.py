"""Personal data: base patterns and information-theoretic sanitisation.

Base patterns find e-mail, IP address, card and phone; a run of SECRET_CHARS or more
characters of keys and tokens, with letters and digits and ENTROPY bits a character, is a
secret.  These are the protected entities, each by its value and by its kind.  All
probabilities are over documents: a word t is counted with an entity e, n(e,t), in each
document where it stands within CONTEXT words of e at least once; n(t) and n(e) are the
documents with t and with e.  A word discloses e if P(e|t) = n(e,t) / n(t) reaches
CONFIDENCE, the information gained, log2(P(e|t) / P(e)), reaches GAIN_BITS, and the pair
has SUPPORT different surroundings.  So a name that stands beside one address is found by
the address's value, a word like `token` that announces secrets by their kind.
Disclosing words become spans of kind `term` wherever they occur, unless they overlap
another span; sanitize() generalises all spans to their kind.

Defined results: null text is the empty text, without spans; repeated rows each count
and each get a row; null doc_id is kept; an empty table gives no row; other columns are
ignored (sanitize keeps them).  Exact copies give the same surroundings, so they raise
n(e,t) and n(t) but not the support.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # so many of them are of the base patterns
CONTEXT, SUPPORT, CONFIDENCE, GAIN_BITS = 5, 3, 0.5, 2.0
SECRET_CHARS, ENTROPY = 20, 3.0
#: Up to so many disclosing words are broadcast; beyond, they are joined to documents.
TERM_LIMIT = 1_000_000
#: Columns added beside a caller's own ones.
OWN, KEY = "__graphlens_own", "__graphlens_key"

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The second branch eats a run of digits that starts no address, so none is read twice.
_IP = re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_KEY = re.compile(r"[A-Za-z0-9+/_-]++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if m[1] and all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[1].split("."))):
                out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def secret_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(4, start, end) of secrets that overlap no base span."""
    out = []
    for m in _KEY.finditer(text):
        word = m[0]
        if len(word) < SECRET_CHARS or not _DIGIT.search(word) or not _LETTER.search(word):
            continue
        bits = -sum(n / len(word) * log2(n / len(word)) for n in Counter(word).values())
        if bits >= ENTROPY and not any(x < m.end() and m.start() < y for _, x, y in base):
            out.append((BASE, *m.span()))
    return out


def entity_spans(text: str) -> list[tuple[int, int, int]]:
    """All protected entities, base ones first."""
    base = base_spans(text)
    return base + (secret_spans(text, base) if _DIGIT.search(text) else [])


def _code_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte (and the end), the code points before it in all of data."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def cooccurrence(docs: DataFrame) -> DataFrame:
    """(entity, term, around) once a document for each word near an entity, and a row with
    null term for the entity itself; an entity is a value or a kind, by its hash."""
    C.tune(docs.sparkSession)
    kinds = [_hash(k) for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.chunks(batches):
            texts = rows.column(0).to_pylist()
            found = [(i, s) for i, t in enumerate(texts) if t for s in entity_spans(t)]
            if not found:
                continue
            row, start, end, h = C.words(data, offs)
            points = _code_points(data, offs)
            start, end = points[start] - points[offs[row]], points[end] - points[offs[row]]
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            pairs: dict[tuple, int] = {}
            for i, (kind, a, b) in found:
                lo, hi = bounds[i], bounds[i + 1]
                left = lo + int(np.searchsorted(end[lo:hi], a, "right"))
                right = lo + int(np.searchsorted(start[lo:hi], b, "left"))
                near = np.r_[h[max(lo, left - CONTEXT) : left], h[right : min(hi, right + CONTEXT)]] >> C.U64(64 - C.TERM_BITS)
                around = _hash(near.tobytes().hex())
                for e in (kinds[kind], _hash(f"{KINDS[kind]}:{texts[i][a:b].lower()}")):
                    for t in (None, *near.tolist()):
                        pairs.setdefault((i, e, t), around)
            _, entity, term = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(entity, pa.int64()), pa.array(term, pa.int64()), pa.array(pairs.values(), pa.int64())], names=["entity", "term", "around"])

    return docs.select("text").mapInArrow(run, "entity long, term long, around long")


def disclosures(docs: DataFrame) -> DataFrame:
    """(entity, term, n_et, n_t, n_e, support, share, gain) of every word near an entity in
    SUPPORT surroundings, over all documents."""
    pairs = C.materialize(cooccurrence(docs).groupBy("entity", "term", "around").agg(F.count("*").alias("n")), "pairs")
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("support"))
    entities = pairs.filter("term is null").select("entity", F.col("n_et").alias("n_e"))
    likely = pairs.filter(F.col("term").isNotNull() & (F.col("support") >= SUPPORT))
    counts = C.term_counts(docs, distinct=True).withColumnRenamed("n", "n_t")
    total = docs.count()
    joined = likely.join(counts, "term").join(entities, "entity")
    share = F.col("n_et") / F.col("n_t")
    return joined.withColumn("share", share).withColumn("gain", F.log2(share / (F.col("n_e") / F.lit(float(max(total, 1))))))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(term, gain): words that disclose some entity, by the thresholds above."""
    found = disclosures(docs).filter((F.col("share") >= CONFIDENCE) & (F.col("gain") >= GAIN_BITS))
    return found.groupBy("term").agg(F.max("gain").alias("gain"))


def _with_terms(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, object]:
    """docs with `own` (the disclosing words to look for, null: the broadcast ones)."""
    spark = docs.sparkSession
    terms = C.materialize(terms.select("term"), "terms")
    if terms.limit(TERM_LIMIT + 1).count() <= TERM_LIMIT:
        known = np.sort(terms.toArrow().column("term").to_numpy().astype(np.uint64))
        return docs.withColumn(OWN, F.lit(None).cast("array<long>")), spark.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.chunks(batches):
            row, _, _, h = C.words(data, offs)
            row, term, _ = C.distinct_terms(row, h)
            yield pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(row)), pa.array(term.astype(np.int64))], names=[KEY, "term"])

    keyed = docs.withColumn(KEY, F.xxhash64("text"))
    own = keyed.select("text", KEY).mapInArrow(each, f"{KEY} long, term long").distinct().join(terms, "term").groupBy(KEY).agg(F.collect_list("term").alias(OWN))
    keyed = keyed.join(own, KEY, "left").drop(KEY)
    return keyed.withColumn(OWN, F.coalesce(OWN, F.array().cast("array<long>"))), spark.sparkContext.broadcast(np.zeros(0, np.uint64))


def _all_spans(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, own: list, known: np.ndarray) -> Iterator[tuple[str, list, list]]:
    """(text, entities, term spans) of each row; own: its words to look for, or None."""
    row, start, end, h = C.words(data, offs)
    term = h >> C.U64(64 - C.TERM_BITS)
    hit = C.lookup(known, term) >= 0
    for i, mine in enumerate(own):
        if mine:
            at = row == i
            hit[at] |= np.isin(term[at], np.array(mine, np.uint64))
    row, start, end = row[hit], start[hit], end[hit]
    points = _code_points(data, offs)
    start, end = points[start] - points[offs[row]], points[end] - points[offs[row]]
    bounds = np.searchsorted(row, np.arange(rows.num_rows + 1))
    for i, text in enumerate(rows.column(rows.schema.get_field_index("text")).to_pylist()):
        text = text or ""
        base = entity_spans(text)
        extra = [("term", a, b) for a, b in zip(start[bounds[i] : bounds[i + 1]].tolist(), end[bounds[i] : bounds[i + 1]].tolist(), strict=True) if not any(x < b and a < y for _, x, y in base)]
        yield text, base, extra


def _written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The operator: all spans of every text, as the contract's columns, then n_secret,
    n_term and n_spans."""
    C.tune(docs.sparkSession)
    docs, known = _with_terms(docs.select("doc_id", "text"), terms)
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_secret", "n_term", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.chunks(batches):
            out = []
            for _, found, extra in _all_spans(rows, data, offs, rows.column(2).to_pylist(), known.value):
                named = [(KINDS[k], a, b) for k, a, b in found]
                count = [sum(k == j for k, _, _ in found) for j in range(len(KINDS))]
                base = _written(named[: sum(count[:BASE])])
                out.append((*count[:BASE], hashlib.sha256(base.encode()).hexdigest(), _written(named + extra), count[BASE], len(extra), len(found) + len(extra)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(names[1:], cols, strict=True))], names=names)

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_term long, n_spans long")


def sanitize(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; null text stays."""
    C.tune(docs.sparkSession)
    columns = docs.columns
    marked, known = _with_terms(docs, disclosing_terms(docs) if terms is None else terms)
    marked = marked.select(*(F.col(f"`{c}`") for c in columns), OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.chunks(batches):
            out = []
            nulls = rows.column(rows.schema.get_field_index("text")).is_null().to_pylist()
            for (text, base, extra), null in zip(_all_spans(rows, data, offs, rows.column(rows.num_columns - 1).to_pylist(), known.value), nulls, strict=True):
                done, parts = 0, []
                for a, b, kind in sorted([(a, b, KINDS[k]) for k, a, b in base] + [(a, b, k) for k, a, b in extra]):
                    if b > done:  # kinds may overlap: the first names the place
                        if a >= done:
                            parts += [text[done:a], f"[{kind.upper()}]"]
                        done = b
                out.append(None if null else "".join([*parts, text[done:]]))
            arrays = [pa.array(out, f.type) if f.name == "text" else rows.column(j) for j, f in enumerate(rows.schema) if f.name != OWN]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return marked.mapInArrow(run, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.tune(spark)
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, disclosing_terms(docs))
