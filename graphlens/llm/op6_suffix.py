"""Exact repeats of LENGTH bytes, and of WORDS words, by suffix arrays of Lyndon groups.

Every string of LENGTH symbols (a window) is named by its least hash of GRAM symbols, the
anchor, so equal windows have equal anchors at equal places.  A run is the windows of a
text that share one anchor occurrence; runs with equal symbols repeat whole.
Runs whose anchor occurs in other surroundings too are cut into units of UNIT windows:
what all windows of a unit share, its core, becomes one symbol, and the symbols before
and after it stay symbols.  Units with one core meet in one task, where each is halved,
which gives each half a longer core; halves whose core no other unit has are done.  Over
the symbols of the others a suffix array puts equal windows side by side.  It is built by
linear grouping: groups of suffixes are taken in descending order, and through pointers to
the previous smaller suffix each extends the Lyndon prefix of those before it; then one
ascending pass emits every group's order from that of the next smaller suffixes, without
renaming.

A core shared by more than BOUND units would make a large task; such units are halved
first, and meet anew, until the groups are small enough or a unit is one window, all of
whose group are equal.  Symbols are bytes, or words (A-Z folded, by 64-bit hashes) for
passages that repeat with other spacing or signs between their words.  Runs and cores
count as equal if the 128-bit digests of their bytes (of words: 64 bits) are; what lies
around cores is compared itself.

Defined results: null text is empty; a text of fewer than LENGTH bytes keeps all bytes;
repeated rows repeat each other; null doc_id is kept; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

LENGTH = 400
GRAM = 50
UNIT = 32
BOUND = 10_000
SYMBOLS = 100_000
SEGMENT = 1 << 18
_POS = C.U64((1 << 24) - 1)


class Scale(NamedTuple):
    """What repeats: strings of `length` symbols, with anchors of `gram` symbols, in units of
    `unit` windows, a power of two; `symbol` is the type of a symbol beside a core."""

    length: int
    gram: int
    unit: int
    symbol: str


BYTES = Scale(LENGTH, GRAM, UNIT, "<i2")
WORDS = Scale(50, 10, 8, "<i8")


# --- Suffix arrays ---------------------------------------------------------------------


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, groups in ascending order, length of each Lyndon prefix).

    Two suffixes are in one group if their longest Lyndon prefixes are equal; groups are
    in the order of these prefixes.
    """
    n = len(s)
    letters = sorted(set(s))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in s]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    m = len(letters)
    below, above, done = list(range(-1, m - 1)), [*range(1, m), -1], [False] * m
    length = [1] * n
    previous = [-1] * n
    g = m - 1
    while g >= 0:
        # Pointers to the previous smaller suffix, left to right.  Groups above are done
        # and have theirs; a suffix of a lower group ends the search.
        own = members[g] = sorted(i for i in members[g] if group[i] == g)
        done[g] = True
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            step = length[own[0]]
            # Each of those pointed to goes on with this group's prefix, as often as it
            # was pointed to: they leave their groups upwards, the most often highest.
            split: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                split.setdefault((-k, group[j]), []).append(j)
                length[j] += k * step
            for (_, h), moved in sorted(split.items()):
                new = len(members)
                members.append(moved)
                for j in moved:
                    group[j] = new
                done.append(False)
                up = above[h]
                below.append(h)
                above.append(up)
                above[h] = new
                if up >= 0:
                    below[up] = new
        g = below[g]
    # No group is ever put below another, so the first letter's group stays lowest.
    ordered, g = [], 0 if n else -1
    while g >= 0:
        ordered.append(g)
        g = above[g]
    return group, ordered, length


def suffix_array(s: list[int]) -> list[int]:
    """Start places of the suffixes of s in ascending order."""
    n = len(s)
    group, ordered, length = lyndon_groups(s)
    size = [0] * len(ordered)
    for g in group:
        size[g] += 1
    slot, at = [0] * len(ordered), 0
    for g in ordered:
        slot[g] = at
        at += size[g]
    # Those whose Lyndon prefix ends where a suffix starts are ordered by that suffix.
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        ending[i + length[i]].append(i)
    out = [0] * n
    for i in ending[n]:
        out[slot[group[i]]] = i
        slot[group[i]] += 1
    for place in range(n):
        for i in ending[out[place]]:
            g = group[i]
            out[slot[g]] = i
            slot[g] += 1
    return out


def repeated_windows(units: list[list[int]], width: int = 0) -> list[list[bool]]:
    """For each unit (2 * width - 1 symbols, -1 outside a text), which of its width windows
    of width symbols also occurs in another unit."""
    width = width or UNIT
    text: list[int] = []
    for u in units:
        text += u
        text.append(-2)
    span = 2 * width
    found = [[False] * width for _ in units]
    last, last_key = -1, None
    for i in suffix_array(text):
        if i % span >= width:
            last = -1
            continue
        key = text[i : i + width]
        if last >= 0 and key == last_key and key[0] != -1 and key[-1] != -1:
            found[i // span][i % span] = found[last // span][last % span] = True
        last, last_key = i, key
    return found


# --- Runs ------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with (k1, k2), which tell texts apart; repeated rows share them."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"), "doc_id", "text")


def _symbols(data: np.ndarray, offs: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their hashes, cuts between texts)."""
    if scale.symbol == "<i2":
        return data, C._tables()[0][data], offs
    row, _, _, h = C.words(data, offs)
    return h, h, np.searchsorted(row, np.arange(len(offs)))


def _digests(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw, k = memoryview(np.ascontiguousarray(symbols)).cast("B") if len(symbols) else b"", symbols.itemsize
    return [hashlib.md5(raw[a:b]).digest()[: 16 if k == 1 else 8] for a, b in zip((start * k).tolist(), (end * k).tolist(), strict=True)]


def runs(values: np.ndarray, scale: Scale = BYTES, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash of the anchor) of the runs of windows with one
    anchor; values are the hashes of the symbols of one text, or of several between cuts."""
    length, gram = scale.length, scale.gram
    cuts = np.array([0, len(values)]) if cuts is None else cuts
    whole = np.zeros(len(values) + 1, np.int8)
    long = np.diff(cuts) >= length  # the others have no window
    np.add.at(whole, cuts[:-1][long], 1)
    np.add.at(whole, cuts[1:][long] - length + 1, -1)
    inside = np.cumsum(whole, dtype=np.int8).view(bool)  # windows within one text
    parts = []
    for lo in range(0, max(len(values) - length + 1, 0), SEGMENT):
        hi = min(len(values) - length + 1, lo + SEGMENT)
        own = np.flatnonzero(inside[lo:hi])
        if not len(own):
            continue
        piece = values[lo : hi + length - 1]
        up, down = C.powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[:-1], out=sums[1:])
        at = np.arange(len(piece) - gram + 1)
        grams = C.mix((sums[gram:] - sums[:-gram]) * down[: len(at)])
        low = (grams & ~_POS) | at.astype(np.uint64)
        # The least of length - gram + 1 keys from each place on, by doubling.
        width, step = length - gram + 1, 1
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < width:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        anchor = (low[own] & _POS).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        a = anchor[first]
        parts.append((a + lo, own[first] + lo, own[last] + lo, grams[a]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64)
    a, s, e, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
    # A run that goes on in the next segment is one run.
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    last = np.r_[first[1:], len(a)] - 1
    return a[first], s[first], e[last], grams[first]


def _runs_of(docs: DataFrame, scale: Scale) -> DataFrame:
    """(k1, k2, a, ds, de, class, body): ds and de are the anchor's place in the first and
    the last window of the run, body the digest of the run's symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.chunks(batches):
            symbols, values, cuts = _symbols(data, offs, scale)
            a, s, e, gram = runs(values, scale, cuts)
            own = np.searchsorted(cuts, s, "right") - 1
            body = _digests(symbols, s, e + scale.length)
            ds, de = a - s, a - e
            a -= cuts[own]
            which = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(which), rows.column(1).take(which), pa.array(a), pa.array(ds.astype(np.int16)), pa.array(de.astype(np.int16)), pa.array(gram.view(np.int64)), pa.array(body, pa.binary())],
                names=["k1", "k2", "a", "ds", "de", "class", "body"],
            )

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, a long, ds short, de short, class long, body binary")


# --- Units -----------------------------------------------------------------------------

COLUMNS = ["u1", "u2", "sides", "k1", "k2", "at", "alone"]
_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
UNITS = "u1 long, u2 binary, sides binary, k1 long, k2 long, at long, alone boolean"
RANGES = [("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]


def _arrow(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _units_of(rows: DataFrame, scale: Scale) -> DataFrame:
    """(u1, u2, sides, k1, k2, at, alone): the units of the runs in `found`; sides are the
    symbols before and after the core, -1 outside the text."""
    length, unit = scale.length, scale.unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                symbols, _, _ = _symbols(data, np.array([0, len(data)]), scale)
                a, ds, de, gram, alone = (np.array(x) for x in zip(*(tuple(f.values()) for f in found), strict=True))
                lo = de // unit
                n = ds // unit - lo + 1
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                gram, alone = np.repeat(gram, n), np.repeat(alone, n)
                at = np.repeat(a, n) - unit * block - (unit - 1)  # the unit's first window
                core = _digests(symbols, at + unit - 1, at + length)
                pad = np.full(len(symbols) + 2 * unit, -1, scale.symbol)
                pad[unit : unit + len(symbols)] = symbols if symbols.itemsize == 1 else symbols >> C.U64(1)
                side = np.arange(unit, 2 * unit - 1)
                sides = np.concatenate([pad[at[:, None] + side], pad[(at + length)[:, None] + side]], 1)
                u = C.mix(gram.astype(np.int64).view(np.uint64) * C.U64(0xD6E8FEB86659FD93) + block.astype(np.uint64))
                columns = (u.view(np.int64), core, [x.tobytes() for x in sides], [k1] * len(at), [k2] * len(at), at, alone)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=COLUMNS)

    return rows.select("k1", "k2", "text", "found").mapInArrow(run, UNITS)


def _halved(units: DataFrame, width: int, symbol: str) -> DataFrame:
    """Units of width / 2 windows, whose cores are longer by what their windows share; those
    without a window in the text go."""
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for u1, u2, sides, *row, at, alone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(sides, symbol)
                left, right = v[: width - 1], v[width - 1 :]
                for t, more, around in ((0, left[half - 1 :], (left[: half - 1], right[: half - 1])), (half, right[:half], (left[half:], right[half:]))):
                    if (more >= 0).all():
                        core = hashlib.md5(bytes([width, t]) + u2 + more.tobytes()).digest()
                        out.append((u1, core, np.concatenate(around).tobytes(), *row, at + t, alone))
            yield _arrow(out, list(zip(COLUMNS, _KINDS, strict=True)))

    return units.select(*COLUMNS).mapInArrow(run, UNITS)


def _spans(flags: list[bool], at: int, length: int) -> list[tuple[int, int]]:
    """Ranges covered by the windows that are flagged, the first starting at `at`."""
    out, t = [], 0
    while t < len(flags):
        if flags[t]:
            e = t
            while e + 1 < len(flags) and flags[e + 1]:
                e += 1
            out.append((at + t, at + e + length))
            t = e
        t += 1
    return out


class _Matcher:
    """Gathers groups of units with one core, and solves many groups in one suffix array."""

    def __init__(self, scale: Scale, width: int) -> None:
        self.length, self.symbol, self.width = scale.length, scale.symbol, width
        self.outside = b"\xff" * np.dtype(scale.symbol).itemsize
        self.out: list[tuple] = []
        self.waiting: list[list[tuple[bytes, list]]] = []
        self.size = 0

    def add(self, group: dict[bytes, list]) -> None:
        """Takes equal units; of the rest, the halves whose longer core another unit shares too
        wait for the suffix array, as every window of a half contains that core."""
        rest = self.equal(group, self.width)
        if rest:
            half, size, outside = self.width // 2, len(self.outside), self.outside
            cores: dict[tuple[int, bytes], dict[bytes, list]] = {}
            for sides, rows in rest.items():
                # As in _halved; a unit without a window in the text has a core that ends outside.
                left, right = sides[: (self.width - 1) * size], sides[(self.width - 1) * size :]
                h, e = half * size, (half - 1) * size
                for t, more, around in ((0, left[e:], left[:e] + right[:e]), (half, right[:h], left[h:] + right[h:])):
                    if more[:size] != outside and more[-size:] != outside:
                        moved = [(k1, k2, at + t, alone) for k1, k2, at, alone in rows]
                        cores.setdefault((t, more), {}).setdefault(around, []).extend(moved)
            for units in cores.values():
                units = self.equal(units, half)
                if units:
                    self.waiting.append(list(units.items()))
                    self.size += len(units) * 2 * half
            if self.size >= SYMBOLS:
                self.solve()

    def equal(self, group: dict[bytes, list], width: int) -> dict[bytes, list]:
        """Takes the windows of units that are equal; what is left to compare, in which those
        taken stand as partners only."""
        left, single = {}, False
        for sides, rows in group.items():
            if len(rows) > 1:  # equal units: all their windows in the text repeat
                self.take(rows, self.inside(sides, width))
                left[sides] = [(*rows[0][:3], False)]
            else:
                left[sides] = rows
                single = single or rows[0][3]
        return left if single and len(left) > 1 else {}

    def inside(self, sides: bytes, width: int) -> list[bool]:
        """Which windows of a unit lie in the text."""
        if not sides or not (sides.startswith(self.outside) or sides.endswith(self.outside)):
            return [True] * width
        s = np.frombuffer(sides, self.symbol)
        return (np.r_[s[: width - 1] >= 0, True] & np.r_[True, s[width - 1 :] >= 0]).tolist()

    def take(self, rows: list, flags: list[bool]) -> None:
        for k1, k2, at, alone in rows:
            if alone:
                self.out.extend((k1, k2, a, b) for a, b in _spans(flags, at, self.length))

    def solve(self) -> None:
        half, symbols, owners = self.width // 2, [], []
        for core, group in enumerate(self.waiting):
            for sides, rows in group:
                v = np.frombuffer(sides, self.symbol).tolist()
                symbols.append([*v[: half - 1], -3 - core, *v[half - 1 :]])
                owners.append(rows)
        if symbols:
            for flags, rows in zip(repeated_windows(symbols, half), owners, strict=True):
                self.take(rows, flags)
        self.waiting, self.size = [], 0


def _matched(units: DataFrame, scale: Scale, width: int) -> DataFrame:
    """(k1, k2, start, end): symbols of the units' windows that occur elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, at, group = _Matcher(scale, width), None, {}
        for batch in batches:
            for u1, u2, sides, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (u1, u2) != at:
                    matcher.add(group)
                    at, group = (u1, u2), {}
                group.setdefault(sides, []).append(row)
            if len(matcher.out) > 20_000:
                yield _arrow(matcher.out, RANGES)
                matcher.out = []
        matcher.add(group)
        matcher.solve()
        yield _arrow(matcher.out, RANGES)

    return units.select(*COLUMNS).repartition("u1", "u2").sortWithinPartitions("u1", "u2").mapInArrow(run, "k1 long, k2 long, start long, end long")


# --- The operator ----------------------------------------------------------------------

RUN = ["class", "ds", "de", "body"]


def _solved(units: DataFrame, scale: Scale) -> DataFrame:
    """Ranges of the units' repeated windows; large groups come back with longer cores."""
    width, out = scale.unit, None
    while True:
        sizes = units.groupBy("u1", "u2").agg(F.count("*").alias("n")).filter("n > 1")
        units = C.materialize(units.join(C.materialize(sizes, "groups"), ["u1", "u2"]), "grouped") if width < scale.unit else units.join(C.materialize(sizes, "groups"), ["u1", "u2"])
        if width == 1:  # one window a unit, all equal
            done = units.filter("alone").select("k1", "k2", F.col("at").alias("start"), (F.col("at") + scale.length).alias("end"))
        else:
            done = _matched(units.filter(F.col("n") <= BOUND), scale, width)
        out = done if out is None else out.unionByName(done)
        large = units.filter(F.col("n") > BOUND)
        if width == 1 or not large.limit(1).count():
            return out
        units = C.materialize(_halved(large, width, scale.symbol), "halved")
        width //= 2


def repeats(docs: DataFrame, scale: Scale = BYTES) -> DataFrame:
    """(k1, k2, start, end): ranges of the symbols of the texts (named as in _keyed) that are
    covered by repeated windows; ranges overlap and may come more than once."""
    C.tune(docs.sparkSession)
    keyed = _keyed(docs)
    found = C.materialize(_runs_of(keyed, scale), "runs")
    # Equal runs are counted before they are shuffled; any one of them stands for all.
    bodies = C.materialize(found.groupBy(*RUN).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "a"))), "bodies")
    whole = found.join(bodies.filter("n > 1").select(*RUN), RUN)
    whole = whole.select("k1", "k2", (F.col("a") - F.col("ds")).alias("start"), (F.col("a") - F.col("de") + scale.length).alias("end"))
    several = bodies.groupBy("class").agg(F.count("*").alias("m")).filter("m > 1").select("class")
    need = bodies.join(several, "class")
    lists = need.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "ds", "de", "class", (F.col("n") == 1).alias("alone"))).alias("found"))
    texts = keyed.join(lists, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    units = C.materialize(_units_of(texts, scale), "units")
    return whole.unionByName(_solved(units, scale))


def report(docs: DataFrame) -> DataFrame:
    """Per row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and in words the passages
    of at least WORDS.length words that start anywhere else too: (n_passages,
    n_passage_words)."""
    spark, found = docs.sparkSession, []
    for scale, name in ((BYTES, "ranges"), (WORDS, "passages")):
        # One after the other, so that their intermediate tables do not lie side by side.
        with C.cleaned(spark) as keep:
            each = repeats(docs, scale).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias(name))
            found.append(keep(C.materialize(each, name)))
            del each
    ranges = found[0].join(found[1], ["k1", "k2"], "full_outer")
    rows = _keyed(docs).join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges", "passages")
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("n_passage_words", pa.int64())]

    def merged(ranges: list | None) -> list[list[int]]:
        out: list[list[int]] = []
        for start, end in sorted((r["start"], r["end"]) for r in ranges or ()):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, ranges, passages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                spans, words = merged(ranges), merged(passages)
                kept, done = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(data[done:start])
                    done = end
                kept.update(data[done:])
                out.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), len(words), sum(b - a for a, b in words)))
            yield _arrow(out, schema)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
