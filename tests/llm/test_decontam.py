import hashlib
import random

from graphlens.llm import op9_decontam as op

from .helpers import awkward, docs, words


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, token string")


def plain(rows, bench):
    wins = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - op.WINDOW + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + op.WINDOW]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text, _ in rows:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = wins.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, bench):
    return sorted((tuple(r) for r in op.report(docs(spark, rows), items(spark, bench)).collect()), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["École", "ÉCOLE", "école", "the", "The", "a"]
    text = lambda n: rng.choices(vocabulary, k=n)
    bench = [(i, " ".join(text(n))) for i, n in enumerate([1, 2, 9, 10, 11, 30, 30, 40, 0, 25])] + [(3, "repeated item here"), (3, "repeated item here"), (None, " ".join(text(12))), (50, None), (51, "!!!")]
    rows = []
    for i in range(150):
        w = text(rng.randint(0, 80))
        if i % 3 == 0:
            b = words(rng.choice([t for _, t in bench if t]))
            cut = rng.randint(0, max(0, len(b) - 8))
            piece = [x.upper() if x.isascii() and rng.random() < 0.3 else x for x in b[cut:]]
            at = rng.randint(0, len(w))
            w[at:at] = piece
        rows.append((i, rng.choice(["", "  ", "."]) + ", ".join(w) + rng.choice(["", ".", "\n"]), "a"))
    return rows, bench


def test_by_brute_force(spark):
    rows, bench = corpus()
    assert run(spark, rows, bench) == plain(rows, bench)


def test_joined_words_give_the_same(spark, monkeypatch):
    rows, bench = corpus(2)
    monkeypatch.setattr(op, "TOKENS", 2)
    assert run(spark, rows, bench) == plain(rows, bench)


def test_case_beyond_ascii_counts(spark):
    rows = [(1, "ÉCOLE one", "a"), (2, "école ONE", "a"), (3, "İstanbul K kelvin", "a")]
    for bench in ([(1, "école one")], [(1, "istanbul k kelvin"), (2, "İstanbul K kelvin")]):
        assert run(spark, rows, bench) == plain(rows, bench)


def test_letters_whose_lower_case_depends_on_their_neighbours(spark, monkeypatch):
    item = "alpha beta gamma delta eps ΟΔΟΣ.ΑΒ zeta eta theta"
    rows = [(1, f"before {item} after", "a"), (2, item, "a"), (3, "Α.Σ. ẞ İ end", "a"), (4, "Α.Σ.", "a"), (5, f".{item.replace('alpha', 'ALPHA')}", "a"), (6, item.lower(), "a")]
    bench = [(1, item), (2, "Α.Σ. ẞ İ end"), (3, "ΟΔΟΣ"), (4, "Σ.ΑΣ Σ'Α")]
    found = run(spark, rows, bench)
    assert found == plain(rows, bench)
    assert [r[5] for r in found] == [True, True, True, False, True, False] and found[1][2] == 10
    monkeypatch.setattr(op, "TOKENS", 1)
    assert run(spark, rows, bench) == plain(rows, bench)


def test_awkward_rows(spark):
    bench = [(1, "One short text"), (2, ""), (3, None), (4, "tabs and lines and more"), (5, "same words")]
    assert run(spark, awkward(), bench) == plain(awkward(), bench)
    assert run(spark, awkward(), []) == plain(awkward(), [])
    assert run(spark, [], bench) == []


def test_plan_has_no_python(spark):
    rows, bench = corpus(3)
    plan = op.report(docs(spark, rows), items(spark, bench))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
