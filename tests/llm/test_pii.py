import hashlib
import math
import random
import re

import pyarrow as pa

from graphlens.llm import common as C, op3_pii as op

from .helpers import WORD, awkward, docs, fold

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    text = text or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_patterns_by_plain_regex():
    rng = random.Random(1)
    pieces = ["a@b.c", "@", "x.y@z-1.com.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (706) 555-3138", "+12", "++49 30 1234567-", " ", ".", "-", "é", "\U0001f600", "0", "99", "a", "%", "\n", "000.0001.1.1"]
    for _ in range(5000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert op.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "+" * 300_000, "a@" * 100_000, "+1" + " " * 200_000, "1.1." * 60_000):
        assert isinstance(op.base_spans(text), list)


def rows_with_terms():
    # `zanzibar` stands beside one address in five different texts, and nowhere else.
    out = [(i, f"some text number{i} here zanzibar ann@corp.example then more words{i}", "a") for i in range(5)]
    out += [(10 + i, f"plain text about some other things here number{i} and then more", "a") for i in range(200)]
    out += [(500, "the word zanzibar alone, at café zanzibar", "a")]
    return out


def test_disclosing_terms(spark):
    df = docs(spark, rows_with_terms())
    C.tune(spark)
    got = {r.doc_id: r for r in op.find(df.select("doc_id", "text"), op.disclosing_terms(df)).collect()}
    text = dict((i, t) for i, t, _ in rows_with_terms())
    assert got[0].n_term == 1 and got[0].n_spans == 2 and got[500].n_term == 2
    at = [m.span() for m in re.finditer("zanzibar", text[500])]
    assert got[500].spans == ",".join(f"term:{a}:{b}" for a, b in at)
    assert got[500].base_sha256 == hashlib.sha256(b"").hexdigest() and got[500].n_email == 0
    a, b = re.search("ann@corp.example", text[0]).span()
    assert got[0].spans.split(",")[0] == f"email:{a}:{b}" and got[0].n_email == 1
    assert all(got[10 + i].spans == "" for i in range(200))


def plain_disclosures(rows):
    """Every disclosing word, from dictionaries of documents."""
    tokens = re.compile(WORD.pattern)
    near, at, docs_of = {}, {}, {}
    for k, (_, text, _) in enumerate(rows):
        text = text or ""
        words = [(m.start(), m.end(), fold(m[0])) for m in tokens.finditer(fold(text))]
        for w in words:
            docs_of.setdefault(w[2], set()).add(k)
        for kind, a, b in op.entity_spans(text):
            left, right = [w for w in words if w[1] <= a][-op.CONTEXT :], [w for w in words if w[0] >= b][: op.CONTEXT]
            around = tuple(w[2] for w in left + right)
            for e in (kind, (kind, text[a:b].lower())):
                at.setdefault(e, set()).add(k)
                for t in set(around):
                    near.setdefault((e, t), {}).setdefault(k, around)
    out = set()
    for (e, t), seen in near.items():
        share = len(seen) / len(docs_of[t])
        if len(set(seen.values())) >= op.SUPPORT and share >= op.CONFIDENCE and math.log2(share * len(rows) / len(at[e])) >= op.GAIN_BITS:
            out.add(t)
    return out


def test_disclosing_terms_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{min(rng.randrange(400), rng.randrange(400))}"
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randint(0, 40))]
        if i % 9 == 0:
            w[len(w) // 2 : len(w) // 2] = ["mail", rng.choice(["Ann", "Bob"]), f"{rng.choice('abc')}@x.example"]
        if i % 13 == 0:
            w += ["Token", "=", '"' + "".join(rng.choices("0123456789abcdef", k=40)) + '"']
        if i % 50 == 1:
            w += ["token", "mail"]
        rows.append((i, " ".join(w), "a"))
    want = plain_disclosures(rows)
    assert {"token"} <= want and len(want) >= 3
    hashed = C.words(*C.flat(pa.array([" ".join(sorted(want))])))[3] >> C.U64(64 - C.TERM_BITS)
    assert {r.term for r in op.disclosing_terms(docs(spark, rows)).collect()} == set(hashed.tolist())


def test_secrets():
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'x token = "{secret}" and {"a" * 40} {"1" * 30} ab1 long-but-plain-words-in-a-row {"a1" * 20}'
    assert [text[a:b] for _, a, b in op.entity_spans(text)] == [secret]
    assert op.secret_spans(f"{secret}", [(0, 3, 9)]) == []


def test_term_path_beyond_the_broadcast(spark, monkeypatch):
    df = docs(spark, rows_with_terms())
    C.tune(spark)
    terms = C.materialize(op.disclosing_terms(df), "t")
    want = sorted(map(tuple, op.find(df, terms).collect()))
    monkeypatch.setattr(op, "TERM_LIMIT", 0)
    assert sorted(map(tuple, op.find(df, terms).collect())) == want


def test_sanitize(spark):
    df = docs(spark, rows_with_terms())
    out = {r.doc_id: r for r in op.sanitize(df).collect()}
    assert out[500].text == "the word [TERM] alone, at café [TERM]"
    assert "[EMAIL]" in out[0].text and out[0].bucket == "x"
    assert out[12].text == dict((i, t) for i, t, _ in rows_with_terms())[12]


def test_awkward_rows(spark):
    df = docs(spark, awkward())
    C.tune(spark)
    got = op.find(df, op.disclosing_terms(df)).collect()
    assert len(got) == len(awkward())
    assert all(r.spans == "" for r in got)
    assert sorted(str(r.text) for r in op.sanitize(df).collect()) == sorted(str(t) for _, t, _ in awkward())


def test_empty_table(spark):
    df = docs(spark, [])
    C.tune(spark)
    assert op.find(df, op.disclosing_terms(df)).collect() == []
