"""Personal data, collocations and fill-in-middle forms against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oreflow.llm import collocations, common, fill_in_middle, personal_data

SF = "/root/testdata/sf0.001"

# -- personal data --------------------------------------------------------------

FORMS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_seeds(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, form in enumerate(FORMS):
        for m in form.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [
                True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15,
            ][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="a.@+- (019%é\n,", max_size=60))
def test_base_spans_of_any_text(text):
    assert personal_data.seeds(text) == plain_seeds(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "999.1.1.1.2.3.4.5", "a@b.c", "@", "x%d@e-f.gh", "+1 (234) 555-0199", " ", "-", ".", "é", "+", "1"]), max_size=14).map("".join))
def test_base_spans_of_near_forms(text):
    assert personal_data.seeds(text) == plain_seeds(text)


def test_long_words_and_digits_take_linear_time():
    for text in ("a" * 3_000_000, "1" * 3_000_000, "1." * 1_000_000, "+1 " * 500_000, "a@" * 500_000, "1 " * 1_000_000, "x" * 2_000_000 + "@b.c"):
        base = personal_data.seeds(text)
        assert len(personal_data.candidates(text, base)) >= 0
    assert personal_data.seeds("x" * 100_000 + "@b.c") == [(0, 0, 100_004)]


def told(spans) -> str:
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans))


def plain_spans(texts: list[str]) -> list[tuple[list, list]]:
    """The bootstrapping with sets and dictionaries."""
    found = [personal_data.mentions(t, plain_seeds(t)) for t in texts]
    base_of, of = {}, defaultdict(set)
    for m in (m for own in found for m in own):
        for p in m["patterns"]:
            edge = (m["kind"], p, m["key"])
            base_of[edge] = base_of.get(edge, False) or m["base"]
    for (kind, p, key), base in base_of.items():
        of[p].add((kind, key, base))
    graph = {}
    for p, own in of.items():
        for k in range(4):
            seeds, others = (sum(1 for kind, _, b in own if kind == k and b == want) for want in (True, False))
            if seeds >= personal_data.LEAST_SEEDS and others and seeds + others >= personal_data.ACCEPT * (len(own) + 1):
                graph[k, p] = (seeds, len(own), {key for kind, key, b in own if kind == k and not b})
    score, sure = defaultdict(float), {}
    for _ in range(personal_data.ROUNDS):
        sure = {at: (n + sum(score[at[0], x] for x in keys)) / (size + 1) for at, (n, size, keys) in graph.items()}
        score = defaultdict(float)
        for at, (_, _, keys) in graph.items():
            for x in keys:
                score[at[0], x] = max(score[at[0], x], sure[at])
    out = []
    for own in found:
        base = [(m["kind"], m["start"], m["end"]) for m in own if m["base"]]
        added = [
            (m["kind"], m["start"], m["end"]) for m in own
            if not m["base"] and any(sure.get((m["kind"], p), 0) >= personal_data.ACCEPT for p in m["patterns"])
        ]
        out.append((base, added))
    return out


def contexts() -> list[str]:
    """Seeds in telling contexts, unseen identifiers in the same, and numbers in others."""
    texts = [f"Please call me at +1 (555) 010-{1000 + i} before noon, Ms {i}" for i in range(14)]
    texts += ["Please call me at 555 0199 432 before noon", "He paid 5550199431 coins", "Then call me at (555) 010-2000 before noon"]
    texts += [f"the card number {4000000000000000 + i} expires" for i in range(300) if luhn(str(4000000000000000 + i))][:25]
    texts += ["the card number 1234567890123456 expires", "order 1234567890123456 was sent", "order 2234567890123456 was sent"]
    texts += [f"mail to user{i}@mail.example.com now" for i in range(12)] + ["mail to root@localhost now", "see root@localhost there"]
    return texts + [f"serial {i}{i}7 of {i * 31}" for i in range(40)] + texts[:3] * 5


def test_contexts_discover_unseen_identifiers(spark):
    texts = contexts()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, row int").repartition(3)
    got = {r["doc_id"]: r for r in personal_data.digests(docs).collect()}
    want = plain_spans(texts)
    assert {i: got[i]["spans"] for i in got} == {i: told(b + a) for i, (b, a) in enumerate(want)}
    added = {texts[i][a:z] for i, (_, more) in enumerate(want) for _, a, z in more}
    assert {"555 0199 432", "1234567890123456", "root@localhost"} <= added
    assert got[texts.index("He paid 5550199431 coins")]["spans"] == "" and got[texts.index("order 2234567890123456 was sent")]["spans"] == ""


def test_personal_data_of_the_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ids = list(texts)
    want = {i: (b, a) for i, (b, a) in zip(ids, plain_spans([texts[i] for i in ids]), strict=True)}
    for r in personal_data.query(spark, "/root/testdata/sf0.01").collect():
        base, added = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(x == n for x, _, _ in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest() and r["spans"] == told(base + added)


def test_personal_data_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "a@b.c", 3), (2, "a@b.c", 3), (3, "💥 1.2.3.4 💥 a@b.c", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mentions int")
    got = sorted(((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["spans"]) for r in personal_data.digests(docs).collect()))
    assert got == [(-1, 0, 0, ""), (1, 0, 0, ""), (2, 1, 0, "email:0:5"), (2, 1, 0, "email:0:5"), (3, 1, 1, "email:12:17,ip:2:9")]
    assert personal_data.digests(docs.limit(0)).count() == 0


# -- collocations ------------------------------------------------------------------


def plain_collocations(rows, least, longest, top, within=100):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    often = {key: n for key, n in count.items() if n >= least}
    out = defaultdict(list)
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        n = total[lang]
        score, _, left, right = min((1000 * a * n // ((x := often[lang, w[:c]]) * (y := often[lang, w[c:]])), c, x, y) for c in range(1, len(w)))
        held = any(g == lang and len(v) > len(w) and 100 * f >= within * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), f in often.items())
        if not held:
            out[lang].append((-score, -a, " ".join(w).encode(), left, right, n))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n, -s) for lang, own in out.items() for i, (s, a, p, left, right, n) in enumerate(sorted(own)[:top])
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.mark.parametrize(("least", "longest", "top"), [(2, 5, 7), (3, 3, 1000), (40, 5, 5)])
def test_collocations_agree_with_counting(spark, least, longest, top):
    rows = [(r["lang"], r["text"]) for r in common.table(spark, SF, "documents").limit(60).collect()]
    rows += [(None, "A b A b. a b\ta  b\nA b"), (None, "a b a b a b"), ("x", None), ("x", ""), ("x", "... ,, \x0b \x0c"), ("x", "ü Ü É   ü Ü É")] * 3
    got = sorted(map(tuple, collocations.collocations(frame(spark, rows).repartition(3), least, longest, top).collect()))
    assert got == plain_collocations(rows, least, longest, top)


def test_collocations_lose_nothing_at_seams(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 16)
    rows = [("en", "the cat sat on the mat the cat sat on a hat, the cat sat; " * 20 + "x" * 70 + " the cat sat on"), ("de", "der der der der " * 9), ("en", "the cat")]
    text = frame(spark, rows).coalesce(1)
    whole = [r for r in text.select("lang", "text").toArrow().to_batches()]
    for size in range(1, 6):
        bits = collocations._bitmap(frame_of(spark, rows, size - 1)) if size > 1 else None
        got = Counter()
        for part in collocations._given_out(iter(whole), size, bits):
            for lang, phrase, n in zip(part["lang"].to_pylist(), part["phrase"].to_pylist(), part["n"].to_pylist(), strict=True):
                got[lang, phrase] += n
        want = Counter()
        for lang, t in rows:
            for piece in re.split("[.,;]", t):
                w = piece.split()
                want.update((lang, " ".join(w[i : i + size])) for i in range(len(w) - size + 1))
                want[lang, None] += len(w) * (size == 1)
        assert got == +want


def frame_of(spark, rows, size):
    found = set()
    for lang, t in rows:
        for piece in re.split("[.,;]", t):
            w = piece.split()
            found |= {(lang, " ".join(w[i : i + size])) for i in range(len(w) - size + 1)}
    return spark.createDataFrame(sorted(found), "lang string, phrase string")


def test_collocations_with_a_crowded_bitmap(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 15)
    monkeypatch.setattr(collocations, "FEWEST_BITS", 15)
    rows = [("en", " ".join(f"w{(i * i + k) % 977} v{i % 13}" for i in range(4000))) for k in range(3)]
    got = sorted(map(tuple, collocations.collocations(frame(spark, rows), 3, 4, 500).collect()))
    assert got == plain_collocations(rows, 3, 4, 500)


def test_collocations_edges(spark):
    empty = collocations.collocations(frame(spark, []))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0
    rows = [("a", "x y " * 60)] * 2 + [("b", "x y " * 60)]
    docs = frame(spark, rows).selectExpr("*", "1 AS n", "'q' AS phrase", "2 AS key", "3 AS rank")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain_collocations(rows, 100, 5, 2000)


def test_scores_past_64_bits_are_exact(spark):
    a, n = 3 * 10**11 + 7, 5 * 10**12 + 3
    level = [("en", "p", 10**12 + 1), ("en", "q", 7 * 10**11 + 3), ("en", "p q", a)]
    rows = spark.createDataFrame(level, "lang string, phrase string, n bigint")
    old = collocations.levels
    collocations.levels = lambda *_: ([rows.where("phrase != 'p q'"), rows.where("phrase = 'p q'")], spark.createDataFrame([("en", n)], "lang string, n bigint"))
    try:
        got = collocations.collocations(frame(spark, [])).first()
    finally:
        collocations.levels = old
    assert got["score"] == 1000 * a * n // ((10**12 + 1) * (7 * 10**11 + 3))


# -- fill-in-middle ------------------------------------------------------------------


def plain_form(doc_id, text):
    text = text or ""
    t = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, text
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(t), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def hostile_texts():
    pool = ["", None, "<", "<P", "a<P>b", "x<S>", "<M>", "P>S>M>", "é\u0000ü\n\r\t", "💥💥 ab́c", "<S" * 50, "S>P>" * 50, " ", "abc", "a" * 5000, "ab1" * 4000, "  "]
    return [(None if i % 41 == 7 else i % 300, pool[i % len(pool)]) for i in range(400)]


def test_fill_in_middle_forms(spark):
    rows = hostile_texts() + [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, n int, batch int").repartition(3)
    found = fill_in_middle.transformed(docs).cache()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((i, *plain_form(i, t)) for i, t in rows), key=key)
    assert sorted(map(tuple, fill_in_middle.restored(found).collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert {r["form"] for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(docs.limit(0)).count() == 0


def test_fill_in_middle_digests_and_long_text(spark):
    rows = [(5, "word, " * 700_000), (6, "z" * 3_000_000), (8, "short one")]
    got = {r["doc_id"]: r for r in fill_in_middle.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        n, form, p, m, out = plain_form(i, t)
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(t.encode()).hexdigest()
