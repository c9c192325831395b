"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oreflow.llm import chat_format, chunk_encoding, common, html_extraction, language_id, ngram_join, packing, phrase_fingerprint, quality_model, quality_rules, token_output, tokens

DIR = "/root/testdata/sf0.001"
BYTES, WORDS = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, n int"
ODD = [
    None, "", " ", "a", "a b", "é  ü\t\n\n x ", "<|endoftext|>", "x" * 5000,
    "one two three four five six seven eight nine ten eleven. " * 400, "The the THE the the",
]


def _docs(spark, texts):
    return spark.createDataFrame([(i, x, None, None, None, 0.0, "k", 1) for i, x in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long and repeated texts, ties, a null id, columns whose names clash with results."""
    again = _docs(spark, ODD).where("doc_id = 8")
    return _docs(spark, ODD).union(again).union(spark.createDataFrame([(None, "no id here at all", None, None, 3, None, None, None)], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DIR, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_pieces_encode_as_the_whole_text():
    rnd = random.Random(5)
    signs = [*"ab' \n\té1!<|'s.,", "  ", " \n", "<|endoftext|>", "\0", "́", "Σ", "İ", "\x1c", "\x85", "漢", "😀", "word", "Word,"]
    some = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    for path in (BYTES, WORDS):
        e = tokens.encoder(path)
        assert e.encode(some) == [e.direct(x) for x in some]


def test_repair_equals_whole_encoding(monkeypatch):
    rnd = random.Random(6)
    e = tokens.encoder(BYTES)
    some = ["".join(rnd.choice(["ab", " ", "\n", "é", "cd ", "...", "1"]) for _ in range(rnd.randint(1, 80))) for _ in range(800)]
    monkeypatch.setattr(chunk_encoding.chunk_starts, "__defaults__", (6, 2, 20))
    for x in some:
        parts = chunk_encoding.chunks(x)
        assert "".join(parts) == x
        for reach in (3, chunk_encoding.REACH):
            assert chunk_encoding.join_ids(e.encode(parts), e.direct, tokens.byte_table(BYTES), reach) == e.direct(x)
    signs = ["<|endoftext|>", "'s", "'", "  ", " ", "\n", "\n\n", "漢字", "。", "😀", "aaaa", "xyz", "7", "ll", "\t", "é", ".'"]
    for _ in range(3000):
        x = "".join(rnd.choice(signs) * rnd.choice((1, 1, 1, 2, 30)) for _ in range(rnd.randint(1, 40)))
        assert chunk_encoding.join_ids(e.encode(chunk_encoding.chunks(x)), e.direct, tokens.byte_table(BYTES)) == e.direct(x)


def test_repair_of_texts_without_blanks():
    rnd = random.Random(7)
    e, table = tokens.encoder(BYTES), tokens.byte_table(BYTES)
    letters = "".join(chr(0x4E00 + rnd.randint(0, 3000)) for _ in range(400))
    for x in (
        "".join(rnd.choice(letters) for _ in range(300_000)), "x" * 300_000, " " * 60_000 + "a",
        "".join(rnd.choice("abcdefgh") for _ in range(1_000_000)),
    ):
        times = []
        for size in (len(x) // 8, len(x)):
            parts = e.encode(chunk_encoding.chunks(x[:size]))
            began = time.process_time()
            got = chunk_encoding.join_ids(parts, e.direct, table)
            times.append(time.process_time() - began)
            assert got == e.direct(x[:size])
        assert times[1] < 40 * times[0] + 0.5


def test_chunk_encoding(spark, docs, odd, empty):
    e = tokens.encoder(BYTES)
    for df in (docs, odd):
        want = Counter((r["doc_id"], e.direct(r["text"] or "")) for r in df.collect())
        ids = chunk_encoding.encoded(df, BYTES)
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in ids.collect()) == want
        assert Counter(tuple(r) for r in chunk_encoding.decoded(ids, BYTES).collect()) == Counter((r["doc_id"], r["text"] or "") for r in df.collect())
    assert chunk_encoding.encoded(empty, BYTES).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 30_000).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    edges = np.sort(rng.choice(len(ids) - 1, 400, replace=False))
    ends[edges] = ends[-1] = True
    symbols, last, rules, lengths = token_output.compress(ids, ends, 10)
    assert len(symbols) < len(ids) / 1.5 and last.sum() == ends.sum()
    assert (token_output.expand(symbols, 10, rules, lengths) == ids).all()
    shard = {
        "rules": rules.astype("<u4").tobytes(), "rule_lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(),
        "base": 10, "symbols_per_doc": np.diff(np.r_[-1, np.flatnonzero(last)]).tolist(),
    }
    starts = np.r_[0, np.flatnonzero(ends) + 1]
    for d in (0, 7, 399):
        own = ids[starts[d] : starts[d + 1]]
        for a, b in ((0, len(own)), (1, 5), (len(own) - 1, len(own)), (3, 3)):
            assert (token_output.read_span(shard, d, a, b) == own[a:b]).all()


def test_token_output(spark, docs, odd, empty):
    e = tokens.encoder(BYTES)
    for df in (docs, odd):
        token_output.write(df, path := common.fresh_path(spark, "t"), BYTES, 2, block_ids=3000)
        got = sorted((
            r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"],
        ) for r in token_output.documents(token_output.read(spark, path)).collect())
        want, at = [], 0
        for i, x in sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            raw = e.direct(x) + b"\2\0\0\0"
            want.append((at, i, len(raw) // 4, zlib.crc32(raw)))
            at += len(raw) // 4
        assert got == want
    token_output.write(empty, path := common.fresh_path(spark, "t"), BYTES, 2)
    assert token_output.documents(token_output.read(spark, path)).count() == 0


def test_packing(spark, docs, odd, empty):
    e = tokens.encoder(WORDS)
    for df, size in ((docs, 4096), (odd, 64)):
        rows = packing.packed(df, WORDS, capacity=size).collect()
        want = Counter()
        for r in df.collect():
            raw = e.direct(r["text"] or "") + b"\1\0\0\0"
            want.update((r["doc_id"], k, a // 4, len(p) // 4, zlib.crc32(p)) for k, a in enumerate(range(0, len(raw), 4 * size)) for p in [raw[a : a + 4 * size]])
        assert Counter(tuple(r)[:5] for r in rows) == want
        by = defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in by.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= size
        assert len(by) <= 1.05 * sum(r["length"] for r in rows) / size + 2
    assert packing.packed(empty, WORDS).count() == 0


def _repeats(w):
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)})


def test_quality_rules(spark, docs, odd, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good = quality_rules.trusted(spark, DIR)
    for df in (docs, odd, odd.withColumn("_w", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("N_WORDS", F.lit(3))):
        for r in quality_rules.judged(df, good).collect():
            t = r["text"] or ""
            w = word.findall(t)
            lines = [x for x in t.split("\n") if word.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
                len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), _repeats(w),
            )
            assert r["base_failed"] == (len(w) < 10 or 100 * _repeats(w) > 20 * len(w)) and r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    assert quality_rules.judged(empty, good).count() == 0
    found = quality_rules.with_verdict(odd, good, "verdict")
    assert found.columns == [*odd.columns, "verdict"] and found.drop("verdict").exceptAll(odd).isEmpty()


def test_ratio_of_the_rules(spark, docs):
    got = quality_rules.ratios(docs, quality_rules.trusted(spark, DIR), 64)
    good = {r["doc_id"] for r in quality_rules.trusted(spark, DIR).collect()}
    raw, target = Counter(), Counter()
    for r in docs.collect():
        g = [zlib.crc32(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        own = Counter([x % 64 for x in g] + [64 + (a * 31 + b) % 64 for a, b in zip(g, g[1:], strict=False)])
        raw.update(own)
        if r["doc_id"] in good:
            target.update(own)
    for half in (range(64), range(64, 128)):
        t, n = sum(target[b] for b in half), sum(raw[b] for b in half)
        for b in half:
            assert abs(got[b] - np.log((target[b] + quality_rules.SMOOTHING) / (raw[b] * t / n + quality_rules.SMOOTHING))) < 1e-9


def test_quality_model(spark, odd, empty):
    where = "/root/testdata/sf0.1"
    rows = quality_model.query(spark, where).join(common.table(spark, where, "labels"), "doc_id").where("held_out").collect()
    bad, good = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] == 1 for r in good) / len(good) > 0.97 and sum(r["predicted"] == 0 for r in bad) / len(bad) > 0.9
    model = quality_model.train(common.table(spark, DIR, "documents"), common.table(spark, DIR, "labels"))
    out = quality_model.scored(odd, model, "quality_score")
    assert out.count() == odd.count() and out.where("quality_score between 0 and 1").count() == odd.count()
    assert quality_model.scored(empty, model).count() == 0
    # An id with many rows counts once in the fit, and ids may be text.
    rows = common.table(spark, DIR, "documents")
    many = quality_model.train(rows.union(rows).union(rows), common.table(spark, DIR, "labels"))
    assert np.allclose(many.w, model.w) and np.allclose(many.v, model.v)
    named = quality_model.train(
        rows.withColumn("doc_id", F.col("doc_id").cast("string")),
        common.table(spark, DIR, "labels").withColumn("doc_id", F.col("doc_id").cast("string")),
    )
    assert np.allclose(named.w, model.w)
    long = _docs(spark, ["one two three " * 300_000])
    assert 0 <= quality_model.scored(long, model, "n").first()["n"] <= 1
    none = quality_model.train(common.table(spark, DIR, "documents"), common.table(spark, DIR, "labels").where("false"))
    assert {round(r["score"], 6) for r in quality_model.scored(odd, none).collect()} == {1.0}


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality_model.Model(0.1, rng.normal(size=quality_model.DIMS), rng.normal(size=(quality_model.DIMS, 4)), np.zeros(1), np.ones(1))
    d, x = np.array([3, 8, 90, 4000]), rng.normal(size=4)
    pairs = sum(m.v[d[i]] @ m.v[d[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(m.raw_score(d, x, np.array([0]))[0][0] - (0.1 + m.w[d] @ x + pairs)) < 1e-9


def _components(rows):
    sets, where = {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in where[s]).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs, odd, empty):
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(120)]
    made = []
    for i in range(60):  # copies with more and more changed words, some linked by others only
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 5)}"
        made.append((1000 + i, " ".join(w)))
    made += [(2000 + i, " ".join(base[:40]) + " " + " ".join(f"z{rnd.random()}" for _ in range(60))) for i in range(30)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id bigint, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == _components([tuple(r) for r in df.collect()])
    out = [(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(odd).collect()]
    assert len(out) == odd.count() and (None, None) in out
    kept = ngram_join.representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 1
    assert ngram_join.near_duplicates(empty).count() == 0


def test_prefix_tree():
    rnd = random.Random(2)
    sets = [sorted(rnd.sample(range(40), rnd.randint(1, 30)), reverse=True) for _ in range(300)]
    tree = ngram_join.PrefixTree([])
    for k, s in enumerate(sets):
        tree.add(s, k)
    for s in sets[:60]:
        want = {k for k, o in enumerate(sets) if ngram_join.enough(len({*s} & {*o}), len(s), len(o))}
        assert set(tree.linked(set(s))) == want


def test_chat_windows(spark, empty):
    rnd = random.Random(3)
    signs = ["<", "|", "\\", "</s>", "[INST]", "<|end|>", "\n", "|>", "<|user|>", "<\\|", "é", "assistant"]
    for _ in range(3000):
        x, y = ("".join(rnd.choice(signs) for _ in range(rnd.randint(0, 8))) for _ in range(2))
        assert chat_format.unescape(chat_format.escape(x)) == x and not any(m in chat_format.escape(x) for m in chat_format.MARKS)
        w = chat_format.write_turn(y, x)[0] + chat_format.write_turn("user", y)[0]
        assert [t[:2] for t in chat_format.read_turns(w)] == [(y, x), ("user", y)]
    rows = [
        (1, 0, "system", "be kind"), *[(1, i, "user" if i % 2 else "assistant", f"word{i} " * 60) for i in range(1, 30)],
        (2, 0, None, None), (2, 0, "assistant", "hi"), (2, 0, "assistant", "hi"), (None, 1, "assistant", "x"),
        (3, 1, "assistant", "long " * 4000),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    w = chat_format.windows(turns, BYTES, budget=600, history=135)
    later = [r for r in w.where("conv_id = 1").collect() if r["window"]]
    assert later and all(chat_format.read_turns(r["text"])[0][:2] == ("system", "be kind") and r["n_repeated"] > 1 for r in later)
    got = {r["conv_id"]: r for r in chat_format.read_back(w).collect()}
    by = defaultdict(list)
    for c, t, role, x in rows:
        by[c].append((t, role or "", x or ""))
    for c, own in by.items():
        said = "".join(x for _, role, x in sorted(own) if role == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(said) and got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in sorted(own)).encode()).hexdigest()
    assert chat_format.windows(turns.where("false"), BYTES).count() == 0
    extra = turns.withColumn("n", F.lit("x")).withColumn("window", F.lit(1)).withColumn("loss_starts", F.lit(2))
    assert chat_format.windows(extra, BYTES, budget=600, history=135).exceptAll(w).isEmpty()


def test_no_window_is_over_its_budget(spark, monkeypatch):
    rnd, e = random.Random(4), tokens.encoder(BYTES)
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 30)):
            role = "system" if t == 0 and rnd.random() < 0.6 else rnd.choice(("user", "assistant"))
            rows.append((c, t, role, " ".join(rnd.choice(("word", "</s>", "[INST]", "é")) for _ in range(rnd.choice((0, 3, 20, 60, 150))))))
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for budget, history, span in ((100, 30, 16), (200, 500, 1), (60, 0, 2), (100, 90, 1)):
        monkeypatch.setattr(chat_format, "SPAN", span)
        back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.windows(turns, BYTES, budget, history)).collect()}
        for c in range(40):
            own = [(role, x) for i, _, role, x in rows if i == c]
            assert back[c]["n_turns"] == len(own)
            assert back[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
            assert back[c]["loss_sha256"] == hashlib.sha256("".join(x for r, x in own if r == "assistant").encode()).hexdigest()
        for r in chat_format.windows(turns, BYTES, budget, history).collect():
            parts = chat_format.read_turns(r["text"])
            assert r["n_tokens"] == len(e.direct(r["text"])) // 4
            assert r["n_tokens"] <= budget or len(parts) == 1
            repeated = parts[: r["n_repeated"]]
            if r["window"] and repeated and repeated[0][0] == "system":
                repeated = repeated[1:]
            assert sum(len(e.direct(chat_format.write_turn(role, x)[0])) // 4 for role, x, _, _ in repeated) <= history


def test_fingerprints(spark, docs, texts, odd, empty):
    got = {r["doc_id"]: r for r in phrase_fingerprint.with_next(docs).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        x, y = texts[i], texts[order[(k + 1) % len(order)]]
        q = len(x) // 4
        e = x[: len(x) - q] + y[:q]
        a, b, c = (phrase_fingerprint.Parsed(t).sig for t in (x, e, y))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (
            len(x), hashlib.sha256(e.encode()).hexdigest(), phrase_fingerprint.text_form(a), phrase_fingerprint.text_form(b),
        )
        assert (r["near_edited"], r["near_next"]) == (phrase_fingerprint.likeness(a, b), phrase_fingerprint.likeness(a, c))
    assert sum(r["near_edited"] for r in got.values()) > 3 * sum(r["near_next"] for r in got.values())
    assert phrase_fingerprint.with_next(odd).count() == odd.count()
    assert phrase_fingerprint.with_next(empty).count() == 0
    assert phrase_fingerprint.with_next(odd.where("doc_id = 4")).first()["near_next"] == 1.0
    end = phrase_fingerprint.END
    assert phrase_fingerprint.phrases("abababab") == ["a", "b", "ab", "aba", "b" + end]
    one = lambda x: phrase_fingerprint.text_form(phrase_fingerprint.Parsed(x).sig)
    assert len({one(x) for x in ("a", "aa", "abc", "abca", "abcab", "")}) == 6


def _lz78(text):
    """Phrases by the textbook: a growing dictionary, the end marked where it cuts a phrase."""
    known, out, at = set(), [], 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in known:
            n += 1
        if at + n > len(text):
            return [*out, text[at:] + phrase_fingerprint.END]
        known.add(text[at : at + n])
        out.append(text[at : at + n])
        at += n
    return out


def test_phrases_and_likeness_by_brute_force():
    rnd = random.Random(10)
    for _ in range(300):
        x, y = ("".join(rnd.choice("abé\n漢") for _ in range(rnd.randint(0, 60))) for _ in range(2))
        own = phrase_fingerprint.Parsed(x)
        assert own.own == _lz78(x)
        each = {p: phrase_fingerprint.phrase_hashes(p, [len(p)])[0] for p in own.own}
        assert {each[p] for p in own.own} == set(own.hashes.tolist()) and len(set(each.values())) == len(set(own.own))
        text, sig = own.edited(y)
        assert text == x[: len(x) - len(x) // 4] + y[: len(x) // 4]
        assert (sig == phrase_fingerprint.Parsed(text).sig).all()
    # The share of equal minima comes near the phrase sets' Jaccard likeness.
    x = "".join(rnd.choice("abcdefghij ") for _ in range(20_000))
    y = x[:12_000] + "".join(rnd.choice("klmnopqrst ") for _ in range(8_000))
    a, b = set(_lz78(x)), set(_lz78(y))
    near = phrase_fingerprint.likeness(phrase_fingerprint.Parsed(x).sig, phrase_fingerprint.Parsed(y).sig)
    assert abs(near - len(a & b) / len(a | b)) < 0.2


def test_extraction(spark):
    rows = common.table(spark, DIR, "pages").collect()
    got = {r["page_id"]: r["text"] for r in html_extraction.query(spark, DIR).collect()}
    import html

    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(x.replace("<br>", " ").replace("<b>", ""))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)
    m = html_extraction.default_model()
    assert html_extraction.main_text("", m) == "" and html_extraction.main_text("<div>" * 5000, m) == ""
    page = '<body><div class="menu"><a href=a>One</a> <a href=b>Two</a></div><div class="post"><h2>A title</h2><p>Some text of &eacute;nough words to read,\n with one <a href=c>link</a>.<p>And a second sentence, as long as the first one was.</div><div class="comments"><p>I liked it a lot, thank you all.</p></div><script>if (a<b) x="</p>"</script><footer><p>&copy; all rights.</p></footer>'
    assert html_extraction.main_text(page, m) == "A title\n\nSome text of énough words to read, with one link.\n\nAnd a second sentence, as long as the first one was."
    assert html_extraction.main_text(
        "<body><article><p>Formula <math>x=2</math> holds for all of them.</p><ul><li><a href=/a>See the first part of this report.</a></li><li>The second part is not out yet.</li></ul><p><a href=/b>The whole story is told here.</a></p></article></body>",
        m,
    ) == "Formula x=2 holds for all of them.\n\nSee the first part of this report.\n\nThe second part is not out yet.\n\nThe whole story is told here."
    odd = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5), (2, "u", "", 6)], "page_id bigint, url string, html string, text int")
    assert [(r["text"], r["n_chars"]) for r in html_extraction.extracted(odd).collect()] == [("", 0)] * 3


#: Pages written by hand, with names and structures that the labelled pages don't have in this form; § marks content.
HELD_OUT = [
    '<!doctype html><html><head><title>t</title></head><body class="home"><div id="page"><header id="top"><h2><a href="/">Valley Post</a></h2><nav class="navbar"><a href="/a">Town</a><a href="/b">Land</a></nav></header><div id="wrap"><main id="content"><h1>§Bees are back</h1><p>§The bees came back to the old orchard in May, three weeks before anyone had looked for them.</p><p>§Why?</p><h3>§A warm spring</h3><p>§No frost was seen after March, said the keeper, who has <a href="/k">kept a diary</a> since 1988.</p><ol><li>§<a href="/1">The diary of 1988, page by page</a></li><li>§The hives</li></ol><aside class="promo"><p>Honey at half price until Sunday!</p></aside><p>§More of them will come.</p></main><aside id="rail"><h4>Trending</h4><ul><li><a href="/x">Snow in June</a></li><li><a href="/y">Ten cheap meals</a></li></ul></aside></div><footer class="site-footer"><a href="/imprint">Imprint</a> &copy; Valley Post</footer></div></body></html>',
    '<html><body><div class="cookie-consent"><p>This site stores cookies. <button>OK</button></p></div><div class="layout"><div class="menu-bar"><ul><li><a href="#">Start</a></li><li><a href="#">Tools</a></li><li><a href="#">Help</a></li></ul></div><div class="post-body"><h1>§How to sharpen a saw</h1><p>§You need a file, a vice and some patience.</p><ul><li>§Fix the saw.</li><li>§File every second tooth, always from the same side.</li><li>§Turn it round and do the others.</li></ul><blockquote>§A sharp saw is a safe saw.</blockquote><pre>§angle = 60</pre><p>§That is all there is to it.</p></div><div id="discussion"><h3>3 replies</h3><div class="reply"><p>My grandfather did it just like this, thanks.</p></div><div class="reply"><p>60 is too steep for softwood if you ask me.</p></div></div><div class="newsletter-box"><p>Get one tip a week.</p><form><input><button>Subscribe</button></form></div></div><div class="legal"><p>© Tool Blog 2019</p></div></body></html>',
    '<html><body><nav role="navigation"><a href="/">Index</a> | <a href="/p">Papers</a></nav><article><header><h1>§On slow rivers</h1></header><section><h2>§Summary</h2><p>§Rivers that fall less than a metre in ten kilometres behave like lakes for most of the year.</p></section><section><h2>§Methods</h2><p>§We measured at six places, twice a day.</p><table><tr><th>§Place</th><th>§Depth</th></tr><tr><td>§A</td><td>§4 m</td></tr></table><figure><figcaption>§The six places.</figcaption></figure></section><noscript>Turn on scripts to see the map.</noscript></article><footer><p>All rights reserved.</p></footer></body></html>',
    '<html><body><div id="masthead"><p>Your friendly paper since 1890.</p></div><div id="main"><div class="story"><h1>§Fire on the hill</h1><p>§A barn burned down on Friday night.</p><div class="ad banner"><p>Insure your barn today, from 3 a month.</p></div><p>§Nobody was hurt; the cattle had been moved the week before.</p><p>§<a href="/old">The barn had burned before, in 1950.</a></p></div></div><div style="display:none"><p>You have used up your free articles this month.</p></div><div class="share"><a href="/f">Post</a> <a href="/m">Mail</a></div><div id="footer">Legal notice</div></body></html>',
]


def test_held_out_pages():
    from oreflow.llm import labelled_pages

    m = html_extraction.default_model()
    hits = wrong = lost = 0
    for page in [*HELD_OUT, *labelled_pages.made(200, 99)]:
        nodes = html_extraction.parse(page)
        want = [x.text.startswith("§") for x in nodes]
        html_extraction.label(nodes)
        for x, w, p in zip(nodes, want, m.marginals(nodes), strict=True):
            if x.name == "#text":
                hits += w and p > 0.5
                wrong += not w and p > 0.5
                lost += w and p <= 0.5
    assert hits / (hits + wrong) >= 0.97 and hits / (hits + lost) >= 0.97
    for page in HELD_OUT:
        want = [x.text[1:] for x in html_extraction.parse(page) if x.text.startswith("§")]
        got = html_extraction.main_text(page.replace("§", ""), m).split("\n\n")
        assert len(set(want) & set(got)) >= 0.9 * max(len(set(want)), len(set(got))), (set(want) ^ set(got))


def test_marginals_are_exact():
    """Against the sum over all labelings of a small page."""
    from itertools import product
    from math import exp

    m = html_extraction.default_model()
    nodes = html_extraction.parse('<div class="ad">Buy now</div><p>Text that is read here, long enough.</p>')
    total, content = 0.0, [0.0] * len(nodes)
    for s in product(range(3), repeat=len(nodes)):
        p = exp(m.root[s[0]])
        for k, x in enumerate(nodes[1:], 1):
            own = -30.0 if x.name == "#text" and s[k] == 1 else 0.0
            p *= m.between(x, nodes[x.parent])[s[x.parent]][s[k]] * exp(own + sum(v[s[k]] for v in m.evidence(x, nodes[x.parent])))
        total += p
        for k, v in enumerate(s):
            content[k] += p * (v == html_extraction.CONTENT)
    assert all(abs(a - b / total) < 1e-6 for a, b in zip(m.marginals(nodes), content, strict=True))


def test_languages(spark):
    rows = language_id.query(spark, DIR).collect()
    assert sum(f"/{r['lang']}/" in r["url"] for r in rows) / len(rows) > 0.95
    pages = spark.createDataFrame(
        [(1, None, None), (2, "https://x.example.org/a", "<html lang=fr><p>le la les des une pour que qui dans avec</p>")],
        "page_id bigint, url string, html string",
    )
    docs = common.table(spark, DIR, "documents")
    assert {r["page_id"]: r["text_lang"] for r in language_id.identified(pages, docs).collect()}[2] == "fr"
    assert language_id.identified(pages.where("false"), docs).count() == 0
    assert [r["lang"] for r in language_id.identified(pages, docs.where("false")).collect()] == [None, None]


def test_near_duplicates_of_a_larger_table(spark):
    df = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    want = _components([tuple(r) for r in df.collect()])
    duck = duckdb.connect()
    duck.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    assert {i: (n, c) for i, n, c in duck.sql(ngram_join.ORACLE_SQL).fetchall()} == want
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 20


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, DIR, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.saved(stage(spark, kept, DIR), name.replace(" ", "-"))
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    out = corpus_pipeline.run(spark, DIR)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_pipeline_by_brute_force(spark):
    """Scores, ratios and components of each stage worked out row by row, without the stages."""
    import corpus_pipeline

    docs = common.table(spark, DIR, "documents")
    rows = {r["doc_id"]: (r["text"] or "", r["n_chars"]) for r in docs.collect()}
    model = quality_model.train(docs, common.table(spark, DIR, "labels"))
    good = {i: t for i, (t, n) in rows.items() if model.score([quality_model.features(t, n)])[0] >= quality_model.THRESHOLD}
    trusted = {r["doc_id"] for r in quality_rules.trusted(spark, DIR).collect()}
    size, word = quality_rules.BUCKETS, re.compile(r"[^\x20\x09-\x0D]+")
    grams, raw, target = {}, Counter(), Counter()
    for i, t in good.items():
        g = [zlib.crc32(w.encode()) for w in word.findall(t)]
        grams[i] = [x % size for x in g] + [size + (a * 31 + b) % size for a, b in zip(g, g[1:], strict=False)]
        raw.update(grams[i])
        if i in trusted:
            target.update(grams[i])
    sums = [(sum(n for b, n in c.items() if (b >= size) == pair)) for pair in (False, True) for c in (raw, target)]
    prior = quality_rules.SMOOTHING
    ratio = lambda b: np.log((target[b] + prior) / (raw[b] * sums[2 * (b >= size) + 1] / sums[2 * (b >= size)] + prior))
    clean = {}
    for i, t in good.items():
        w = word.findall(t)
        score = float(np.mean([ratio(b) for b in grams[i]])) if grams[i] else 0.0
        assert abs(score - quality_rules.THRESHOLD) > 1e-5  # no text lies on the threshold
        if len(w) >= 10 and 100 * _repeats(w) <= 20 * len(w) and score >= quality_rules.THRESHOLD:
            clean[i] = t
    want = {i for i, (_, c) in _components(list(clean.items())).items() if i == c}
    assert 0 < len(want) < len(clean) < len(good) < len(rows)
    out = corpus_pipeline.run(spark, DIR).collect()
    assert {r["doc_id"] for r in out} == want
    e = tokens.encoder(WORDS)
    pieces = Counter()
    for i in want:
        ids = e.direct(rows[i][0]) + b"\1\0\0\0"
        pieces.update((i, k, a // 4, zlib.crc32(ids[a : a + 16384])) for k, a in enumerate(range(0, len(ids), 16384)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in out) == pieces


def test_pipeline_on_odd_rows(spark, odd, empty):
    """Nulls, empty and repeated rows, columns of any name; an empty table."""
    import corpus_pipeline

    more = odd.withColumn("_score", F.lit(1)).withColumn("verdict", F.lit("v")).withColumn("cls", F.lit(3)).withColumn("source", F.lit("s"))
    for df in (more, empty.withColumn("cls", F.lit(3))):
        kept = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = common.saved(stage(spark, kept, DIR), "odd")
            assert kept.columns == df.columns
            assert kept.exceptAll(df).isEmpty()
        assert corpus_pipeline.STAGES[-1][1](spark, kept, DIR).count() >= kept.count()


def test_one_long_conversation(spark):
    """All rows but a few in one conversation: it lies in several ranges and spans."""
    rnd = random.Random(15)
    rows = [(7, 0, "system", "be brief")] + [(7, t, ("user", "assistant")[t % 2], "word " * rnd.randint(0, 30)) for t in range(1, 6000)]
    rows += [(None, t, "assistant", f"x{t}") for t in range(50)] + [(9, 0, "assistant", "y"), (9, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat_format.windows(turns, BYTES, 256, 64)
    assert made.where("conv_id = 7 and window > 0 and not startswith(text, '<|system|>')").count() == 0
    assert made.where("n_tokens > 256").count() == 0
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    for c in (7, None, 9):
        own = [(role, x) for i, _, role, x in rows if i == c]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
