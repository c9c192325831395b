"""Groups of several hundred copies against brute force, also in the pipeline's stage."""

import random

from oreflow.llm import ngram_join


def _brute(rows):
    """The smallest id of each component, by comparing all pairs of different texts."""
    sets, head = {}, {}
    for i, x in sorted(rows):
        s = frozenset(ngram_join.shingle_set(x).tolist())
        head.setdefault(s, i)
        sets[i] = s
    up = {s: s for s in head}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    distinct = list(head)
    for a in range(len(distinct)):
        for b in range(a):
            x, y = distinct[a], distinct[b]
            if ngram_join.enough(len(x & y), len(x), len(y)):
                up[root(x)] = root(y)
    least = {}
    for s, i in head.items():
        least[root(s)] = min(i, least.get(root(s), i))
    return {i: least[root(s)] for i, s in sets.items()}


def _heavy_rows():
    """Copies of one text, whose class has the salt residue 0, and near copies, one of each two of which has it too."""
    rnd, rows, at = random.Random(4), [], 0
    residue = lambda x: ngram_join.class_of(ngram_join.shingle_set(x)) % ngram_join.SALTS
    for group in range(4):
        zero = group % 2 == 0
        while True:
            words = [f"g{group}w{rnd.randint(0, 10**6)}" for _ in range(100)]
            if (residue(" ".join(words)) == 0) == zero:
                break
        rows += [(at + i, " ".join(words)) for i in range(400)]
        at += 400
        near = 0
        while near < 2:
            w = list(words)
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 10**6)}"
            if (residue(" ".join(w)) == 0) != zero:
                rows.append((at, " ".join(w)))
                at, near = at + 1, near + 1
    return rows + [(at + i, " ".join(f"o{rnd.randint(0, 10**6)}" for _ in range(60))) for i in range(20)]


def test_heavy_copy_groups(spark):
    rows = _heavy_rows()
    want = _brute(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(df).collect()} == want


def test_pipeline_stage_keeps_one_of_each_component(spark):
    import corpus_pipeline

    rows = _heavy_rows()
    want = set(_brute(rows).values())
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want


def _as_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_one_shingle_in_thousands_of_unlinked_classes(spark):
    """A passage in most short texts, too little of each to link them, and a few pairs that do link."""
    rnd = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(24))
    rows = []
    for i in range(3000):
        own = " ".join(f"u{rnd.randint(0, 10**7)}" for _ in range(rnd.randint(12, 20)))
        rows.append((i, f"{passage} {own}"))
        if i % 300 == 0:
            rows.append((10_000 + i, f"{passage} {own} end"))
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(_as_frame(spark, rows)).collect()} == _brute(rows)


def test_crowds_and_large_components(spark, monkeypatch):
    """Chains of near copies whose groups hold several components, with small blocks, against brute force."""
    for name, value in (("LARGE", 2), ("CROWD", 3), ("BLOCK", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.choice((1, 2, 3, 4, 5))):
            at = rnd.randrange(70)
            w[at : at + rnd.randint(1, 8)] = [f"x{rnd.randint(0, 60)}"]
        rows.append((i, " ".join(w)))
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(_as_frame(spark, rows)).collect()} == _brute(rows)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    text = lambda seed: " ".join(f"t{random.Random(seed * 1000 + i).randint(0, 10**6)}" for i in range(40))
    near = text(1) + " more"
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, near), (2, text(3)), (3, text(3)), (4, ""), (4, ""), (5, None), (None, text(1))]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.representatives(_as_frame(spark, rows)).collect())
    assert got == sorted([(1, text(1)), (1, text(2)), (2, text(3)), (4, ""), (4, ""), (5, ""), (0, text(1))])
