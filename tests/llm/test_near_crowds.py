"""Near copies of one text that miss the threshold share many rare shingles; only those within the bounds on places are compared."""

import random

import numpy as np
from oreflow.llm import common, ngram_join

from tests.llm.test_heavy_groups import _as_frame, _brute


def _edited(rnd, words, edits):
    w = list(words)
    for at in rnd.sample(range(len(w)), edits):
        w[at] = f"e{rnd.randrange(10**9)}"
    return " ".join(w)


def test_crowd_of_distant_copies_is_not_walked(spark, monkeypatch):
    rnd = random.Random(21)
    base = [f"b{k}" for k in range(400)]
    rows = list(enumerate([_edited(rnd, base, rnd.randrange(13, 17)) for _ in range(250)] + [_edited(rnd, base, 5) for _ in range(4)]))
    walked = []

    def walk(found, sets, own=ngram_join._walked):
        walked.append(found.count())
        return own(found, sets)

    monkeypatch.setattr(ngram_join, "_walked", walk)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(_as_frame(spark, rows)).collect()}
    assert got == _brute(rows)
    assert sum(walked) <= 500  # 16,426 before


def test_rows_that_can_link_stay(spark):
    # tok 1: equal lengths, places 56 and 57 of 399 (7 * (399 - 57) >= 6 * 399 holds for both); tok 2: a place too far; tok 3: one component; tok 4: lengths too far apart
    rows = [(1, 10, 399, 56), (1, 11, 399, 57), (2, 10, 399, 56), (2, 12, 399, 58), (3, 10, 399, 0), (3, 13, 399, 0), (4, 10, 399, 0), (4, 14, 299, 0), (4, 15, 300, 0)]
    shared = common.saved(spark.createDataFrame(rows, "tok bigint, cls bigint, n int, place int"), "rows")
    label = common.cut_lineage(spark.createDataFrame([(10, 10), (13, 10)], "node bigint, label bigint"))
    kept = sorted((r["tok"], r["cls"]) for r in ngram_join._mixed(shared, label, 3).collect())
    assert kept == [(1, 10), (1, 11), (4, 10), (4, 14), (4, 15)]  # 14 and 15 can link with each other


def test_probes_walk_a_tree_together(monkeypatch):
    rnd = random.Random(22)
    base = list(range(1, 81))
    sets = []
    for _ in range(120):
        s = set(rnd.sample(base, rnd.randrange(55, 81))) | {rnd.randrange(10**6) for _ in range(rnd.randrange(12))}
        sets.append(np.array(sorted(s), np.uint64))
    tree = ngram_join.PrefixTree([])
    for k, s in enumerate(sets[:60]):
        tree.add(s.tolist(), k)
    want = {(k, x) for k, s in enumerate(sets[60:]) for x in tree.linked(set(s.tolist()))}
    known = np.unique(np.concatenate(sets[:60]))
    assert want and set(tree.linked_all(sets[60:], known)) == want
    monkeypatch.setattr(ngram_join, "WALKED", 1000)  # a probe at a time
    assert set(tree.linked_all(sets[60:], known)) == want
