"""Neighbours on all dimensions and item sets of every size, against brute force."""

from collections import defaultdict
from itertools import combinations

import numpy as np

from oreflow.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_neighbours_on_all_dimensions(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x, label = np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows], float)
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    assert z.shape[1] == 64
    got = {r["vec_id"]: r["predicted"] for r in catalogue.QUERIES["knn_predict_whole"](spark, DIR).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        near = np.argsort(((z - z[i]) ** 2).sum(axis=1), kind="stable")[:5]
        assert abs(float(got[r["vec_id"]]) - label[near].mean()) < 1e-3


def test_item_sets_and_rules_of_up_to_three_antecedents(spark):
    baskets = defaultdict(set)
    for r in spark.read.parquet(f"{DIR}/orders.parquet").select("o_custkey", "o_orderpriority").collect():
        baskets[r[0]].add(r[1])
    items, n = sorted(set().union(*baskets.values())), len(baskets)
    count = {s: sum(set(s) <= b for b in baskets.values()) for k in range(1, 5) for s in combinations(items, k)}
    frequent = {s: m for s, m in count.items() if m >= 0.1 * n}
    assert any(len(s) > 2 for s in frequent)
    got = {r["items"]: r["n"] for r in catalogue.QUERIES["apriori_itemsets"](spark, DIR).collect()}
    assert got == {" & ".join(s): m for s, m in frequent.items()}
    want = {(" & ".join(a for a in s if a != c), c): (m / count[tuple(a for a in s if a != c)], m) for s, m in frequent.items() if len(s) > 1 for c in s}
    want = {k: v for k, v in want.items() if v[0] >= 0.5}
    rules = {(r["antecedent"], r["consequent"]): (r["confidence"], r["transactions"]) for r in catalogue.QUERIES["apriori_rules"](spark, DIR).collect()}
    assert rules.keys() == want.keys()
    assert all(abs(rules[k][0] - want[k][0]) < 1e-3 and rules[k][1] == want[k][1] for k in want)
