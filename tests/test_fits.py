"""Trees, CHAID, gradient fits, clusters, neighbours and item sets against plain sequential Python."""

from __future__ import annotations

import math
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreflow.functions import rng
from oreflow.operators import associations, cart, chaid, clusters, gradient, models
from oreflow.operators.neighbours import Neighbours

# -- trees -----------------------------------------------------------------------


def plain_tree(rows, target, inputs, depth, least, as_classes):
    """Recursive CART over lists of dicts; ties by field, then lowest threshold or value."""
    fills = {f: np.mean([r[f] for r in rows if r[f] is not None]) for f in inputs if any(isinstance(r[f], float) for r in rows)}
    get = lambda r, f: (fills[f] if r[f] is None else r[f]) if f in fills else r[f] if r[f] is not None else "(missing)"
    classes = sorted({r[target] for r in rows}) if as_classes else None

    def impurity(own):
        if as_classes:
            return len(own) - sum(sum(r[target] == c for r in own) ** 2 for c in classes) / len(own)
        y = np.array([r[target] for r in own])
        return float(((y - y.mean()) ** 2).sum())

    def build(own, left):
        if as_classes:
            n = [sum(r[target] == c for r in own) for c in classes]
            node = (classes[int(np.argmax(n))], round(max(n) / len(own), 6))
        else:
            node = (round(float(np.mean([r[target] for r in own])), 6),)
        best = None
        if left and len(own) >= 2 * least and impurity(own) > 1e-9:
            for k, f in enumerate(inputs):
                values = sorted({get(r, f) for r in own})
                tests = [((a + b) / 2, lambda r, t=(a + b) / 2: get(r, f) <= t) for a, b in zip(values, values[1:], strict=False)] if f in fills else [
                    (v, lambda r, v=v: get(r, f) == v) for v in values]
                for cut, test in tests:
                    yes, no = [r for r in own if test(r)], [r for r in own if not test(r)]
                    if min(len(yes), len(no)) < least:
                        continue
                    gain = math.floor((impurity(own) - impurity(yes) - impurity(no)) * 1e6 + 0.5) / 1e6
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, k, cut, yes, no)
        if best is None:
            return node
        return node, inputs[best[1]], best[2], build(best[3], left - 1), build(best[4], left - 1)

    return build(rows, depth)


def shape(m, k=0):
    n = m.nodes[k]
    node = (n["prediction"], round(n["confidence"], 6)) if m.classes else (round(n["prediction"], 6),)
    s = n.get("split")
    if not s:
        return node
    return node, s["field"], s["threshold"] if s["value"] is None else s["value"], shape(m, n["left"]), shape(m, n["right"])


def sample_rows(n=160):
    r = random.Random(4)
    out = []
    for i in range(n):
        a, b, t = r.choice([None, *map(float, range(9))]), round(r.random() * 8) / 8, r.choice(["x", "y", None, "z z", "o'k"])
        y = "p" if (a or 4) + 3 * (t == "x") + r.random() * 3 > 7 else r.choice("qr")
        out.append({"i": i, "a b": a, "b.c": b, "t": t, "y": y, "v": (a or 0) * 2 + b + 5 * (t == "y")})
    return out


@pytest.mark.parametrize(("target", "as_classes", "least"), [("y", True, 1), ("y", True, 7), ("v", False, 4)])
def test_trees_agree_with_recursion(spark, monkeypatch, target, as_classes, least):
    monkeypatch.setattr(cart, "CUTS", 4)
    rows, inputs = sample_rows(), ["a b", "b.c", "t"]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "i int, `a b` double, `b.c` double, t string, y string, v double")
    m = cart.grow(df, target, inputs, 3, least)
    want = plain_tree(rows, target, inputs, 3, least, as_classes)
    assert shape(m) == want
    gains = m.importance()
    assert abs(sum(gains.values()) - 1) < 1e-9 and set(gains) <= set(inputs)

    def down(r, node):
        while len(node) == 5:
            _, f, cut, yes, no = node
            v = r[f] if r[f] is not None else np.mean([x[f] for x in rows if x[f] is not None]) if f != "t" else "(missing)"
            node = yes if (v == cut if f == "t" else v <= cut) else no
        return node

    for r in m.transform(df).collect():
        got = (r[f"$R-{target}"], r[f"$RC-{target}"]) if as_classes else (r[f"$R-{target}"],)
        assert all(abs(x - y) < 1e-4 if isinstance(y, float) else x == y for x, y in zip(got, down(rows[r["i"]], want), strict=True))
    told = m.rules(spark).collect()
    assert len(told) == len(m.nodes) and sum(r["n"] for r in told if r["leaf"]) == len(rows)


def test_tree_edges(spark):
    one = spark.createDataFrame([(1.0, "a"), (1.0, "b")] * 3, "x double, y string")
    m = cart.grow(one, "y", ["x"])
    assert len(m.nodes) == 1 and m.transform(one).first()["$R-y"] == "a"  # no cut; the first class
    with pytest.raises(ValueError):
        cart.grow(one.where("y = 'a'"), "y", ["x"])
    same = spark.range(5000).select((F.col("id") % 2).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    m = cart.grow(same, "y", ["x"], 16)
    assert [n.get("split", {}).get("threshold") for n in m.nodes] == [0.5, None, None]
    assert not cart.few_whole(spark.range(9).select(F.col("id").cast("double").alias("v")), "v")
    assert cart.few_whole(spark.range(9).select((F.col("id") % 5).cast("double").alias("v")), "v")


# -- CHAID -----------------------------------------------------------------------


def plain_p(a, b):
    t = np.array([a, b], float)
    chi2, df = chaid.pearson(t)
    return float(chaid.upper_tails(np.array([chi2]), np.array([df]))[0])


def plain_merge(counts, ordered, missing, alpha, least):
    groups = [([i], np.array(c, float), i == missing) for i, c in enumerate(counts)]

    def allowed():
        if not ordered:
            return list(combinations(range(len(groups)), 2))
        tied = [i for i, g in enumerate(groups) if not g[2]]
        return list(zip(tied, tied[1:], strict=False)) + [(i, j) for i, g in enumerate(groups) if g[2] for j in tied]

    def join(i, j):
        a, b = groups[i], groups[j]
        groups[i] = (sorted(a[0] + b[0]), a[1] + b[1], a[2] and b[2])
        del groups[j]
        groups.sort(key=lambda g: g[0][0])

    def best(pairs):
        return max(((plain_p(groups[i][1], groups[j][1]), i, j) for i, j in pairs), key=lambda x: x[0], default=None)

    while len(groups) > 1 and (b := best(allowed())) and b[0] > alpha:
        join(b[1], b[2])
    while len(groups) > 1:
        k = min(range(len(groups)), key=lambda i: groups[i][1].sum())
        if groups[k][1].sum() >= least or not (b := best(p for p in allowed() if k in p)):
            break
        join(b[1], b[2])
    return [g[0] for g in groups]


def test_tails_of_chi_square():
    # Fixed values of a printed table of the distribution.
    for chi2, df, p in ((3.841, 1, 0.05), (5.991, 2, 0.05), (7.815, 3, 0.05), (18.307, 10, 0.05), (6.635, 1, 0.01), (43.773, 30, 0.05)):
        assert abs(chaid.upper_tails(np.array([chi2]), np.array([df]))[0] - p) < 1e-4
        assert abs(math.exp(chaid.log_upper_tail(chi2, df)) - p) < 1e-4
    assert chaid.log_upper_tail(5000.0, 1) < -2500 and chaid.log_upper_tail(100_000.0, 7) < -49_000
    assert math.isclose(chaid.log_upper_tail(800.1, 1), chaid.log_upper_tail(799.9, 1), rel_tol=1e-3)


def test_ways_to_group():
    assert [round(math.exp(chaid.log_stirling(5, r))) for r in range(1, 6)] == [1, 15, 25, 10, 1]
    assert round(math.exp(chaid.log_choose(9, 3))) == 84 and chaid.log_choose(3, 4) == -math.inf
    assert 600 < chaid.log_stirling(600, 4) < 900  # past any float


def test_merging_agrees_with_trying_all_pairs():
    r = np.random.default_rng(8)
    for k in range(60):
        n, c = int(r.integers(2, 14)), int(r.integers(2, 5))
        counts = r.integers(0, int(r.choice([3, 12, 60])), (n, c))
        counts[:, 0] += counts.sum(1) == 0
        alpha, least = float(r.choice([0.05, 0.3])), int(r.choice([1, 10, 40]))
        assert chaid.merge_unordered(counts, alpha, least) == plain_merge(counts, False, None, alpha, least)
        missing = n - 1 if k % 2 else None
        assert chaid.merge_ordered(counts, missing, alpha, least) == plain_merge(counts, True, missing, alpha, least)


def test_missing_may_join_the_lowest_range():
    counts = np.array([[50, 1], [1, 50], [49, 2]])
    assert chaid.merge_ordered(counts, 2, 0.05, 10) == [[0, 2], [1]]


def test_many_categories_end():
    r = np.random.default_rng(2)
    for counts in (r.integers(0, 40, (5000, 3)), np.full((5000, 2), 9), r.integers(0, 9, (1100, 2))):
        began = time.time()
        groups, _, _, log_p = chaid.grouping(counts, False, None, 0.05, 10)
        assert time.time() - began < 60 and sorted(i for g in groups for i in g) == list(range(len(counts))) and log_p <= 0


def test_chaid_of_many_values_in_spark(spark):
    df = spark.range(40_000).select(
        F.concat(F.lit("v"), F.col("id") % 700).alias("s.t"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 6).cast("double").alias("n"),
        F.when((F.col("id") % 700 < 300) | (F.col("id") % 10 == 0), "a").when(F.col("id") % 700 < 500, "b").otherwise("c").alias("y"),
    )
    m = models.Chaid(df, "y", ["n", "s.t"], max_depth=2)
    assert m.nodes[0]["split"]["field"] == 1 and len(set(m.nodes[0]["split"]["children"].values())) >= 3
    out = m.transform(df).groupBy((F.col("y") == F.col("`$CH-y`")).alias("hit")).count().collect()
    assert {r["hit"]: r["count"] for r in out}[True] > 37_000
    assert set(m.importance()) <= {"n", "s.t"} and m.rules(spark).where("leaf").agg(F.sum("n")).first()[0] == 40_000
    unseen = m.transform(spark.createDataFrame([("new", None)], "`s.t` string, n double")).first()
    assert unseen["$CH-y"] in ("a", "b", "c")


# -- steps of gradients --------------------------------------------------------------


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(11)
    x = np.concatenate([r.normal(m, 1.2, (70, 2)) for m in ((0, 0), (3, 1), (1, 4))])
    return [(float(a), None if i % 17 == 0 else float(b), "uvw"[i % 3], "klm"[i // 70]) for i, (a, b) in enumerate(x)]


@pytest.fixture(scope="module", params=["one block", "several blocks"])
def data(request, spark, points):
    from oreflow.operators import blocks

    size, blocks.SIZE = blocks.SIZE, 4096 if request.param == "one block" else 32
    request.addfinalizer(lambda: setattr(blocks, "SIZE", size))
    return spark.createDataFrame(points, "a double, `b.b` double, t string, y string").repartition(3).persist()


def dense(m, points):
    names = m.encoder.terms()
    x = np.zeros((len(points), len(names)))
    for i, (a, b, t, _) in enumerate(points):
        for j, n in enumerate(names):
            f = n.split("=")[0]
            if f in m.encoder.numbers:
                mean, sd = m.encoder.numbers[f]
                v = a if f == "a" else b
                x[i, j] = 0.0 if v is None else (v - mean) / sd
            else:
                x[i, j] = n == f"t={t}"
    return x, np.array(["klm".index(p[3]) for p in points])


INPUTS = ["a", "b.b", "t"]


def test_svm_equals_sequential_steps(data, points):
    m = models.svm(data, "y", INPUTS, cost=3, iterations=25)
    x, y = dense(m, points)
    for k in range(3):
        w, b, sign = np.zeros(x.shape[1]), 0.0, np.where(y == k, 1, -1)
        for it in range(25):
            g, gb = w.copy(), 0.0
            for row, s in zip(x, sign, strict=True):
                if s * (w @ row + b) < 1:
                    g -= 3 * s / len(x) * row
                    gb -= 3 * s / len(x)
            w, b = w - 0.1 / (1 + it * 0.01) * g, b - 0.1 / (1 + it * 0.01) * gb
        assert np.allclose(m.planes[k][0], w, atol=1e-9) and abs(m.planes[k][1] - b) < 1e-9


def test_logistic_equals_sequential_steps(data, points):
    m = models.logistic(data, "y", INPUTS, l2=0.01, iterations=20)
    x, y = dense(m, points)
    w = np.zeros((3, x.shape[1] + 1))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(20):
        p = gradient.softmax(x1 @ w.T)
        p[np.arange(len(y)), y] -= 1
        w = w - 0.3 * (p.T @ x1 / len(y) + 0.01 * np.hstack([w[:, :-1], np.zeros((3, 1))]))
    assert np.allclose(m.layers[0][0], w[:, :-1], atol=1e-9) and np.allclose(m.layers[0][1], w[:, -1], atol=1e-9)


def test_network_equals_sequential_steps(spark, data, points):
    m = models.ann(data, "y", INPUTS, hidden=3, iterations=12, seed=5)
    x, y = dense(m, points)
    u = rng.draws(5, 3 * x.shape[1] + 9) * 2 - 1
    first, second = u[: 3 * x.shape[1]].reshape(3, -1) * math.sqrt(6 / (3 + x.shape[1])), u[3 * x.shape[1] :].reshape(3, 3) * 1.0
    b, c = np.zeros(3), np.zeros(3)
    for _ in range(12):
        g = [np.zeros_like(z) for z in (first, b, second, c)]
        for row, k in zip(x, y, strict=True):
            h = np.tanh(first @ row + b)
            d = gradient.softmax((second @ h + c)[None])[0] - (np.arange(3) == k)
            back = (d @ second) * (1 - h * h)
            g[0] += np.outer(back, row)
            g[1] += back
            g[2] += np.outer(d, h)
            g[3] += d
        n = len(x)
        first, b = first - 0.1 * (g[0] / n + 1e-3 * first), b - 0.1 * g[1] / n
        second, c = second - 0.1 * (g[2] / n + 1e-3 * second), c - 0.1 * g[3] / n
    assert all(np.allclose(p, q, atol=1e-9) for p, q in zip((m.layers[0][0], m.layers[0][1], m.layers[1][0], m.layers[1][1]), (first, b, second, c), strict=True))
    df = spark.createDataFrame(points, "a double, `b.b` double, t string, y string")
    want = gradient.softmax(np.tanh(x @ first.T + b) @ second.T + c)
    for r, q in zip(m.transform(df).collect(), want, strict=True):
        assert r["$ANN-y"] == "klm"[q.argmax()] and abs(r["$ANNC-y"] - q.max()) < 1e-4


def test_draws_are_those_of_the_column(spark):
    got = [r[0] for r in spark.range(200).select(rng.uniform(42, F.col("id"))).collect()]
    assert got == rng.draws(42, 200).tolist()


def test_network_learns_what_no_line_parts(spark):
    rows = [(float(i % 2), float(i // 2 % 2), str((i + i // 2) % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    out = models.ann(df, "y", ["a", "b"], iterations=300, seed=7, rate=0.5).transform(df)
    assert out.where("`$ANN-y` = y").count() == 40


def test_parameters_are_checked(data):
    for call in (lambda: models.svm(data, "y", INPUTS, cost=0), lambda: models.ann(data, "y", INPUTS, hidden=0), lambda: models.logistic(data, "y", INPUTS, iterations=0)):
        with pytest.raises(ValueError, match="can be from"):
            call()


# -- clusters -----------------------------------------------------------------------


def plain_kmeans(x, k, seed, iterations):
    u = rng.draws(seed, k)
    centres = [x[int(u[0] * len(x))].copy()]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        left, at = u[len(centres)] * d.sum(), 0
        while at < len(d) - 1:
            left -= d[at]
            if left <= 0:
                break
            at += 1
        centres.append(x[at].copy())
    old = np.full(len(x), -1)
    for passes in range(1, iterations + 1):  # noqa: B007
        to = np.array([int(np.argmin([((r - c) ** 2).sum() for c in centres])) for r in x])
        moved = (to != old).any()
        for i in range(k):
            if (to == i).any():
                centres[i] = x[to == i].mean(axis=0)
        old = to
        if not moved:
            break
    return np.array(centres), passes


@pytest.mark.parametrize("seed", [1, 6, 42])
def test_clusters_equal_a_sequential_run(spark, monkeypatch, seed):
    from oreflow.operators import blocks

    monkeypatch.setattr(blocks, "SIZE", 16)
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(m, 1.0, (60, 3)) for m in (0, 2, 5, 9)])[r.permutation(240)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").repartition(5)
    got, passes = clusters.fit(df, F.col("x"), 4, seed, 50, ["id"])
    want, n = plain_kmeans(x, 4, seed, 50)
    assert np.allclose(got, want, atol=1e-9) and passes == n
    with pytest.raises(ValueError):
        clusters.fit(df.limit(2), F.col("x"), 4)


def test_a_cluster_without_rows_keeps_its_centre(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "id int, x array<double>")
    assert clusters.fit(df, F.col("x"), 3, keys=["id"])[0].tolist() == [[1.0, 1.0]] * 3


# -- neighbours -----------------------------------------------------------------------


def test_pruned_neighbours_are_exact(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(m, 0.3, (400, 4)) for m in r.uniform(-40, 40, (12, 4))] + [np.ones((1500, 4))]).round(3)
    y = ["abc"[i % 3] for i in range(len(x))]
    df = spark.createDataFrame([(i, *v.tolist(), k) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id bigint, a double, b double, c double, d double, y string")
    names = ["a", "b", "c", "d"]
    encoder = models.Encoder.fit(df, names)
    m = Neighbours.fit(df, "y", names, "id", encoder, 7)
    asked = df.where("id % 9 = 0").select("id", F.array(*encoder.columns(df).values()).alias("x"))
    near, met, every = m.nearest(asked, block=300)
    z = np.array([[(v - encoder.numbers[f][0]) / encoder.numbers[f][1] for v, f in zip(row, names, strict=True)] for row in x])
    got = {q["q"]: q["near"] for q in near.collect()}
    assert len(got) == len(range(0, len(x), 9)) and met < every / 2
    for i, own in got.items():
        d = ((z - z[i]) ** 2).sum(axis=1)
        assert [n["key"] for n in own] == np.lexsort((np.arange(len(d)), d))[:7].tolist()


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 5.0, "b"), (3, 6.0, "b")], "id bigint, x double, y string")
    out = models.knn(df, df, "y", ["x"], "id", k=9)
    assert {r["$KNN-y"] for r in out.collect()} == {"b"} and out.first()["$KNNC-y"] == 0.6667


# -- item sets -----------------------------------------------------------------------


def test_item_sets_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(associations, "BLOCK_ROWS", 64)
    r = random.Random(1)
    sets = [sorted({r.choice("abcdefghij") for _ in range(r.randint(0, 7))}) for _ in range(700)] + [["x", "x", "a"]] * 80 + [None]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(sets)], "basket string, items array<string>").repartition(6)
    found, rules = associations.apriori(df, 1.5, 40, 4)
    sets = [set(s or ()) for s in sets]
    least = math.ceil(0.015 * len(sets))
    want = {}
    for k in range(1, 6):
        for s in combinations("abcdefghijx", k):
            if (n := sum(set(s) <= b for b in sets)) >= least:
                want[s] = n
    assert {tuple(q["items"]): q["n"] for q in found.collect()} == want and any(len(s) > 3 for s in want)
    pairs = {(" & ".join(x for x in s if x != c), c): n / want[tuple(x for x in s if x != c)] for s, n in want.items() if len(s) > 1 for c in s}
    assert {(q["Antecedent"], q["Consequent"]): q["Confidence"] for q in rules.collect()} == {k: v for k, v in pairs.items() if v >= 0.4}
    with pytest.raises(ValueError, match="minimum support"):
        associations.apriori(df, 1.5, 40, 4, most=5)
    with pytest.raises(ValueError):
        associations.apriori(df.limit(0))


def test_chaid_of_numbers_in_spark(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 6).cast("double").alias("v"),
        F.when(F.col("id") % 9 == 0, "c").when(F.col("id") % 6 < 2, "a").when(F.col("id") % 6 < 4, "b").otherwise("c").alias("y"),
    )
    m = models.Chaid(df, "y", ["v"], bins=6)
    told = [r["rule"] for r in m.rules(spark).where("leaf").collect()]
    assert len(told) == 3 and any("or missing" in x for x in told)
    assert m.transform(df).where("`$CH-y` = y").count() == 900
