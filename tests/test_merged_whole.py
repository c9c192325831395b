"""Samples and groups of a join without its rows against those of the rows."""

import pytest

from oreflow.operators import record


def tables(spark, text_key):
    left = [(i * 7 % 13, None if i % 9 == 4 else i % 5, None if i % 4 == 1 else f"s{i % 3}", i) for i in range(13)]
    right = [(i, None if i % 8 == 3 else 2 + i % 6, f"n{i}") for i in range(22)]
    kind = "string" if text_key else "bigint"
    b = [(i, str(k) if text_key and k is not None else k, n) for i, k, n in right]
    return spark.createDataFrame(left, "at bigint, k bigint, source string, name bigint"), spark.createDataFrame(b, f"at bigint, key {kind}, name string")


@pytest.mark.parametrize("text_key", [False, True])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_as_the_made_rows(spark, how, text_key, monkeypatch):
    monkeypatch.setattr(record, "RUN", 4)
    left, right = tables(spark, text_key)
    plain = record.merge(left, right, "k", "key", how, ("at", "at"))
    own = lambda df: sorted(map(str, df.collect()))
    for n in (1, 4):
        want = record.sample_every(plain, n, ["Place"]).drop("Place")
        got = record.merge_every(left, right, "k", "key", n, how, ("at", "at"))
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert own(got) == own(want)
    for keys in (["source"], ["source", "name"]):
        want = record.aggregate(plain, keys, [], [], "Place")
        got = record.merge_aggregate(left, right, "k", "key", keys, how, ("at", "at"))
        assert got.columns == want.columns and own(got) == own(want)


def test_no_rows(spark):
    left, right = tables(spark, False)
    none = right.where("false")
    assert record.merge_every(left.where("false"), none, "k", "key", 3, "full", ("at", "at")).count() == 0
    assert record.merge_aggregate(left, none, "k", "key", ["source"], "inner", ("at", "at")).count() == 0
    assert record.merge_every(left, none, "k", "key", 3, "full", ("at", "at")).count() == 5


def test_made_rows_are_few(spark):
    """700 x 700 pairs of one key: no more rows than the sample come out of the join."""
    left = spark.range(700).selectExpr("id AS at", "0 AS k", "id AS a")
    right = spark.range(700).selectExpr("id AS at", "0 AS key", "id AS b")
    got = record.merge_every(left, right, "k", "key", 1000, "full", ("at", "at"))
    assert sorted((r["a"] * 700 + r["b"]) for r in got.collect()) == list(range(0, 490_000, 1000))
