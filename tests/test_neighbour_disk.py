"""What the search for neighbours shuffles doesn't grow with the number of its blocks, and odd vectors leave the others' neighbours alone."""

import numpy as np
from pyspark.sql import functions as F

from oreflow.operators import models, neighbours


def _shuffled(spark, since: int) -> tuple[int, int]:
    """Records written to shuffles by the stages from number ``since`` on, and the next stage's number."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    found = [stages.apply(k) for k in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in found if x.stageId() >= since), max((x.stageId() + 1 for x in found), default=0)


def _near(x: np.ndarray, i: int, k: int) -> list[int]:
    d = ((x - x[i]) ** 2).sum(axis=1)
    return np.lexsort((np.arange(len(d)), d))[:k].tolist()


def test_no_row_is_sent_to_every_block(spark, monkeypatch):
    """Without structure all blocks meet: 20 of them here."""
    x = np.random.default_rng(8).uniform(-1, 1, (1200, 12)).round(2)
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id bigint, x array<double>, label string")
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 40)
    _, since = _shuffled(spark, 0)
    near, met, every = neighbours.Neighbours("label", None, False, 5, neighbours.kept(df)).nearest(df.select("id", "x"), block=60)
    moved, _ = _shuffled(spark, since)
    got = {r["q"]: [n["key"] for n in r["near"]] for r in near.collect()}
    assert got == {i: _near(x, i, 5) for i in range(len(x))}
    assert 0.3 * every < met <= every
    assert moved <= 8 * len(x)  # 57,186 before


def test_ties_odd_vectors_and_few_rows(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(0, 3, (300, 3)).astype(float), [[np.nan, 0, 0], [np.inf, 1, 1]]])
    df = spark.createDataFrame([(i, v.tolist(), f"k{i % 3}") for i, v in enumerate(x)], "id bigint, x array<double>, label string")
    for train, asked, block in ((df, df, None), (df, df, 7), (df.where("id < 3 or id > 299"), df, 2), (df, df.where("id = 5"), 10)):
        ids = [r["id"] for r in train.collect()]
        own = [i for i in ids if i < 300]
        near, _, _ = neighbours.Neighbours("label", None, False, 4, neighbours.kept(train)).nearest(asked.select("id", "x"), block)
        rows = {r["q"]: r["near"] for r in near.collect()}
        assert len(rows) == asked.count()
        for i, found in rows.items():
            if i >= 300:
                assert not found
                continue
            d = ((x[own] - x[i]) ** 2).sum(axis=1)
            want = np.lexsort((own, d))[:4]
            assert [(n["key"], n["d"], n["label"]) for n in found] == [(own[w], d[w], f"k{own[w] % 3}") for w in want]


def test_no_queries(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 5.0, "b")], "id bigint, x double, y string")
    assert not models.knn(df, df.where(F.lit(False)), "y", ["x"], "id").collect()
