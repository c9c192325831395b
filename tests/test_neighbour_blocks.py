import numpy as np
from pyspark.sql import functions as F

from oreflow.operators import models, neighbours


def test_a_query_is_sent_once_to_a_group_of_cells(spark, monkeypatch):
    """Without structure in 12 dimensions no cell can be left out; the search must not send each query to each of 256 cells."""
    x = np.random.default_rng(5).uniform(-1, 1, (1500, 12)).round(3)
    names = [f"e{i}" for i in range(12)]
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id bigint, v array<double>, y string")
    df = df.select("id", "y", *[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    encoder = models.Encoder.fit(df, names)
    sent, keep = [], neighbours.kept

    def counted(rows):
        out = keep(rows)
        if rows.columns[:2] == ["id", "x"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "kept", counted)
    asked = df.where("id % 5 = 0").select("id", F.array(*encoder.columns(df).values()).alias("x"))
    near, _, _ = neighbours.Neighbours.fit(df, "y", names, "id", encoder, 5).nearest(asked)
    assert 300 <= sum(sent) <= 300 * 6
    z = np.stack([(x[:, i] - encoder.numbers[n][0]) / encoder.numbers[n][1] for i, n in enumerate(names)], axis=1)
    got = {r["q"]: [n["key"] for n in r["near"]] for r in near.collect()}
    assert len(got) == 300
    for i, own in got.items():
        d = ((z - z[i]) ** 2).sum(axis=1)
        assert own == np.lexsort((np.arange(len(d)), d))[:5].tolist()
