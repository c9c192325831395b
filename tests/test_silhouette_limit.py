"""Silhouettes of every record up to the limit, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from oreflow.operators import models


def test_silhouettes_up_to_the_limit_are_whole(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(1500, 3)), rng.integers(0, 3, 1500)
    df = spark.createDataFrame([(i, v.tolist(), f"c{k}") for i, (v, k) in enumerate(zip(x, c, strict=True))], "id bigint, x array<double>, c string")
    got = {r["key"]: r["silhouette"] for r in models.silhouette(df, F.col("x"), "c", "id").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    sums = np.stack([d[:, c == k].sum(axis=1) for k in range(3)], axis=1)
    sizes = np.bincount(c)
    assert len(got) == 1500
    for i in range(1500):
        a = sums[i, c[i]] / (sizes[c[i]] - 1)
        b = min(sums[i, k] / sizes[k] for k in range(3) if k != c[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-6
    assert models.silhouette(df.union(df.withColumn("id", F.col("id") + 1500)), F.col("x"), "c", "id").count() == 1000


def test_kmeans_gives_silhouettes_of_few_rows(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(loc=m, scale=0.1, size=(40, 2)) for m in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    rows = models.kmeans(df, F.col("x"), 3, "id").collect()
    assert len(rows) == 120 and all(r["$KMS-K-Means"] > 0.9 for r in rows)
    assert "$KMS-K-Means" not in models.kmeans(df, F.col("x"), 3, "id", full=100).columns
