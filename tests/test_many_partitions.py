"""Steps over more partitions than one gathering takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreflow.operators import blocks, clusters


@pytest.fixture
def small_fan(monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 4)


def test_sums_of_many_partitions(spark, small_fan):
    data = blocks.blocked(spark.range(300, numPartitions=37), F.array(F.col("id").cast("double"), F.lit(1.0)))
    many = data.repartition(37)
    assert blocks.summed(many, lambda x, y: x.sum(axis=0)).tolist() == [299 * 150, 300]
    data.unpersist()


def test_gathered_in_levels(spark, small_fan):
    rows = [(i, np.array([float(i), 1.0]).tobytes()) for i in range(70)]
    found = spark.createDataFrame(rows, blocks.SUMS)
    assert blocks.gathered(found, 70).tolist() == [69 * 35, 70]


def test_blocks_lie_in_one_wave(spark):
    data = blocks.blocked(spark.range(3000, numPartitions=150), F.array(F.col("id").cast("double")), pos=F.col("id"))
    assert data.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert data.agg(F.sum("n")).first()[0] == 3000
    data.unpersist()


def test_k_means_over_many_partitions(spark, small_fan, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 64)
    monkeypatch.setattr(blocks, "SIZE", 8)
    rows = spark.range(400, numPartitions=40).select("id", F.array((F.col("id") % 2 * 100 + F.col("id") % 5).cast("double")).alias("x"))
    centres, _ = clusters.fit(rows, F.col("x"), 2, keys=["id"])
    assert sorted(c[0] for c in centres) == [2.0, 102.0]
