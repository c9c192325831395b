"""200,000 rows through the operators that once had limits, none dropped; hot keys and rows without order."""

import pytest
from pyspark.sql import functions as F

from oreflow.operators import field, models, record, report
from oreflow.sources import files

N = 200_000


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(N).select((F.col("id") - 100_000).cast("double").alias("x"))


def test_extrema_and_histogram(rows):
    r = record.aggregate(rows, [], ["x"], ["Min", "Max"]).first()
    assert (r["x_Min"], r["x_Max"], r["Record_Count"]) == (-100_000, 99_999, N)
    assert report.histogram(rows, "x", 12).agg(F.sum("n")).first()[0] == N
    a = report.audit(rows).first()
    assert (a["distinct"], a["valid"], a["missing"]) == (N, N, 0)
    assert report.shapes(rows).agg(F.sum("n")).first()[0] == N


def test_binning(rows):
    out = field.binning(rows, "x", 4, "width")
    assert out.count() == N
    ends = {r["x"]: r["x_BIN"] for r in out.where("x in (-100000, 99999)").collect()}
    assert ends[-100_000.0].startswith("1:") and ends[99_999.0].startswith("4:")
    assert {r["count"] for r in field.binning(rows, "x", 4, "freq").groupBy("x_BIN").count().collect()} == {N // 4}


def test_single_cluster(rows):
    out = models.single_cluster(rows, models.encode(rows, ["x"]))
    assert out.count() == N and out.where("`$KMA-K-Means` = 'anomaly'").count() == N * 5 // 100


def test_csv_keeps_every_row(spark, rows, tmp_path):
    files.write_csv(rows, str(tmp_path / "x"))
    assert files.read_csv(spark, str(tmp_path / "x")).count() == N
    (tmp_path / "b.csv").write_text("x\nééé\nééé")
    with pytest.raises(ValueError, match="bytes as CSV"):
        files.read_csv(spark, str(tmp_path / "b.csv"), max_bytes=10)
    assert files.read_csv(spark, str(tmp_path / "b.csv"), max_bytes=20).count() == 2
    (tmp_path / "c.csv").write_text('a,b\r1,"x\ny"\r2,z\r')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c.csv")).orderBy("a").collect()] == [(1.0, "x\ny"), (2.0, "z")]


@pytest.mark.parametrize("key", ["t", "d", "hot", "same"])
def test_places_by_keys_of_any_type(spark, key):
    i = F.col("id")
    df = spark.range(20_000).select(
        F.concat(F.lit("k"), i % 5000).alias("t"), F.timestamp_seconds(i % 7000).alias("d"),
        F.when(i % 3 == 0, 0).otherwise(i).alias("hot"), F.lit(1).alias("same"), F.when(i % 2 == 0, i).alias("v"),
    )
    out = record.positions(df, [key])
    places = out.orderBy("__pos").collect()
    assert [r["__pos"] for r in places] == list(range(20_000))
    assert [r[key] for r in places] == sorted(r[key] for r in places)
    again = {tuple(r) for r in record.positions(df.repartition(7), [key]).collect()}
    assert again == {tuple(r) for r in places} or key in ("same", "hot", "t", "d") and len(again) == len({tuple(r) for r in places})
    biggest = max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert biggest < 0.5 * 20_000  # also for one key on all rows


def test_quantiles_of_groups(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(None if g == 0 else f"g{g}", float(v) if rng.random() > 0.1 else None) for g, n in ((0, 5), (1, 3000), (2, 1), (3, 40)) for v in rng.integers(0, 10**6, n) / 8]
    df = spark.createDataFrame([*data, ("empty", None)], "g string, v double")
    got = {r["g"]: r for r in record.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.937, 1.0], cuts=16).collect()}
    assert "empty" not in got and len(got) == 4
    for g, r in got.items():
        own = [v for k, v in data if k == g and v is not None]
        assert np.allclose(list(r)[1:], np.quantile(own, [0.0, 0.25, 0.5, 0.937, 1.0]))


def test_joins_set_missing_keys_apart(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(100).select(F.when(F.col("id") < 40, F.col("id")).alias("k"), F.col("id").alias("b"))
    left.createOrReplaceTempView("l")
    right.createOrReplaceTempView("r")
    for how in ("inner", "left", "right", "full"):
        want = spark.sql(f"select coalesce(l.k, r.k) as k, a, b from l {how if how != 'inner' else ''} join r on l.k = r.k")
        got = record.merge(left, right, "k", "k", how)
        assert got.columns == ["k", "a", "b"] and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
