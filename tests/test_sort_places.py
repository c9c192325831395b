"""The whole sort with each row's place."""

from oreflow.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_sort_returns_missing_rows_last(spark):
    rows = catalogue.QUERIES["sort_missing_last_all"](spark, DIR).orderBy("place").collect()
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count() and [r["place"] for r in rows] == list(range(len(rows)))
    missing = [r["quality"] is None for r in rows]
    assert any(missing) and missing == sorted(missing)
