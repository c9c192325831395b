"""Queries over whole tables: every row takes part."""

from oreflow.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_merges_of_whole_tables(spark):
    t = lambda name: spark.read.parquet(f"{DIR}/{name}.parquet")
    q = {n: f(spark, DIR) for n, f in catalogue.QUERIES.items() if n.startswith(("merge_whole_", "merge_unmatched_"))}
    orders = {r[0] for r in t("orders").select("o_orderkey").collect()}
    assert {r["o_orderkey"] for r in q["merge_whole_left"].collect()} == orders
    customers = {r[0] for r in t("customer").select("c_custkey").collect()}
    assert {r["o_custkey"] for r in q["merge_whole_full"].collect()} >= customers
    full = q["merge_unmatched_full"]
    assert full.where("p_partkey is null").count() and full.where("n_name is null").count()
    assert full.where("p_partkey is not null").count() == t("part").count()
