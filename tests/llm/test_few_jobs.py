"""Every job takes memory of the driver, on small tables too; the n-gram join and its components run in few of them."""

import random

from oreflow.llm import common, ngram_join


def _jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def test_components_in_few_jobs(spark):
    rng = random.Random(3)
    links = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, k) for k in range(2001, 2100)]
    least: dict[int, int] = {}
    for a, b in links:
        least.setdefault(a, a), least.setdefault(b, b)
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    frame = common.cut_lineage(spark.createDataFrame(links, "a bigint, b bigint"))
    before = _jobs(spark)
    label = ngram_join.components(frame)
    jobs = _jobs(spark) - before
    got = label.collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert len(got) == len(linked) and {r["node"]: r["label"] for r in got} == {x: least[x] for x in linked}
    assert jobs <= 55  # 72 with joins in place of windows
    assert not ngram_join.components(frame.where("a > 9999")).collect()


def test_near_duplicates_in_few_jobs(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [line(80) for _ in range(60)]
    texts += [f"{x} end" for x in texts[:20]] + texts[20:30] + ["", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    before = _jobs(spark)
    kept = sorted(r["doc_id"] for r in ngram_join.representatives(docs).collect())
    assert kept == [*range(60), 90, 91]
    assert _jobs(spark) - before <= 90  # 99 before


def test_looked_up_whole(spark):
    rows = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(100)] + [(99, k) for k in range(500)], "key int, k int")
    table = spark.createDataFrame([(k, k * k) for k in (0, 1, 2, 99)], "key int, v int")
    for some in (rows, rows.where("key != 99"), rows.where("key > 100"), rows.where("key is null")):
        got = sorted(map(tuple, common.looked_up(some, table, "key").select("key", "k", "v").collect()), key=str)
        assert got == sorted(map(tuple, some.join(table, "key", "left").select("key", "k", "v").collect()), key=str)
