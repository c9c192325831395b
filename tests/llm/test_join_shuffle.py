"""What the n-gram join shuffles besides its prefix rows grows with the shingles that texts share; each of them is dealt out a few times only."""

import random

from oreflow.llm import ngram_join


def _shuffled(spark, since: int) -> tuple[int, int]:
    """Records written to shuffles by the stages from number ``since`` on, and the next stage's number."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    found = [stages.apply(k) for k in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in found if x.stageId() >= since), max((x.stageId() + 1 for x in found), default=0)


def test_shared_shingles_are_dealt_a_few_times(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [line(40) for _ in range(40)]
    texts = [f"{line(60)} {rng.choice(passages)} {line(rng.randrange(20, 200))}" for _ in range(1500)]
    texts += [f"{x} end" for x in texts[:150]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    _, since = _shuffled(spark, 0)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    moved, _ = _shuffled(spark, since)
    sets = [ngram_join.shingle_set(x) for x in texts]
    assert got == {k: k - 1500 if k >= 1500 else k for k in range(len(texts))}
    prefixes = sum(ngram_join.prefix_length(len(s)) for s in sets)
    assert moved <= 1.8 * prefixes
