"""Quantiles: the counts are made once, and ranges are found in two looks."""

import random

import numpy as np
from pyspark.sql import functions as F

from oreflow.operators import record


def table(spark):
    rnd = random.Random(5)
    rows = [(f"g{i % 7}", None if i % 31 == 0 else float(rnd.choice([rnd.randint(0, 9), round(rnd.gauss(0, 50), 3)]))) for i in range(4000)]
    return spark.createDataFrame(rows, "g string, v double"), rows


def test_any_number_of_cuts(spark, monkeypatch):
    df, rows = table(spark)
    df = df.persist()
    for cuts, few in ((2, 1000), (16, 1000), (256, 3)):
        monkeypatch.setattr(record, "FEW_GROUPS", few)
        got = {r["g"]: (r["q0"], r["q1"]) for r in record.quantiles(df, ["g"], "v", [0.1, 0.75], cuts).collect()}
        for g in {r[0] for r in rows}:
            want = np.quantile([v for h, v in rows if h == g and v is not None], [0.1, 0.75])
            assert np.allclose(got[g], want)


def test_rows_are_counted_once(spark):
    df, _ = table(spark)
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    record.quantiles(df.mapInArrow(passed, df.schema), ["g"], "v", [0.5]).collect()
    assert seen.value == 4000
