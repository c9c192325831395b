"""Association rules: frequent item sets level by level, counted along a prefix tree of candidates.

Baskets become blocks of bitmaps, one for each frequent item, kept in the
shared folder.  A level's candidates (sets that join two frequent ones and have
frequent subsets only) are a prefix tree, walked once a block: the bitmap of a
prefix is made once for all that begin with it, and the counts are those of
bits.  Tasks add up their counts, so nothing is exploded and one vector of
counts a level reaches the driver.  Candidates are at most ``most`` a level,
more are an error, so what the driver and each task hold is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.functions.values import as_text
from oreflow.operators import blocks
from oreflow.operators.lineage import kept

#: Candidate sets of a level.
MOST = 200_000
#: Bytes of a block's bitmaps, and baskets in it, at most.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 15


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """One row per basket with its set of trimmed items; rows that lack either are left out."""
    b, i = as_text(df, basket), F.nullif(F.trim(as_text(df, item)), F.lit(""))
    return df.where(b.isNotNull() & i.isNotNull()).groupBy(b.alias("basket")).agg(F.sort_array(F.collect_set(i)).alias("items"))


def flag_baskets(df: DataFrame, flags: list[str], key: str) -> DataFrame:
    """Baskets from fields that say T, true, yes, y or 1; rows with none count as empty baskets."""
    return df.select(
        as_text(df, key).alias("basket"),
        F.array_compact(F.array(*[F.when(F.lower(as_text(df, f)).isin("t", "true", "y", "yes", "1"), f) for f in flags])).alias("items"),
    )


def value_baskets(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """Baskets of ``field = value`` items, one for each row; missing values are no items."""
    return df.select(
        as_text(df, key).alias("basket"),
        F.array_compact(F.array(*[F.concat(F.lit(f"{f} = "), as_text(df, f)) for f in fields])).alias("items"),
    )


def candidates(level: list[tuple[int, ...]], most: int = MOST) -> list[tuple[int, ...]]:
    """Sets longer by one whose subsets, shorter by one, are all in ``level``, in order."""
    known, out = set(level), []
    for _, own in groupby(sorted(level), key=lambda s: s[:-1]):
        for a, b in combinations(list(own), 2):
            new = (*a, b[-1])
            if all(s in known for s in combinations(new, len(a))):
                out.append(new)
                if len(out) > most:
                    raise ValueError(f"Over {most} sets of {len(new)} items would be counted; a higher minimum support makes fewer.")
    return out


def _bitmaps(sets: DataFrame, number: dict[str, int]) -> DataFrame:
    """Blocks of baskets: for each item the bits of the baskets that hold it."""
    rows = max(64, min(BLOCK_ROWS, 8 * BLOCK_BYTES // max(1, len(number)))) // 8 * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(list(number), pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                lists = whole.column(0).slice(at, rows)
                item = pc.index_in(lists.flatten(), value_set=table).to_numpy(zero_copy_only=False)
                basket = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                held = ~np.isnan(item.astype(float))
                bits = np.zeros((len(number), -(-len(lists) // 8)), np.uint8)
                which, where = item[held].astype(np.int64), basket[held]
                np.bitwise_or.at(bits, (which, where >> 3), (1 << (where & 7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    return blocks.held(kept(sets.select(F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(run, "bits binary")), "bits")


def count_bits(bits: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """The number of baskets of a block that hold each of the sorted ``sets`` of one size."""
    out = np.zeros(len(sets), np.int64)
    path: list[np.ndarray] = []
    before: tuple[int, ...] = ()
    at = 0
    for prefix, own in groupby(sets, key=lambda s: s[:-1]):
        last = [s[-1] for s in own]
        shared = next((i for i, (a, b) in enumerate(zip(prefix, before, strict=False)) if a != b), min(len(prefix), len(before)))
        del path[shared:]
        for i in prefix[shared:]:
            path.append(bits[i] & path[-1] if path else bits[i])
        before = prefix
        held = bits[last] & path[-1] if path else bits[last]
        out[at : at + len(last)] = np.bitwise_count(held).sum(axis=1)
        at += len(last)
    return out


def _counted(data: DataFrame, items: int, sets: list[tuple[int, ...]]) -> np.ndarray:
    """The counts of ``sets`` over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sets))
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += count_bits(np.frombuffer(raw, np.uint8).reshape(items, -1), sets)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": [total.tobytes()]})

    return blocks.gathered(data.mapInArrow(run, blocks.SUMS), data.rdd.getNumPartitions(), 8 * len(sets))


def apriori(sets: DataFrame, min_support: float = 10, min_confidence: float = 50, max_antecedents: int = 3, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Frequent item sets, and rules with one consequent: supports, confidence and lift."""
    spark = sets.sparkSession
    n = sets.count()
    if not n:
        raise ValueError("There are no baskets to analyse.")
    least = math.ceil(max(0.0001, (min_support or 10) / 100) * n)
    # Each item once a basket; a frequent one is in a share of all baskets, so there are few.
    single = sets.select(F.explode(F.array_distinct("items")).alias("item")).where("item is not null").groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = {r["item"]: r["n"] for r in single.collect()}
    names = sorted(found)
    supports: dict[tuple[int, ...], int] = {(i,): found[x] for i, x in enumerate(names)}
    level, data = list(supports), None
    for _ in range(max(1, round(max_antecedents))):
        tried = candidates(level, most)
        if not tried:
            break
        if data is None:
            data = _bitmaps(sets, {x: i for i, x in enumerate(names)})
        counts = _counted(data, len(names), tried).astype(np.int64).tolist()
        level = [s for s, c in zip(tried, counts, strict=True) if c >= least]
        supports |= {s: c for s, c in zip(tried, counts, strict=True) if c >= least}
    if data is not None:
        data.unpersist()
    own = lambda s: [names[i] for i in s]
    sets_found = spark.createDataFrame([(own(s), c) for s, c in supports.items()], "items array<string>, n bigint")
    rows = []
    for s, c in supports.items():
        for i in s if len(s) > 1 else ():
            ante = tuple(x for x in s if x != i)
            confidence = c / supports[ante]
            if confidence >= (min_confidence or 0) / 100:
                told = own(ante)
                rows.append((" & ".join(told), names[i], supports[ante] / n, c / n, confidence, confidence / (supports[(i,)] / n), c, told))
    kinds = (
        "Antecedent string, Consequent string, `Antecedent support` double, `Rule support` double, Confidence double, Lift double, Transactions bigint, "
        "`Antecedent items` array<string>"
    )
    return sets_found, spark.createDataFrame(rows, kinds)


def recommend(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each basket the consequents it lacks of rules whose antecedent it holds; best by confidence, then lift.

    Each rule is joined by one of its antecedent's items, so only baskets with that item meet it.
    """
    r = rules.select(F.col("Antecedent items").alias("ante"), "Antecedent", "Consequent", "Confidence", "Lift").withColumn("anchor", F.col("ante")[0])
    met = sets.select(
        "basket", "items", F.explode("items").alias("anchor"),
    ).join(r, "anchor").where((F.size(F.array_except("ante", "items")) == 0) & ~F.array_contains("items", F.col("Consequent")))
    best = met.groupBy("basket", "Consequent").agg(F.max_by(
        F.struct("Antecedent", "Confidence", "Lift"), F.struct("Confidence", "Lift", "Antecedent"),
    ).alias("b"))
    return best.select(F.col("basket").alias("Basket"), F.col("Consequent").alias("Recommendation"), "b.*")


class Rules:
    """Saved rules; :meth:`transform` takes baskets (basket, items)."""

    def __init__(self, rules: DataFrame):
        self.rules = rules

    def transform(self, sets: DataFrame) -> DataFrame:
        return recommend(sets, self.rules)
