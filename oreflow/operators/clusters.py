"""k-means from a seeded start, by passes over blocks of rows in their order.

The first centre is a drawn row; each further one is drawn with a chance in
proportion to the squared distance to the nearest centre so far: blocks give
their sums, prefix sums over the blocks in row order tell in which of them the
draw falls, and that block alone finds the row.  Then rows go to the nearest
centre (of equally near ones the first) and centres to the mean of their rows,
until no row moves; a centre without rows stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.functions import rng
from oreflow.operators import blocks, record


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centre of each row and its squared distance, measured coordinate by coordinate."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    return d.argmin(axis=1), d.min(axis=1)


def _row(data: DataFrame, pos: int) -> np.ndarray:
    """The vector at a place."""
    block = data.where((F.col("pos") <= pos) & (F.col("pos") + F.col("n") > pos)).first()
    return np.frombuffer(block["x"], float).reshape(block["n"], -1)[pos - block["pos"]].copy()


def _drawn(data: DataFrame, centres: np.ndarray, u: float) -> np.ndarray:
    """The row at which the sums of squared distances, in the order of rows, reach the share ``u`` of the whole."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pos, x, _ in blocks.matrices(batches):
            yield pa.RecordBatch.from_pydict({"pos": [pos], "d": [float(nearest(x, centres)[1].sum())]})

    parts = data.mapInArrow(sums, "pos bigint, d double")
    total = parts.agg(F.sum("d")).first()[0]
    wanted = u * total
    # Blocks are dealt in order: a few hundred ranges of them first, then the blocks of one.
    width = blocks.SIZE * 256
    before, at = 0.0, None
    for r in parts.groupBy(F.floor(F.col("pos") / width).alias("k")).agg(F.sum("d").alias("d")).orderBy("k").toLocalIterator():
        at = r["k"]
        if before + r["d"] >= wanted:
            break
        before += r["d"]
    own = sorted(parts.where(F.floor(F.col("pos") / width) == at).collect(), key=lambda r: r["pos"])  # at most some hundred blocks
    block = own[-1]
    for r in own:
        if before + r["d"] >= wanted:
            block = r
            break
        before += r["d"]
    found = data.where(F.col("pos") == block["pos"]).first()
    x = np.frombuffer(found["x"], float).reshape(found["n"], -1)
    reach = before + np.cumsum(nearest(x, centres)[1])
    return x[min(int(np.searchsorted(reach, wanted)), len(x) - 1)].copy()


def fit(df: DataFrame, vector: Column, k: int, seed: int = 1, iterations: int = 50, keys: list[str] | None = None) -> tuple[np.ndarray, int]:
    """The centres and the number of passes; rows are in the order of ``keys``, without them in that of the vectors."""
    rows = df.select(vector.cast("array<double>").alias("__x"), *[F.col("`" + c.replace("`", "``") + "`").alias(f"__key{i}") for i, c in enumerate(keys or [])])
    placed = record.positions(rows, [f"__key{i}" for i in range(len(keys or []))] or ["__x"])
    data = blocks.blocked(placed.select("__x", "__pos"), F.col("__x"), pos=F.col("__pos"))
    n = data.agg(F.sum("n")).first()[0] or 0
    if n < k:
        raise ValueError(f"{k} clusters need {k} rows or more.")
    u = rng.draws(seed, k)
    centres = _row(data, int(u[0] * n))[None]
    while len(centres) < k:
        centres = np.vstack([centres, _drawn(data, centres, u[len(centres)])])
    old, passes = None, 0
    width = centres.shape[1]
    for passes in range(1, iterations + 1):

        def sums(x: np.ndarray, _: np.ndarray, now: np.ndarray = centres, old: np.ndarray | None = old) -> np.ndarray:
            to = nearest(x, now)[0]
            moved = len(x) if old is None else int((nearest(x, old)[0] != to).sum())
            total = np.zeros((k, width))
            np.add.at(total, to, x)
            return np.concatenate([total.ravel(), np.bincount(to, minlength=k), [moved]])

        found = blocks.summed(data, sums)
        size = found[k * width : -1]
        means = found[: k * width].reshape(k, width) / np.maximum(size, 1)[:, None]
        old, centres = centres, np.where(size[:, None] > 0, means, centres)
        if found[-1] == 0:
            break
    data.unpersist()
    return centres, passes
