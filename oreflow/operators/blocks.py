"""Rows as dense blocks of numbers, and sums over them: what iterative fits read once a step.

:func:`blocked` turns a vector Column into rows that hold up to SIZE vectors
as one binary matrix, kept in the shared folder and cached, so that a step is
one narrow pass: each task adds up its blocks with numpy, the tasks' sums are
added in groups of FAN, and one row of sums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.operators.lineage import kept

SIZE, FAN = 4096, 128
#: Bytes of sums that reach the driver at once.
GATHERED = 64 << 20
#: Bytes of blocks in a cached partition.
PART = 64 << 20
SUMS = "part int, sums binary"


def blocked(df: DataFrame, vector: Column, y: Column | None = None, pos: Column | None = None) -> DataFrame:
    """``pos, n, x, y``: the first place, number, vectors and classes of each block; rows stay where they are, in their order."""
    rows = df.select(vector.cast("array<double>").alias("x"), (F.lit(0) if y is None else y).cast("int").alias("y"), (F.lit(0) if pos is None else pos).cast("bigint").alias("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SIZE):
                b = whole.slice(at, SIZE)
                x = b.column(0).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [b.column(2).slice(0, 1), pa.array([b.num_rows], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().tobytes()], pa.binary())],
                    names=["pos", "n", "x", "y"],
                )

    return held(kept(rows.mapInArrow(run, "pos bigint, n int, x binary, y binary")), "x")


def held(data: DataFrame, column: str) -> DataFrame:
    """``data`` cached in as many partitions as there are cores, or more of some PART bytes of ``column`` each: a step is one wave of tasks."""
    rows, size = data.agg(F.count("*"), F.sum(F.octet_length(column))).first()
    parts = max(data.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // PART))
    return data.coalesce(max(1, min(rows, parts))).persist()


def joined(data: DataFrame) -> DataFrame:
    """The blocks of at most SIZE rows in all as one block, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(matrices(batches))
        if found:
            x, y = np.concatenate([x for _, x, _ in found]), np.concatenate([y for _, _, y in found])
            yield pa.RecordBatch.from_pydict({"pos": [0], "n": pa.array([len(x)], pa.int32()), "x": [x.tobytes()], "y": [y.tobytes()]})

    return data.coalesce(1).mapInArrow(run, "pos bigint, n int, x binary, y binary")


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, vectors and classes of each block."""
    for b in batches:
        for pos, n, x, y in zip(*(b.column(c).to_pylist() for c in ("pos", "n", "x", "y")), strict=True):
            yield pos, np.frombuffer(x, float).reshape(n, -1), np.frombuffer(y, np.int32)


def summed(data: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``of(x, y)``, a vector of fixed length; added in the order of partitions and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x, y in matrices(batches):
            own = of(x, y)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": [total.tobytes()]})

    return gathered(data.mapInArrow(run, SUMS), data.rdd.getNumPartitions())


def gathered(found: DataFrame, parts: int, size: int = 0) -> np.ndarray:
    """The sum of the rows of :data:`SUMS`, one for each of ``parts`` partitions and of some ``size`` bytes, in the order of partitions."""
    fan = max(4, min(FAN, GATHERED // max(1, size)))
    while parts > fan:
        parts = -(-parts // fan)
        # The key goes to the group beside its rows, so it has a name of its own.
        found = found.groupBy((F.col("part") / fan).cast("int").alias("group")).applyInArrow(_added, SUMS)
    rows = sorted(found.collect(), key=lambda r: r["part"])  # at most fan rows
    if not rows:
        raise ValueError("There are no rows to fit.")
    return np.sum([np.frombuffer(r["sums"], float) for r in rows], axis=0)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist(), strict=True))
    total = np.sum([np.frombuffer(s, float) for _, s in rows], axis=0)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": [total.tobytes()]})
