"""Best-fit packing by patterns: non-negative least squares over the length histogram.

1. Every text is encoded and cut into pieces of at most ``capacity`` ids.
2. The histogram of piece lengths has at most ``capacity`` rows, whatever the
   corpus; it is all that reaches the driver.
3. The driver enumerates patterns of a few lengths that fill a sequence, fits
   their repeat counts to the histogram by non-negative least squares, rounds
   down, and packs what is left over by best fit decreasing, in runs of equal
   lengths.  The result is a plan: runs of equal sequences.
4. Pieces are numbered within their length (counts per length and bucket give
   each bucket its first number, so a hot length is no single task), and the
   number says which run, sequence and offset it takes.  Full pieces, each a
   sequence by itself, need no number.

Null text is the empty text (one end id), repeated rows are packed each, and
an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreflow.llm import common, tokens

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Each document's ids with ``end_id`` behind them, cut after every ``capacity`` ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = tokens.encoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for i, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                    x += tail
                    for k, a in enumerate(range(0, len(x), 4 * capacity)):
                        part = x[a : a + 4 * capacity]
                        for name, v in zip(out, (i, k, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out[name].append(v)
                yield out

    return common.map_rows(common.texts(docs), rows, PIECE)


def enumerate_patterns(lengths: list[int], capacity: int, most_docs: int) -> list[tuple[int, ...]]:
    """For each length, taken as the longest of its sequence: patterns of 1 to ``most_docs`` lengths that fill it best.

    The next length is the largest that fits, or half or a third of the room,
    so that the fit can choose between patterns with few and many documents.
    """
    found: dict[tuple[int, ...], None] = {}

    def fits(room: int) -> int | None:
        k = bisect.bisect_right(lengths, room)
        return lengths[k - 1] if k else None

    for first in lengths:
        for share in range(1, most_docs):
            for last in (share, 1):
                own, room = [first], capacity - first
                for left in range(share, 0, -1):
                    if (x := fits(min(own[0], max(room // left, 0) if last == share else room))) is None:
                        break
                    own.append(x)
                    room -= x
                while len(own) < most_docs and (x := fits(min(room, own[0]))) is not None:
                    own.append(x)
                    room -= x
                found[tuple(sorted(own, reverse=True))] = None
    return list(found)


def fit_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int], steps: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' use of each length close to the histogram in the least squares sense.

    Multiplicative updates: x *= A'h / A'Ax keeps x non-negative and lowers
    the squared error in every step.
    """
    index = {n: i for i, n in enumerate(histogram)}
    rows = np.array([index[n] for p in patterns for n in p], dtype=np.int64)
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    h = np.array(list(histogram.values()), float)
    x = np.full(len(patterns), max(h.sum() / max(len(rows), 1), 1e-3))
    target = np.bincount(cols, h[rows], minlength=len(patterns))
    for _ in range(steps):
        used = np.bincount(rows, x[cols], minlength=len(h))
        x *= target / np.maximum(np.bincount(cols, used[rows], minlength=len(patterns)), 1e-12)
    return x


def plan_runs(histogram: dict[int, int], capacity: int, most_docs: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of one sequence, how many such sequences) that use every length as often as it occurs.

    The work depends on the number of distinct lengths, at most ``capacity``,
    and not on the number of pieces.
    """
    left = {n: c for n, c in sorted(histogram.items()) if c}
    runs: list[tuple[tuple[int, ...], int]] = []
    if full := left.pop(capacity, 0):
        runs.append(((capacity,), full))
    if not left:
        return runs
    patterns = [p for p in enumerate_patterns(list(left), capacity, most_docs) if sum(p) >= 0.98 * capacity]
    if patterns:
        times = np.floor(fit_counts(patterns, left)).astype(int)
        # Fullest first; a pattern is used no more often than its lengths last.
        for k in sorted(np.flatnonzero(times), key=lambda k: (-sum(patterns[k]), patterns[k])):
            p = patterns[k]
            n = min(int(times[k]), *(left[x] // p.count(x) for x in p))
            if n > 0:
                runs.append((p, n))
                for x in p:
                    left[x] -= n
    return runs + best_fit(left, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing in runs: equal sequences are opened, and filled, together."""
    left = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(left)
    runs = []
    while order:
        own: list[int] = []
        room = capacity
        use: dict[int, int] = defaultdict(int)
        while True:
            k = bisect.bisect_right(order, room)
            while k and left[order[k - 1]] - use[order[k - 1]] <= 0:
                k -= 1
            if not k:
                break
            x = order[k - 1]
            own.append(x)
            use[x] += 1
            room -= x
        n = min(left[x] // c for x, c in use.items() if c)
        runs.append((tuple(own), n))
        for x, c in use.items():
            left[x] -= n * c
            if not left[x]:
                del left[x]
                order.pop(bisect.bisect_left(order, x))
    return runs


def pack(found: DataFrame, capacity: int, most_docs: int = 4, bucket_rows: int = 20_000) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece of ``found`` (columns of :data:`PIECE`), which must be saved rows.

    A piece of full length is a sequence by itself and needs no number.  The
    others are numbered within their length: in buckets of about
    ``bucket_rows`` rows, whose counts give each its first number.
    """
    spark = found.sparkSession
    whole = found.where(F.col("length") == capacity)
    alone = whole.select(*found.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    parts = found.where(F.col("length") < capacity)
    # At most ``capacity`` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, -(-max(histogram.values(), default=0) // bucket_rows))
    rows = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    if buckets > 1:  # the buckets of the rows are drawn once
        rows = common.saved(rows, "bucketed-pieces")
    order = Window.partitionBy("length").orderBy("bucket")  # as many rows as buckets
    firsts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", (F.sum("n").over(order) - F.col("n")).alias("first"),
    )
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    numbered = rows.withColumn("k", place).join(firsts, ["length", "bucket"]).select(*found.columns, (F.col("k") + F.col("first")).alias("k"))

    by_length: dict[int, list] = defaultdict(list)
    taken, sequence = defaultdict(int), 0
    for lengths, n in plan_runs(histogram, capacity, most_docs):
        offset = 0
        for x in lengths:
            by_length[x].append((taken[x], sequence, offset))
            taken[x] += n
            offset += x
        sequence += n
    plan = spark.sparkContext.broadcast({x: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for x, v in by_length.items()})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        runs = plan.value
        for b in batches:
            lengths, k = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            for x in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == x)
                begin, seq, off = runs[x]
                run = np.searchsorted(begin, k[own], "right") - 1
                sequence[own] = seq[run] + k[own] - begin[run]
                offset[own] = off[run]
            columns = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield {c: b.column(i) for i, c in enumerate(columns)} | {"sequence_id": sequence, "offset": offset}

    return alone.unionByName(common.map_rows(numbered, placed, PIECE + ", sequence_id bigint, offset bigint"))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, most_docs: int = 4) -> DataFrame:
    # Saved once: encoding is the costly part, and the histogram and the placing both read it.
    return pack(common.saved(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, most_docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.dealt(common.table(spark, sf_dir, "documents")), tokens.tokenizer_path("word_bpe_49k.json"))
