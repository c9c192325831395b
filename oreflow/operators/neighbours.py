"""Exact nearest neighbours, pruned by pivots.

Training rows are dealt to the nearest of up to PIVOTS pivots (a seeded sample
of them), queries too.  Small cells that lie side by side are one group, crowded
ones are cut, so that both kinds of rows are packed into blocks of bounded size.
A block of queries first meets a block of training rows of its own group; the
k-th distance found there bounds the others: a cell can hold a nearer row only
if the distance to its pivot is at most that bound plus the cell's radius.

Then a task takes a block of queries through all blocks of training rows, read
one after the other where they are kept: it measures only the queries that a
block's cells can hold a nearer row for, and keeps the best k of each query.  So
rows are shuffled a fixed number of times, whatever the number of blocks, and
nothing but the final neighbours is written.  No rows but the pivots pass
through the driver.

Where few cells can be left out (many dimensions without structure) the work is
that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from oreflow.functions.values import as_text, col, cols, is_number, known, round_to
from oreflow.operators.cart import few_whole
from oreflow.operators.lineage import kept

PIVOTS = 256
#: Rows and bytes of vectors of a block at most, and the rows below which one is not cut for the sake of more tasks.
BLOCK, BLOCK_BYTES, LEAST_BLOCK = 16_384, 32 << 20, 1_000
#: Queries measured at a time, and the pairs measured exactly at a time.
ASKED, EXACT = 128, 1 << 16
_NEAR = "array<struct<d:double,key:bigint,label:string>>"
_ARROW = pa.schema([("q", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("key", pa.int64()), ("label", pa.string())]))), ("met", pa.int64())])


def matrix(column) -> np.ndarray:
    """A column of arrays of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` from those of ``y``, to rounding."""
    return np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T)


class Cells:
    """Pivots, and the number of rows and the radius of each one's cell."""

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray):
        self.pivots, self.counts, self.radius = pivots, counts, radius

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1))

    def asked(self, d: np.ndarray, bound: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The queries for which one of ``cells`` can hold a row within ``bound``."""
        far = d[:, cells] > (bound[:, None] + self.radius[cells][None]) * (1 + 1e-9) + 1e-9
        return np.flatnonzero(~far.all(axis=1))

    def groups(self, block: int) -> np.ndarray:
        """The group of each cell: cells are taken each next to the last one, while they hold ``block`` rows together."""
        out, left, at, group, held = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), bool), 0, 0, 0
        for _ in range(len(out)):
            left[at] = False
            if held and held + self.counts[at] > block:
                group, held = group + 1, 0
            out[at] = group
            held += self.counts[at]
            if left.any():
                d = ((self.pivots - self.pivots[at]) ** 2).sum(axis=1)
                at = int(np.where(left, d, np.inf).argmin())
        return out


def _reached(rough: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that ``k`` of its numbers keep: the k-th of the least of folds, so that a row is not sorted."""
    fold = max(1, min(64, rough.shape[1] // (16 * k)))
    whole = rough.shape[1] // fold * fold
    least = np.concatenate([np.fmin.reduce(rough[:, :whole].reshape(len(rough), fold, -1), axis=1), rough[:, whole:]], axis=1)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def _best(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and squared distance of the ``k`` nearest rows of ``y`` of each query, in that order; ties by id.

    Rows farther than ``most``, a squared distance for each query, may be left out.
    """
    size, least = (y**2).sum(axis=1), min(k, len(y))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(x) if len(y) else 0, ASKED):
        # The product tells far from near; those about as near as the k-th are measured exactly.
        some, cut = x[at : at + ASKED], most[at : at + ASKED]
        rough, own = some @ y.T, (some**2).sum(axis=1)[:, None]
        rough *= -2
        rough += size
        rough += own
        if not np.isfinite(cut).all():
            cut = np.fmin(cut, np.maximum(_reached(rough, least), 0.0))
        close = rough <= (cut + 1e-9 * (1 + np.where(np.isfinite(cut), cut, 0.0) + np.nanmax(size, initial=0.0) + own[:, 0]))[:, None]
        ends, begin = np.cumsum(close.sum(axis=1)), 0
        while begin < len(some):
            # As many queries as have EXACT pairs, one at least.
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + EXACT, "right")))
            row, col_ = np.nonzero(close[begin:end])
            d = np.concatenate([((y[col_[i : i + EXACT]] - some[begin + row[i : i + EXACT]]) ** 2).sum(axis=1) for i in range(0, max(1, len(row)), EXACT)])
            order = np.lexsort((ids[col_], d, row))
            # ``least`` of each at most, or none of a query that isn't a number.
            chosen = order[np.arange(len(row)) - np.searchsorted(row, row) < least]
            found.append((at + begin + row[chosen], col_[chosen], d[chosen]))
            begin = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class _Search:
    """A block of queries on its way through the blocks of training rows."""

    def __init__(self, raw: bytes, cells: Cells, k: int):
        t = _unpacked(raw)
        self.q, self.x, self.k, self.cells = t.column("q").to_numpy(), matrix(t.column("x")), k, cells
        self.most = t.column("most").to_numpy().copy()
        self.to_pivots, shape = cells.to_pivots(self.x), (len(self.q), k)
        self.d, self.ids, self.codes = np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -1)
        self.labels: dict[str, int] = {}
        self.met = 0

    def meet(self, raw: bytes, own: np.ndarray) -> None:
        asked = self.cells.asked(self.to_pivots, np.sqrt(self.most), own)
        if not len(asked):
            return
        t = _unpacked(raw)
        y, ids, label = matrix(t.column("x")), t.column("id").to_numpy(), t.column("label").combine_chunks().dictionary_encode()
        self.met += len(asked) * len(y)
        row, which, d = _best(self.x[asked], y, ids, self.k, self.most[asked])
        if not len(row):
            return
        some, first, sizes = np.unique(row, return_index=True, return_counts=True)
        at, place = np.repeat(np.arange(len(some)), sizes), np.arange(len(row)) - np.repeat(first, sizes)
        some, k = asked[some], self.k
        codes = np.array([self.labels.setdefault(v, len(self.labels)) for v in label.dictionary.to_pylist()])[label.indices.to_numpy()]
        both = [np.concatenate([old[some], np.full((len(some), k), none)], axis=1) for old, none in ((self.d, np.inf), (self.ids, np.iinfo(np.int64).max), (self.codes, -1))]
        for new, values in zip(both, (d, ids[which], codes[which]), strict=True):
            new[at, k + place] = values
        order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
        self.d[some], self.ids[some], self.codes[some] = (np.take_along_axis(x, order, axis=1) for x in both)
        self.most[some] = np.minimum(self.most[some], self.d[some, k - 1])

    def found(self) -> pa.Table:
        row, place = np.nonzero(self.codes >= 0)
        near = pa.StructArray.from_arrays([
            pa.array(self.d[row, place]), pa.array(self.ids[row, place]), pa.array(list(self.labels), pa.string()).take(pa.array(self.codes[row, place])),
        ], fields=list(_ARROW.field("near").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(self.q)))], pa.int32()), near)
        met = np.zeros(len(self.q), np.int64)
        met[:1] = self.met
        return pa.Table.from_arrays([pa.array(self.q), lists.cast(_ARROW.field("near").type), pa.array(met)], schema=_ARROW)


class Neighbours:
    """The training vectors and how to encode a query; adds ``$KNN-target`` and, for classes, ``$KNNC-target``."""

    def __init__(self, target: str, encoder, numeric: bool, k: int, vectors: DataFrame):
        self.target, self.encoder, self.numeric, self.k, self.vectors = target, encoder, numeric, k, vectors

    @classmethod
    def fit(cls, train: DataFrame, target: str, inputs: list[str], key: str, encoder, k: int = 5) -> Neighbours:
        """``key`` is a whole number by which equally near rows are told apart."""
        numeric = is_number(train, target) and not few_whole(train, target)
        label = known(train, target).cast("double").cast("string") if numeric else as_text(train, target)
        x = F.array(*encoder.columns(train).values()).cast("array<double>")
        rows = train.select(col(key).cast("bigint").alias("id"), label.alias("label"), x.alias("x")).where("label is not null")
        return cls(target, encoder, numeric, max(1, k), kept(rows))

    def nearest(self, asked: DataFrame, block: int | None = None) -> tuple[DataFrame, int, int]:
        """``q, near`` of the rows (id, x) of ``asked``; the pairs of rows in blocks that met, and how many there are in all.

        Without ``block``, blocks are as large as memory lets them be, but so small that the cores share the pairs of blocks.
        """
        k = self.k
        pivots = self.vectors.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(PIVOTS).collect()
        if not pivots:
            raise ValueError("There are no training rows with a known target.")
        centres = np.array([r["x"] for r in pivots], float)
        centres = whole if len(whole := centres[np.isfinite(centres).all(axis=1)]) else centres

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    d = np.nan_to_num(Cells(centres, np.zeros(0), np.zeros(0)).to_pivots(matrix(b.column("x"))), nan=np.inf)
                    own = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], names=[*b.schema.names, "cell", "d"])

        dealt = kept(self.vectors.select("id", "label", "x").mapInArrow(deal, "id bigint, label string, x array<double>, cell int, d double"))
        counts, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.when(F.col("d") < float("inf"), F.col("d")).otherwise(0.0)).alias("d")).collect():  # at most PIVOTS rows
            counts[r["cell"]], radius[r["cell"]] = r["n"], r["d"]
        queries = kept(asked.select("id", "x").mapInArrow(deal, "id bigint, x array<double>, cell int, d double"))
        crowds = np.zeros(len(centres), np.int64)
        for r in queries.groupBy("cell").count().collect():  # at most PIVOTS rows
            crowds[r["cell"]] = r["count"]

        cells, cores = Cells(centres, counts, radius), asked.sparkSession.sparkContext.defaultParallelism
        most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, centres.shape[1]))))
        if block is None:
            block = min(most, max(LEAST_BLOCK, -(-int(counts.sum()) // int(np.ceil(np.sqrt(4 * cores))))))
        # Every block of queries is a task that reads all training rows: as large as may be, while all cores have some.
        many = max(1, min(most, max(LEAST_BLOCK // 4, -(-int(crowds.sum()) // (4 * cores)))))
        group_of = cells.groups(block)
        cells_of = [np.flatnonzero((group_of == g) & (counts > 0)) for g in range(group_of.max() + 1)]
        parts = np.maximum(1, -(-np.bincount(group_of, counts).astype(np.int64) // block))
        asks = -(-np.bincount(group_of, crowds).astype(np.int64) // many)
        starts = np.cumsum(asks) - asks  # the first number of each group's blocks of queries

        of = lambda n: F.get(F.lit(n.tolist()), F.col("part"))
        grouped = lambda rows: rows.withColumn("part", F.get(F.lit(group_of.tolist()), "cell").cast("int"))
        dealt_to = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        right = grouped(dealt).withColumn("b", dealt_to(of(parts)))
        # A block of training rows bounds the blocks of queries that its number stands for.
        bounds = right.where(of(asks) > F.col("b")).select(
            "id", "label", "x", F.explode(F.sequence(of(starts) + F.col("b"), of(starts) + of(asks) - 1, of(parts))).alias("number"),
        )
        left = grouped(queries).select("id", "x", (of(starts) + dealt_to(of(asks))).alias("number"))

        def bounded(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
            far = np.full(q.num_rows, np.inf)
            if t.num_rows >= k and q.num_rows:
                row, _, d = _best(matrix(q.column("x")), matrix(t.column("x")), t.column("id").to_numpy(), k, far)
                last = np.flatnonzero(np.bincount(row, minlength=q.num_rows) == k)
                far[last] = d[np.searchsorted(row, last, "right") - 1]
            if not q.num_rows:
                return pa.table({"number": pa.array([], pa.int64()), "queries": pa.array([], pa.binary())})
            own = pa.table({"q": q.column("id"), "x": q.column("x"), "most": pa.array(far)})
            return pa.table({"number": pa.array([key[0].as_py()], pa.int64()), "queries": pa.array([_packed(own)], pa.binary())})

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "vectors": pa.array([_packed(t.select(["id", "label", "x"]))], pa.binary())})

        def search(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple[bytes]]:
            found: dict[int, _Search] = {}
            for ours, theirs in pairs:
                if ours["number"] not in found:
                    found[ours["number"]] = _Search(bytes(ours["queries"]), cells, k)
                found[ours["number"]].meet(bytes(theirs["vectors"]), cells_of[theirs["part"]])
            for x in found.values():
                yield (_packed(x.found()),)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for raw in b.column(0):
                    yield from _unpacked(raw.as_py()).to_batches()

        training = kept(right.select("id", "label", "x", "part", "b").groupBy("part", "b").applyInArrow(pack, "part int, vectors binary"))
        first = kept(left.groupBy("number").cogroup(bounds.groupBy("number")).applyInArrow(bounded, "number bigint, queries binary"))
        # A number is a task; the training rows are one partition, read anew for each block of queries and nowhere gathered.
        tasks = first.repartitionByRange(max(1, int(asks.sum())), "number").rdd.cartesian(training.rdd.coalesce(1))
        near = kept(asked.sparkSession.createDataFrame(tasks.mapPartitions(search), "found binary").mapInArrow(unpack, f"q bigint, near {_NEAR}, met bigint"))
        return near.select("q", "near"), near.agg(F.sum("met")).first()[0] or 0, int(counts.sum()) * int(crowds.sum())

    def transform(self, df: DataFrame, block: int | None = None) -> DataFrame:
        x = F.array(*self.encoder.columns(df).values()).cast("array<double>")
        asked = kept(df.select("*", F.monotonically_increasing_id().alias("__q"), x.alias("__x")))
        near, _, _ = self.nearest(asked.select(F.col("__q").alias("id"), F.col("__x").alias("x")), block)
        out = asked.join(near.select(F.col("q").alias("__q"), F.col("near").alias("__near")), "__q", "left")
        if self.numeric:
            return out.select(*cols(df.columns), self._mean().alias(f"$KNN-{self.target}"))
        # The commonest label; of equally common ones that of the nearest row.
        votes = lambda v: F.size(F.filter("__near", lambda r: r["label"] == v["label"]))
        ranked = F.transform("__near", lambda v, i: F.struct(votes(v).alias("n"), (-i).alias("i"), v["label"].alias("label")))
        out = out.withColumn("__v", F.array_max(ranked))
        share = round_to(F.col("__v")["n"] / F.size("__near"))
        return out.select(*cols(df.columns), F.col("__v")["label"].alias(f"$KNN-{self.target}"), share.alias(f"$KNNC-{self.target}"))

    @staticmethod
    def _mean() -> Column:
        return F.aggregate("__near", F.lit(0.0), lambda acc, r: acc + r["label"].cast("double")) / F.size("__near")
