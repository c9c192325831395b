"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
the pairwise interactions of all features, in time linear in the features.

Features of a whole text: hashed words with log counts scaled to unit length,
and, standardised, the statistics of :data:`STATISTICS` and the declared number
of characters.  The model is fitted on a bounded sample of the labelled rows
(``max_rows``, those with the smallest hash of their id, the same at every
run); scoring reads every row and shuffles nothing.

Null text is the empty text, which gets the score of a text without words; a
null number of characters is that of the text; repeated rows are scored each
(in the fit a labelled id counts once, with its smallest text); ids may be of
any type; an empty table gives no rows; without labels of both kinds every
score is the share of good labels (1 without labels).  All columns are kept,
but one named as the score's column is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common

WORD_DIMS = 1 << 14
STATISTICS = (
    "log words", "mean word length", "symbols", "digits", "capitals", "punctuation", "non-ASCII bytes", "distinct words", "commonest word",
    "repeated lines", "log characters", "declared characters",
)
DIMS = WORD_DIMS + len(STATISTICS)
RANK = 8
#: Labelled rows that the fit reads at most.
MAX_ROWS = 5000
#: At this score a document counts as good.
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)
_KIND[list(b"#*$%&|<>")] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[list(b".,;:!?'\"()-")] = 4
_KIND[128:] = 5
_buckets: dict[str, int] = {}
common.keeps(_buckets.clear)


def _bucket(word: str) -> int:
    found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIMS
    if len(_buckets) < 100_000:
        _buckets[word] = found
    return found


def features(text: str, declared: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word dimensions, their values, and the raw statistics."""
    words = text.split()
    n = len(words)
    get = _buckets.get
    ids = np.fromiter((b if (b := get(w)) is not None else _bucket(w) for w in words), np.int64, n)
    dims, counts = np.unique(ids, return_counts=True)
    values = 1 + np.log(counts)
    values /= max(1e-9, math.sqrt(float(values @ values)))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=6) / max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    chars = len(text)
    stats = [
        math.log1p(n), chars / max(1, n), *kinds[1:6], len(dims) / max(1, n), counts.max() / n if n else 0,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(chars), math.log1p(max(0, chars if declared is None else declared)),
    ]
    return dims, values, np.array(stats)


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def rows(self, batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The batch as sparse rows: dimensions, values, and each row's first place."""
        extra = np.arange(WORD_DIMS, DIMS)
        scaled = np.clip((np.array([s for _, _, s in batch]).reshape(-1, len(STATISTICS)) - self.mean) / self.sd, -4, 4) / math.sqrt(len(STATISTICS))
        dims = np.concatenate([x for d, _, _ in batch for x in (d, extra)])
        values = np.concatenate([x for (_, v, _), s in zip(batch, scaled, strict=True) for x in (v, s)])
        starts = np.cumsum([0, *[len(d) + len(extra) for d, _, _ in batch]])[:-1]
        return dims, values, starts

    def raw_score(self, dims: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[dims] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[dims] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        if not batch:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw_score(*self.rows(batch))[0], -30, 30)))


def fit(
    batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = 12, rate: float = 0.03,
    decay: float = 1e-5, seed: int = 7,
) -> Model:
    """Logistic loss, Adam on blocks of 128 rows, seeded."""
    stats = np.array([s for _, _, s in batch]).reshape(-1, len(STATISTICS))
    share = float(labels.mean()) if len(labels) else 1.0
    rng = np.random.default_rng(seed)
    m = Model(
        0.0, np.zeros(DIMS), rng.normal(0, 0.05, (DIMS, rank)), stats.mean(axis=0) if len(stats) else np.zeros(len(STATISTICS)),
        np.maximum(stats.std(axis=0), 1e-6) if len(stats) else np.ones(len(STATISTICS)),
    )
    if share in (0.0, 1.0):
        return Model(30.0 if share else -30.0, m.w, m.v * 0, m.mean, m.sd)
    m.w0 = math.log(share / (1 - share))
    first = {"w": np.zeros_like(m.w), "v": np.zeros_like(m.v)}
    second = {"w": np.zeros_like(m.w), "v": np.zeros_like(m.v)}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(batch))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            dims, values, starts = m.rows([batch[k] for k in some])
            z, sums = m.raw_score(dims, values, starts)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            owner = np.repeat(np.arange(len(some)), np.diff(np.r_[starts, len(dims)]))
            gx = g[owner] * values
            step += 1
            grad = {"w": np.bincount(dims, gx, minlength=DIMS) + decay * m.w}
            own = m.v[dims]
            part = gx[:, None] * (sums[owner] - own * values[:, None])
            grad["v"] = np.stack([np.bincount(dims, part[:, f], minlength=DIMS) for f in range(rank)], axis=1) + decay * m.v
            m.w0 -= rate * float(g.sum())
            for name in ("w", "v"):
                first[name] = 0.9 * first[name] + 0.1 * grad[name]
                second[name] = 0.99 * second[name] + 0.01 * grad[name] ** 2
                setattr(m, name, getattr(m, name) - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8))
    return m


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text_col: str = "text", chars_col: str = "n_chars") -> Model:
    """A model of ``labels.quality`` from at most ``max_rows`` labelled rows that aren't held out."""
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = own.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    found = docs.select(
        "doc_id",
        F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(chars_col).cast("long").alias("declared")).alias("row"),
    )
    # One row of each id, so that max_rows bounds what is collected also where an id is repeated.
    rows = found.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("row").alias("row")).select("quality", "row.text", "row.declared")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        common.forget()
        for b in batches:
            found = [features(x, c) for x, c in zip(b.column("text").to_pylist(), b.column("declared").to_pylist(), strict=True)]
            yield {
                "quality": b.column("quality"), "dims": [d.astype("<u2").tobytes() for d, _, _ in found],
                "values": [v.astype("<f4").tobytes() for _, v, _ in found], "stats": [s.tolist() for _, _, s in found],
            }

    schema = "quality int, dims binary, values binary, stats array<double>"
    got = sorted(common.map_rows(rows, measure, schema).collect(), key=lambda r: (r["dims"], r["values"], r["stats"], r["quality"]))
    batch = [(np.frombuffer(r["dims"], "<u2").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float), np.array(r["stats"])) for r in got]
    return fit(batch, np.array([r["quality"] for r in got], float))


def scored(docs: DataFrame, model: Model, out_col: str = "score", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with a score of every row in ``out_col``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(*[c for c in docs.columns if c.lower() == out_col.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        m = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = m.score([features(x or "", c) for x, c in zip(b.column(text_col).to_pylist(), b.column(chars_col).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, out_col])
        common.release()

    from pyspark.sql.types import DoubleType, StructType

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add(out_col, DoubleType()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.dealt(common.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
