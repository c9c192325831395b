"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases (each the shortest string not yet in the
text's own dictionary); a rest at the end that is no new phrase by itself
becomes one by the end sign behind it, so the phrases tell the whole text.
The set of phrases is hashed and its minimum hashes under a fixed family are
the fingerprint.  Texts that would compress well
together share phrases, so the share of equal minima is a compression-like
likeness between 0 and 1.

:func:`with_next` compares each document with an edited copy and with its
successor by ``doc_id``.  Rows are dealt by ranges of ``doc_id`` and sorted;
only the first and last row of each range are paired across ranges, through a
small table.  One shuffle of the texts, no window over all rows.

A task holds two texts at a time, each with some 60 bytes a code point.
Null text is the empty text, whose fingerprint is all ones; texts under four
code points are edited to themselves; ties of ``doc_id`` are ordered by text
and a null id comes first; a single document is its own successor; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common

HASHES = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240611)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base``; the first 65,536 are kept by the worker, more only as long as they are needed."""
    if base not in _tables:
        _tables[base] = _row(base, 1 << 16)
    return _tables[base] if n <= 1 << 16 else _row(base, n)


def _row(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


#: Stands behind a rest that is no new phrase; no text has it, as Spark's strings have no surrogates.
END = "\ud800"


def phrases(text: str, known: list[str] | None = None) -> list[str]:
    """LZ78 phrases of ``text`` given those already known; the last may be a known one with :data:`END` behind it."""
    seen = set(known or ())
    add, out = seen.add, []
    put, p = out.append, ""
    for ch in text:
        p += ch
        if p not in seen:
            add(p)
            put(p)
            p = ""
    if p:
        put(p + END)
    return out


def phrase_hashes(text: str, lengths: list[int]) -> np.ndarray:
    """A 64-bit hash of each of the phrases of ``text``, of the given lengths, from prefix sums of one polynomial."""
    n = sum(lengths)
    if not n:
        return np.zeros(0, np.uint64)
    if n > len(text):
        text += END
    codes = np.frombuffer(text[:n].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers(_BASE, n)[:n], out=sums[1:])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each minimum hash."""
    if not len(hashes):
        return np.full(HASHES, 0xFFFF, np.uint16)
    least = np.min([(hashes[at : at + 1024, None] * _A + _B).min(axis=0) for at in range(0, len(hashes), 1024)], axis=0)
    return (least >> np.uint64(24)).astype(np.uint16)


def text_form(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


class Parsed:
    """A text with its phrases, their hashes and its fingerprint."""

    __slots__ = ("hashes", "lengths", "own", "sig", "text")

    def __init__(self, text: str):
        self.text, self.own = text, phrases(text)
        self.lengths = list(map(len, self.own))
        self.hashes = phrase_hashes(text, self.lengths)
        self.sig = signature(self.hashes)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by the start of ``other``, and that text's fingerprint.

        The parse up to the edit is the same, so it goes on from the last
        phrase that ends before it.
        """
        n = len(self.text)
        cut = n - n // 4
        text = self.text[:cut] + other[: n // 4]
        own = self.lengths[:-1] if self.own and self.own[-1][-1] == END else self.lengths
        ends = np.cumsum(own) if own else np.zeros(0, int)
        k = int(np.searchsorted(ends, cut, "right"))
        rest = text[int(ends[k - 1]) if k else 0 :]
        more = phrases(rest, self.own[:k])
        return text, signature(np.concatenate([self.hashes[:k], phrase_hashes(rest, list(map(len, more)))]))


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _compared(doc_id: int | None, own: Parsed, other: Parsed) -> tuple:
    text, sig = own.edited(other.text)
    return doc_id, len(own.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text_form(own.sig), text_form(sig), likeness(own.sig, sig), likeness(own.sig, other.sig)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column(0), "fingerprint": [text_form(Parsed(x).sig) for x in b.column(1).to_pylist()]}

    return common.map_rows(common.texts(docs, id_col, text_col), run, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """The columns of :data:`RESULT` for every document."""
    spark = docs.sparkSession
    order = F.col("doc_id").asc_nulls_first()
    # As many ranges as spark.sql.shuffle.partitions says; a task holds two texts and a batch, however long its range is.
    # Ranges of id and the text's begin (a range's bounds are short, however long the texts are), so rows of one id need not be one task.
    ranges = common.texts(docs).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order, F.substring("text", 1, 64))
    ordered = ranges.sortWithinPartitions(order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        before: tuple[int | None, Parsed] | None = None

        def block(rows: list[tuple], edges: list[tuple[int, int | None, str]]) -> dict:
            rows = rows + [(i, *[None] * (len(_NAMES) - 1)) for _, i, _ in edges]
            out = {name: [r[k] for r in rows] for k, name in enumerate(_NAMES)}
            none = [None] * (len(rows) - len(edges))
            return out | {"part": [part] * len(rows), "edge": [0] * len(none) + [e for e, _, _ in edges], "text": none + [t for _, _, t in edges]}

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, edges = [], []
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    now = Parsed(x)
                    if before is None:
                        edges.append((1, i, x))
                    else:
                        rows.append(_compared(*before, now))
                    before = (i, now)
                yield block(rows, edges)
        if before is not None:
            yield block([], [(2, before[0], before[1].text)])

    found = common.saved(common.map_rows(ordered, run, RESULT + ", part int, edge int, text string"), "fingerprints")
    # One number for each range partition that has rows; their count is configured.
    parts = sorted(r["part"] for r in found.where("edge = 1").select("part").collect())
    follow = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, other int")
    first = found.where("edge = 1").select(F.col("part").alias("other"), F.col("text").alias("next_text"))
    ends = found.where("edge = 2").select("doc_id", "text", "part").join(F.broadcast(follow), "part").join(first, "other").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [_compared(i, Parsed(x), Parsed(y)) for i, x, y in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield {name: [r[k] for r in rows] for k, name in enumerate(_NAMES)}

    return found.where("edge = 0").select(*_NAMES).union(common.map_rows(ends, finish, RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(common.table(spark, sf_dir, "documents"))
