"""Phrase collocations by level-wise (Apriori) passes over the texts.

Pass k counts the phrases of k words, per language.  Before it, the frequent
phrases of k - 1 words are sent to all tasks, and a phrase is given out only
where both its first and its last k - 1 words are frequent.  What is sent is a
bitmap of their hashes of at most 2**MOST_BITS bits (16 MB), however many they
are: a false hit only lets a phrase be counted that then turns out too rare,
so counts and results are exact.  Each pass combines its counts in the task
and again before the shuffle; only (language, phrase, count) rows move.  The
level tables, saved in the shared folder, then give the counts of both parts
of every cut; a hot part (a word that begins a third of all phrases) is looked
up in a broadcast table of bounded size.

A task works on CHUNK bytes at a time; longer texts go through in chunks that
share the k - 1 words at their seams.  Counts are Spark longs, and scores are
divided as 38-digit decimals, so both are exact (up to 1000 * a * n < 10**38).

Null text is the empty text and a null lang is ``und``; texts without words
give nothing; repeated rows count as often as they are there; a phrase lies
within one piece of one document; equal scores are ordered by count and then
by phrase; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreflow.llm import common

LEAST, LONGEST, TOP = 100, 5, 2000
CHUNK = 8 << 20
#: Phrases written out at a time.
SLICE = 1 << 17
#: The bitmap has some 32 bits for each frequent phrase, within these powers of two.
FEWEST_BITS, MOST_BITS = 15, 27
#: Buckets in which a language's best are found before they are ranked together.
BUCKETS = 64

_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX, _NEXT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def string_hashes(column: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of the bytes of each string."""
    offsets, data = _buffers(column)
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    if len(data):
        place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        powers = np.full(int(sizes.max()), _NEXT, np.uint64)
        powers[0] = 1
        terms = (data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[place]
        some = sizes > 0
        out[some] = np.add.reduceat(terms, offsets[:-1][some])
    return _mixed(out)


def _buffers(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a string column without nulls."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.LargeStringArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


class Words:
    """The words of lower-cased bytes: their places, pieces, and numbers of the distinct (language, word) pairs."""

    def __init__(self, raw: np.ndarray, firsts: np.ndarray, langs: np.ndarray, names: pa.LargeStringArray):
        """``firsts`` are the places where documents begin, ``langs`` the numbers of their languages in ``names``."""
        # Byte tables are applied by translate: an index array would take eight bytes a place.
        low = np.frombuffer(raw.tobytes().translate(_LOWER.tobytes()), np.uint8)
        kind = np.frombuffer(low.tobytes().translate(_KIND.tobytes()), np.uint8)
        inside = kind == 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.starts, ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        whole = _strings(low[inside], ends - self.starts).dictionary_encode()
        self.words, self.names = whole.dictionary, names
        counts = np.diff(np.concatenate([np.searchsorted(self.starts, firsts), [len(self.starts)]]))
        own = np.repeat(langs, counts) * max(1, len(self.words)) + whole.indices.to_numpy(zero_copy_only=False)
        pairs = pa.array(own).dictionary_encode()
        self.id = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = pairs.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang_of, self.word_of = np.divmod(of, max(1, len(self.words)))
        self.kinds = max(1, len(of))

    def hashes(self, size: int) -> np.ndarray:
        """The hash of the ``size`` words from each word on (those that reach over the end are missing)."""
        pair = _mixed(string_hashes(self.words)[self.word_of] + string_hashes(self.names)[self.lang_of] * _NEXT)[self.id]
        out = pair[: max(0, len(pair) - size + 1)]
        for j in range(1, size):
            out = _mixed(out * _NEXT + pair[j : j + len(out)])
        return out

    def counted(self, at: np.ndarray, size: int) -> Iterator[dict[str, pa.Array]]:
        """``lang, phrase, n`` of the phrases of ``size`` words that begin at the words ``at``, written out SLICE of them at a time."""
        code, many, reduced = self.id[at], self.kinds, []
        for j in range(1, size):
            table = None
            if many * self.kinds >= 1 << 62:
                seen = pa.array(code).dictionary_encode()
                table, code = seen.dictionary.to_numpy(zero_copy_only=False), seen.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                many = len(table)
            reduced.append(table)
            code = code * self.kinds + self.id[at + j]
            many *= self.kinds
        found = pa.array(code).value_counts()
        # In the order of the first words, so that neighbouring rows are alike and the shuffle's compression finds them so.
        found = found.take(pc.sort_indices(found.field("values")))
        for begin in range(0, len(found), SLICE):
            some = found.slice(begin, SLICE)
            rest, parts = some.field("values").to_numpy(zero_copy_only=False), []
            for table in reversed(reduced):
                rest, last = np.divmod(rest, self.kinds)
                parts.insert(0, last)
                if table is not None:
                    rest = table[rest]
            parts.insert(0, rest)
            own = [self.words.take(pa.array(self.word_of[p])) for p in parts]
            phrase = pc.binary_join_element_wise(*own, pa.scalar(" ", pa.large_string())) if size > 1 else own[0]
            yield {"lang": self.names.take(pa.array(self.lang_of[rest])), "phrase": phrase, "n": some.field("counts")}


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Words]:
    """The words of the columns lang and text, CHUNK bytes at a time; no phrase of ``size`` words is lost or met twice at a seam."""
    for b in batches:
        langs = b.column("lang").cast(pa.large_string()).dictionary_encode()
        names, code = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, data = _buffers(b.column("text").cast(pa.large_string()))
        row = 0
        while row < b.num_rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            own = data[offsets[row] : offsets[last]]
            if len(own) <= CHUNK:
                # A line feed between the texts ends the piece.
                firsts = offsets[row:last] - offsets[row]
                yield Words(np.insert(own, firsts[1:], 10), firsts + np.arange(last - row), code[row:last], names)
            else:
                begin = end = 0
                while end < len(own):
                    end = min(len(own), end + CHUNK)
                    while end < len(own):  # to the end of the word
                        stop = np.flatnonzero(_KIND[own[end : end + 65536]])
                        end = end + int(stop[0]) if len(stop) else min(len(own), end + 65536)
                        if len(stop):
                            break
                    words = Words(own[begin:end], np.zeros(1, np.int64), code[row : row + 1], names)
                    yield words
                    shared = words.starts[-(size - 1) :] if size > 1 else words.starts[:0]
                    begin = begin + int(shared[0]) if len(shared) else end
            row = last


COUNTS = "lang string, phrase string, n bigint"


def _given_out(batches: Iterator[pa.RecordBatch], size: int, bitmap: np.ndarray | None) -> Iterator[dict]:
    for words in _chunks(batches, size):
        at = np.arange(max(0, len(words.id) - size + 1))
        if bitmap is not None:
            near = _held(bitmap, words.hashes(size - 1))
            at = at[near[at] & near[at + 1] & (words.piece[at] == words.piece[at + size - 1])] if len(at) else at
        if len(at):
            yield from words.counted(at, size)
            if size == 1:  # all words of each language
                every = pa.array(words.lang_of[words.id]).value_counts()
                n = every.field("counts")
                yield {"lang": words.names.take(every.field("values")), "phrase": pa.nulls(len(n), pa.string()), "n": n}


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(level: DataFrame) -> np.ndarray:
    """The bits of the hashes of a level's phrases; its size is bounded, not that of ``level``."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (32 * level.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            langs, phrases = (b.column(c).cast(pa.large_string()) for c in ("lang", "phrase"))
            if not b.num_rows:
                continue
            cut = pc.split_pattern(phrases, " ")
            pair = _mixed(string_hashes(cut.flatten()) + np.repeat(string_hashes(langs), np.diff(cut.offsets.to_numpy())) * _NEXT)
            pair = pair.reshape(b.num_rows, -1)
            out = pair[:, 0]
            for j in range(1, pair.shape[1]):
                out = _mixed(out * _NEXT + pair[:, j])
            yield {"slot": (out >> np.uint64(64 - bits)).astype(np.int64)}

    found = common.map_rows(level.select("lang", "phrase"), slots, "slot bigint").select((F.col("slot") + 1).alias("slot"))
    # At most 2**bits / 32768 rows of 4 KB reach the driver.
    parts = found.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        at = 4096 * (r["part"] - 1)
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)[: len(out) - at]
    return out


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``lang, phrase, n`` of the phrases of 1, 2... ``longest`` words that occur ``least`` times or more, and ``lang, n`` of all words."""
    sc = docs.sparkSession.sparkContext
    texts = common.dealt(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    out: list[DataFrame] = []
    totals = None
    for size in range(1, longest + 1):
        sent = sc.broadcast(_bitmap(out[-1]) if out else None)

        def run(batches: Iterator[pa.RecordBatch], size: int = size, sent=sent) -> Iterator[dict]:
            return _given_out(batches, size, sent.value)

        counts = common.map_rows(texts, run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = common.saved(counts.where(F.col("phrase").isNull() | (F.col("n") >= least)), f"phrases-{size}")
        if size == 1:
            totals = level.where("phrase is null").select("lang", "n")
        out.append(level.where("phrase is not null"))
        if out[-1].isEmpty():
            break
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, within: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by the score of their weakest cut.

    A phrase that lies in a longer one with at least ``within`` per cent of its
    count is left out.  (Some phrase longer by one word then has as many, so
    only those are looked at.)
    """
    tables, totals = levels(docs, least, longest)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    key = lambda phrase: F.struct("lang", F.col(phrase).alias("phrase"))
    counts = every.select(key("phrase").alias("key"), F.col("n").alias("f"))
    words = F.split("phrase", " ")
    joined = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    found = every.withColumn("words", words).where(F.size("words") > 1).select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"),
        joined(F.col("cut") + 1, F.size("words") - F.col("cut")).alias("rest"),
    )
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = common.looked_up(cuts.withColumn("key", key(part)), counts.withColumnRenamed("f", name), "key").drop("key", part)
    cuts = common.looked_up(cuts, totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("down", exact("l") * exact("r"))
    scored = cuts.select("lang", "phrase", "a", "n", F.struct(F.expr("up div down").alias("score"), "cut", "l", "r").alias("cut"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("n").alias("n"), F.min("cut").alias("cut"))
    # The two phrases, shorter by a word, that a phrase holds.
    inner = F.array(joined(F.lit(1), F.size("words") - 1), joined(F.lit(2), F.size("words") - 1))
    longer = found.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(100 * F.coalesce("longer", F.lit(0)) < within * F.col("a"))
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k)),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
    SELECT lang, phrase, k, f, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS p, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS q
    FROM grams, (SELECT unnest(range(1, 5)) AS c) WHERE c < k
), scored AS (
    SELECT g.lang, g.phrase, g.k, g.f AS a, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * g.f * t.n) // (x.f::HUGEINT * y.f) AS score,
        row_number() OVER (PARTITION BY g.lang, g.phrase ORDER BY (1000::HUGEINT * g.f * t.n) // (x.f::HUGEINT * y.f), c) AS place
    FROM cuts g JOIN grams x ON x.lang = g.lang AND x.phrase = g.p JOIN grams y ON y.lang = g.lang AND y.phrase = g.q JOIN totals t ON t.lang = g.lang
), best AS (
    SELECT * FROM scored s WHERE place = 1 AND NOT EXISTS (
        SELECT 1 FROM grams o WHERE o.lang = s.lang AND o.k > s.k AND 100 * o.f >= 100 * s.a AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""
