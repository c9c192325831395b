"""Token-ID / binary output: Re-Pair grammar compression per shard with random access.

The rows are dealt by ranges of ``doc_id`` and sorted, so shards follow one
another in ascending id order.  A shard row holds

* ``doc_ids``, ``lengths`` (ids per document) and ``symbols_per_doc``;
* ``before``: ids in the earlier shards of its range partition;
* ``rules``: uint32 pairs (left, right); rule k makes symbol ``base + k``;
* ``rule_lengths``: uint32, the number of ids that each rule expands to;
* ``symbols``: the uint32 stream left after all replacements.

Replacements never cross documents, so one document, or one span of ids of it,
decodes from its own symbols: the prefix sums of the symbols' expansion
lengths say which to expand.  Files are written by Spark (Parquet rows with
binary cells), so retries and lost executors leave no partial shard.

A document longer than a shard is a shard by itself; compressing one takes
some 60 bytes an id, so a text of 100 MB (20 million ids) needs 1.2 GB.

Null text is the empty text (one end id), a null ``doc_id`` sorts first,
repeated rows are kept, ties of ``doc_id`` are ordered by text, and an empty
table gives an empty dataset.  Columns beside the two used are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common, tokens

FORMAT = "part int, block int, doc_ids array<bigint>, lengths array<int>, symbols_per_doc array<int>, n_ids bigint, before bigint, base bigint, rules binary, rule_lengths binary, symbols binary"
#: Odd factors of the pair hash, one for each round in turn.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: A rule takes two symbols and a length: each made takes fewer numbers than the symbols it saves, so the output never grows.
MIN_COUNT = 4
#: Characters of texts encoded at a time, but for longer single ones.
ENCODED_CHARS = 4 << 20


def _counted(key: np.ndarray, exact: bool, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each key occurs, and its slot.

    A key whose hash meets another's has no slot in this turn (count -1);
    ``exact`` sorts instead, so that every key has one.
    """
    if exact:
        _, slot, counts = np.unique(key, return_inverse=True, return_counts=True)
        return counts[slot], slot
    bits = max(10, int(len(key)).bit_length())
    slot = ((key * np.uint64(_MULTIPLIERS[turn % len(_MULTIPLIERS)])) >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.empty(1 << bits, np.uint64)
    owner[slot] = key
    own = owner[slot] == key
    counts = np.bincount(slot[own], minlength=1 << bits)[slot]
    counts[~own] = -1
    return counts, slot


def compress(ids: np.ndarray, ends: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds, to the end: until no pair has ``min_count`` replaceable occurrences.

    In each round a pair is replaced where it is more frequent than the pairs
    that overlap it (ties: by its symbols), so the most frequent pair of the
    shard is always replaced everywhere, and with it all others that don't
    compete with a more frequent one.  A pair left with fewer than
    ``min_count`` such places waits for a later round.  A pair once found to be
    rarer is never counted again: replacements only make old pairs rarer.
    ``ends`` marks each document's last id; no pair crosses one.  Returns
    symbols, their end marks, rules (n x 2) and the rules' expansion lengths.
    """
    n = len(ids)
    seq, last = ids.astype(np.uint32), ends.astype(bool)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # the symbols' neighbours
    gone = np.zeros(n, bool)
    live = ~last  # places whose pair may still be frequent
    rules: list[np.ndarray] = []
    sizes = np.zeros(0, np.uint32)
    made = turn = 0
    exact = False
    while True:
        at = np.flatnonzero(live)
        right = after[at]
        a, b = seq[at], seq[right]
        # Of a run of one symbol, the pairs at odd places overlap those before them.
        if len(same := np.flatnonzero(a == b)):
            place = np.arange(len(same))
            start = np.ones(len(same), bool)
            start[1:] = (same[1:] - same[:-1] != 1) | (right[same[:-1]] != at[same[1:]])
            stay = np.ones(len(at), bool)
            stay[same[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 1]] = False
            at, right, a, b = at[stay], right[stay], a[stay], b[stay]
        key = (a.astype(np.uint64) << np.uint64(32)) | b
        counts, slot = _counted(key, exact, turn)
        turn += 1
        live[at[(counts >= 0) & (counts < min_count)]] = False
        # Against the pair one place before or behind: the greater (count, key) stands.
        near = right[:-1] == at[1:]
        first = counts[:-1] > counts[1:]
        even = np.flatnonzero(counts[:-1] == counts[1:])
        first[even] = key[even] > key[even + 1]
        stands = counts >= min_count
        stands[1:] &= ~(near & first)
        stands[:-1] &= ~near | first
        stands = np.flatnonzero(stands)
        slot = slot[stands]
        used = np.bincount(slot) >= min_count if len(slot) else np.zeros(1, bool)
        if not used.any():
            if exact:
                break
            exact = True  # the last few pairs may have met in their hashes
            continue
        exact = False
        good = used[slot]
        stands, slot = stands[good], slot[good]
        at, right, key, symbol = at[stands], right[stands], key[stands], (np.cumsum(used) - 1)[slot]
        keys = np.empty(int(symbol.max()) + 1, np.uint64)
        keys[symbol] = key
        new = np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        sizes = np.r_[sizes, expansion_lengths(new.ravel(), base, sizes).reshape(-1, 2).sum(axis=1).astype(np.uint32)]
        rules.append(new)
        seq[at] = symbol.astype(np.uint32) + np.uint32(base + made)
        made += len(new)
        gone[right], live[right] = True, False
        last[at] = last[right]
        after[at] = behind = after[right]
        before[behind] = at
        live[at] = ~last[at]  # pairs with a new symbol on either side
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        live[ahead] = ~last[ahead]
    return seq[~gone], last[~gone], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), sizes


def expansion_lengths(symbols: np.ndarray, base: int, rule_lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.uint32)
    big = symbols >= base
    out[big] = rule_lengths[symbols[big] - np.uint32(base)]
    return out


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, rule_lengths: np.ndarray) -> np.ndarray:
    """The ids behind ``symbols``: every part of a rule goes straight to its place, level by level."""
    sizes = expansion_lengths(symbols, base, rule_lengths)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = np.empty(int(sizes.sum(dtype=np.int64)), np.uint32)
    while len(symbols):
        big = symbols >= base
        out[at[~big]] = symbols[~big]
        at, pair = at[big], rules[symbols[big] - np.uint32(base)]
        symbols = pair.ravel()
        at = np.stack([at, at + expansion_lengths(pair[:, 0], base, rule_lengths)], axis=1).ravel()
    return out


def read_span(shard: dict, doc: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of the shard's document number ``doc``, expanding only the symbols that cover them."""
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    first = sum(shard["symbols_per_doc"][:doc])
    own = np.frombuffer(shard["symbols"], "<u4")[first : first + shard["symbols_per_doc"][doc]]
    lengths = np.frombuffer(shard["rule_lengths"], "<u4")
    places = np.r_[0, np.cumsum(expansion_lengths(own, shard["base"], lengths), dtype=np.int64)]
    end = min(end, int(places[-1]))
    if begin >= end:
        return np.zeros(0, np.uint32)
    a, b = int(np.searchsorted(places, begin, "right")) - 1, int(np.searchsorted(places, end, "left"))
    return expand(own[a:b], shard["base"], rules, lengths)[begin - places[a] : end - places[a]]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = 1_000_000) -> None:
    """Encode ``docs`` (doc_id, text) and write shards of about ``block_ids`` ids to ``path``."""
    spark = docs.sparkSession
    # As many ranges as spark.sql.shuffle.partitions says; a task holds one shard at a time, however long its range is.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Ranges of id and the text's begin (a range's bounds are short, however long the texts are), so rows of one id need not be one task.
    order = F.col("doc_id").asc_nulls_first()
    ordered = common.texts(docs).repartitionByRange(n, order, F.substring("text", 1, 64)).sortWithinPartitions(order, "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = tokens.encoder(tokenizer)
        base = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        tail = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        lengths: list[int] = []

        def close() -> dict:
            nonlocal block, before
            n_ids = np.array(lengths)
            ends = np.zeros(n_ids.sum(), bool)
            ends[np.cumsum(n_ids) - 1] = True
            symbols, last, rules, sizes = compress(np.frombuffer(b"".join(ids), "<u4"), ends, base)
            out = {
                "part": [part], "block": [block], "doc_ids": [list(names)], "lengths": [list(lengths)],
                "symbols_per_doc": [np.diff(np.r_[-1, np.flatnonzero(last)]).tolist()], "n_ids": [int(n_ids.sum())], "before": [before],
                "base": [base], "rules": [rules.astype("<u4").tobytes()], "rule_lengths": [sizes.astype("<u4").tobytes()],
                "symbols": [symbols.astype("<u4").tobytes()],
            }
            block += 1
            before += int(n_ids.sum())
            ids.clear(), names.clear(), lengths.clear()
            return out

        held = 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                for i, x in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist(), ENCODED_CHARS), strict=True):
                    ids.append(x + tail)
                    names.append(i)
                    lengths.append(len(x) // 4 + 1)
                    held += lengths[-1]
                    if held >= block_ids:
                        yield close()
                        held = 0
        if names:
            yield close()

    common.map_rows(ordered, shards, FORMAT).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written shards, each with ``shard_start``: the ids in all shards before it.

    Only one total per range partition goes to the driver; that number is the
    partition count, which is configured and doesn't follow the rows.
    """
    shards = spark.read.schema(FORMAT).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in totals:
        starts.append((r["part"], at))
        at += r["n"]
    firsts = F.broadcast(spark.createDataFrame(starts, "part int, part_start bigint"))
    return shards.join(firsts, "part").withColumn("shard_start", F.col("part_start") + F.col("before"))


def documents(shards: DataFrame) -> DataFrame:
    """One row per document from :func:`read`'s shards: doc_id, start, n_tokens and the crc32 of its decoded ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in range(b.num_rows):
                number = lambda name, b=b, r=r: b.column(name)[r].as_py()
                words = lambda name, b=b, r=r: np.frombuffer(b.column(name)[r].as_buffer(), "<u4")
                flat = expand(words("symbols"), number("base"), words("rules").reshape(-1, 2), words("rule_lengths")).astype("<u4", copy=False)
                edges = np.r_[0, np.cumsum(b.column("lengths")[r].values.to_numpy(), dtype=np.int64)]
                raw, places = memoryview(flat).cast("B"), (4 * edges).tolist()
                yield {
                    "doc_id": b.column("doc_ids")[r].values, "start": edges[:-1] + number("shard_start"), "n_tokens": np.diff(edges),
                    "ids_crc32": [zlib.crc32(raw[a:z]) for a, z in zip(places, places[1:], strict=False)],
                }

    needed = shards.select("doc_ids", "lengths", "shard_start", "base", "rules", "rule_lengths", "symbols")
    return common.map_rows(needed, rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "token-ids")
    write(common.table(spark, sf_dir, "documents"), path, tokens.tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return documents(read(spark, path))
