"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the code points cuts every text into chunks whose borders
depend on the content alone, so a passage that two documents share gives the
same chunks in both.  Chunks found more than once in the corpus are encoded
once, by the document that owns their first occurrence, and their ids are
joined to every other document; the rest are encoded in place.  Chunk joins
are then repaired: the tokens around each join are encoded again as one text,
and that window grows until its outer ids agree with those on both sides.

Shuffles: the chunk hashes (16 bytes a chunk), the texts once (both joins use
one exchange), and the ids of shared chunks only.

Null text is the empty text, a null ``doc_id`` is encoded like any other row,
repeated ids and rows are kept (shared ids are looked up by chunk hash, never
by place), a text without any blank costs no more than others of its length,
and an empty table gives no rows.  Columns beside the two used are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common, tokens

_WINDOW = 16
_MULTIPLIER = 0x9E3779B1
#: Tokens on either side of a join that are encoded again at first, and how many at each end must come out as before.
REACH, AGREE = 16, 2


def chunk_starts(text: str, average: int = 1024, least: int = 128, most: int = 8192) -> list[int]:
    """Starts of a text's chunks (code points): after each window of 16 whose rolling hash has its low bits zero."""
    n = len(text)
    if not n:
        return []
    if n <= least:
        return [0]
    h = np.frombuffer(text.encode("utf-32-le"), "<u4") * np.uint32(_MULTIPLIER)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x85EBCA6B)
    step, power = 1, 0x2C1B3C6D
    while step < _WINDOW:  # the hash of 2k code points from two of k
        grown = h.copy()
        grown[step:] += h[:-step] * np.uint32(power)
        h, step, power = grown, 2 * step, power * power & 0xFFFFFFFF
    places = (np.flatnonzero((h >> np.uint32(8)) % np.uint32(average) == 0) + 1).tolist()
    out, last = [0], 0
    for p in [*places, n]:
        while p - last > most:
            last += most
            out.append(last)
        if p - last >= least and p < n:
            out.append(p)
            last = p
    return out


def chunks(text: str) -> list[str]:
    s = [*chunk_starts(text), len(text)]
    return [text[a:b] for a, b in zip(s, s[1:], strict=False)]


def chunk_hash(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode(), digest_size=16).digest()


def _aligned(ids: np.ndarray, k: int, table: list[bytes], step: int) -> int:
    """``k``, moved by ``step`` until no character is cut before the token at place ``k``."""
    while 0 < k < len(ids) and 0x80 <= table[ids[k]][0] < 0xC0:
        k += step
    return k


def seam(left: np.ndarray, right: np.ndarray, table: list[bytes], reach: tuple[int, int]) -> tuple[int, int, str]:
    """The last ``reach[0]`` tokens of ``left`` and the first ``reach[1]`` of ``right``, or some more, and their text."""
    a = _aligned(left, max(0, len(left) - reach[0]), table, -1)
    b = _aligned(right, min(len(right), reach[1]), table, 1)
    return a, b, b"".join([table[i] for i in (*left[a:].tolist(), *right[:b].tolist())]).decode()


def join_ids(ids: list[bytes], encode, table: list[bytes], reach: int = REACH) -> bytes:
    """The ids of the whole text from those of its chunks.

    ``encode(text)`` gives ids as uint32 bytes, ``table`` the bytes of each id.
    At each join the text of the last tokens before it and the first ones
    after it is encoded again.  Where that gives the old tokens at its outer
    ends, both sides' pairs of neighbours stand as in their own encodings, so
    the whole is the encoding of the joined text; until then the window grows
    fourfold on the side that differs.  A window reaches over one chunk's
    text to the right, so the work follows the length of the text.
    """
    out = bytearray(ids[0])
    for more in ids[1:]:
        right = np.frombuffer(more, "<u4")
        before, behind = reach, reach
        while True:
            # Some tokens more than the window, to move its start off the middle of a character.
            left = np.frombuffer(bytes(out[-4 * (before + 8) :]), "<u4")
            a, b, text = seam(left, right, table, (before, behind))
            whole = a == 0 and 4 * len(left) == len(out)
            new = encode(text)
            same_left = whole or new[: 4 * AGREE] == left[a : a + AGREE].tobytes()
            same_right = b == len(right) or new[-4 * AGREE :] == right[b - AGREE : b].tobytes()
            if same_left and same_right:
                break
            before, behind = before if same_left else 4 * before, behind if same_right else 4 * behind
        del out[len(out) - 4 * (len(left) - a) :]
        out += new
        out += right[b:].tobytes()
    return bytes(out)


def encoded(docs: DataFrame, tokenizer: str, digest: bool = False) -> DataFrame:
    """``doc_id, ids`` (uint32 bytes) of every document, or with ``digest`` the figures of :func:`query` in place of the ids."""
    whole_base = common.texts(docs)
    # The same filter in both joins below, so that they share one exchange of the texts.
    base = whole_base.where("doc_id is not null")

    # Ids travel in two bytes where the vocabulary allows it.
    narrow = "<u2" if tokens.encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            ids, found = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = dict.fromkeys(map(chunk_hash, chunks(x)))
                ids += [i] * len(own)
                found += own
            yield {"doc_id": ids, "h": found}

    places = common.cut_lineage(common.map_rows(base, hashes, "doc_id bigint, h binary"))
    shared = places.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")
    owners = shared.groupBy("doc_id").agg(F.collect_set("h").alias("wanted"))

    def encode_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = tokens.encoder(tokenizer)
        for b in batches:
            todo: dict[bytes, str] = {}
            for x, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                want = set(wanted)
                todo.update((h, c) for c in chunks(x) if (h := chunk_hash(c)) in want)
            yield {"h": list(todo), "ids": [np.frombuffer(x, "<u4").astype(narrow).tobytes() for x in enc.encode(list(todo.values()))]}

    once = common.map_rows(base.join(owners, "doc_id").select("text", "wanted"), encode_wanted, "h binary, ids binary")
    # Nothing between the exchange and the join, so that Spark can split a hot chunk's rows; a chunk that
    # came twice, from rows of one id, counts once in the set.
    given = places.join(once, "h").groupBy("doc_id").agg(F.collect_set(F.struct("h", "ids")).alias("given"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = tokens.encoder(tokenizer)
        table = tokens.byte_table(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                names, cut = b.column(0).to_pylist(), [chunks(x) for x in b.column(1).to_pylist()]
                known = [{g["h"]: np.frombuffer(g["ids"], narrow).astype("<u4").tobytes() for g in x or []} for x in b.column(2).to_pylist()]
                got = [[k.get(chunk_hash(c)) if k else None for c in own] for k, own in zip(known, cut, strict=True)]
                fresh = iter(enc.encode([c for own, g in zip(cut, got, strict=True) for c, x in zip(own, g, strict=True) if x is None]))
                parts = [[next(fresh) if x is None else x for x in g] for g in got]
                # All first windows of the batch at once; the few that must grow are encoded one by one.
                seams = list({seam(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), table, (REACH, REACH))[2] for p in parts for x, y in zip(p, p[1:], strict=False)})
                first = dict(zip(seams, enc.encode(seams), strict=True))
                again = lambda x, first=first: y if (y := first.get(x)) is not None else enc.direct(x)
                ids = [join_ids(p, again, table) if p else b"" for p in parts]
                if not digest:
                    yield {"doc_id": names, "ids": ids}
                    continue
                back = [tokens.decode(np.frombuffer(x, "<u4"), table) for x in ids]
                yield {
                    "doc_id": names, "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back],
                }

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "doc_id bigint, ids binary"
    nameless = whole_base.where("doc_id is null").withColumn("given", F.lit(None).cast(given.schema["given"].dataType))
    return common.map_rows(base.join(given, "doc_id", "left").select("doc_id", "text", "given").union(nameless), assemble, schema)


def decoded(ids: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = tokens.byte_table(tokenizer)
        for b in batches:
            yield {"doc_id": b.column(0), "text": [tokens.decode(np.frombuffer(x or b"", "<u4"), table) for x in b.column(1).to_pylist()]}

    return common.map_rows(ids.select("doc_id", "ids"), rows, "doc_id bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.dealt(common.table(spark, sf_dir, "documents")), tokens.tokenizer_path("byte_bpe_50k.json"), digest=True)
