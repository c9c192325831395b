"""Personal data by bootstrapped contextual extraction.

Seeds are the e-mail addresses, IP addresses, card and phone numbers that
fixed forms give (:func:`seeds`).  Every seed, and every other text that looks
like an identifier (:func:`mentions`), stands in lexical patterns: the words
beside it.  Patterns and instances make a bipartite graph, scored by Spark in
ROUNDS rounds: a pattern's confidence in a kind is the sum of the scores of
that kind's distinct instances over all distinct instances that it was met
with, plus one; an instance's score is 1 for a seed and the best confidence of
its patterns for others.  Instances that reach ACCEPT are personal data, too,
wherever they stand in a pattern that reached it.  Copies of a text tell
nothing new, as instances count once.

One pass over the texts makes a row for each document and one small struct for
each mention; from then on only those move.  Patterns are scored where at
least LEAST_SEEDS seeds of a kind and a candidate of it stand in them and even
candidates that are all right could lift them to ACCEPT.  Counts are combined
before each shuffle, and rows of hot patterns or instances are looked up in
broadcast tables of bounded size.

All scans are linear in the text, also for a word or a row of digits of
megabytes.  Null text is the empty text (no spans); repeated rows get a result
each; a null id is kept; equal scores need no order; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
OTHER = -1
ROUNDS, LEAST_SEEDS, ACCEPT = 5, 8, 0.85
#: Code points beside a mention in which its context words lie, and those of the longest name before an at sign that is a candidate.
REACH, NAME = 48, 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,3}[0-9])*+")
_AT = re.compile(r"(?<=[^\s@])@[^\s@]{1,255}")
_ANY = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>"

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of name@label.label..., each sign of a name looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        # The next name begins behind this sign, or behind the whole match.
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in back[1::2])) % 10 == 0


def seeds(text: str) -> list[Span]:
    """The base spans by kind and place: leftmost matches of each form that pass its test."""
    out = [(EMAIL, a, z) for a, z in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        if "." not in m[0]:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(short := p.lstrip("0")) < 4 and int(short or 0) <= 255 for p in four):
                out.append((IP, at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((CARD, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((PHONE, *m.span()))
    return out


def _word(w: str) -> str:
    return _DIGIT.sub("0", w.strip(_EDGE).lower()) or w


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The contexts of a mention: a word before it, two before, two behind, one on each side."""
    left = ["^", "^", *map(_word, text[max(0, start - REACH) : start].split())][-2:]
    right = [*map(_word, text[end : end + REACH].split()), "$", "$"][:2]
    return [f"{left[1]} _", f"{left[0]} {left[1]} _", f"_ {right[0]} {right[1]}", f"{left[1]} _ {right[0]}"]


def _kind(text: str, start: int, end: int) -> int:
    """The kind that a number without a base span could be of."""
    near = text[start - 1 : start] + text[end : end + 1] if start else text[end : end + 1]
    if any(c.isalpha() or c == "_" for c in near):
        return OTHER
    own = text[start:end]
    n = len(_NO_DIGIT.sub("", own))
    if own.count(".") == 3 and n + 3 == len(own):
        return IP
    return PHONE if 7 <= n <= 12 else CARD if 13 <= n <= 19 else OTHER


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Texts like identifiers that overlap no base span, by place: numbers, and names with an at sign; kind OTHER where it can be none."""
    found = [(_kind(text, *m.span()), *m.span()) for m in _NUMBER.finditer(text)]
    for m in _AT.finditer(text):
        start = m.start()
        while start > max(0, m.start() - NAME) and not (text[start - 1].isspace() or text[start - 1] == "@"):
            start -= 1
        start += len(text[start : m.start()]) - len(text[start : m.start()].lstrip(_EDGE))
        end = m.start() + len(text[m.start() : m.end()].rstrip(_EDGE))
        if start < m.start() and end > m.start() + 1:
            found.append((EMAIL, start, end))
    out, free, k = [], 0, 0
    held = sorted((a, z) for _, a, z in taken)
    for kind, a, z in sorted(found, key=lambda x: (x[1], -x[2])):
        while k < len(held) and held[k][1] <= a:
            k += 1
        if a >= free and not any(x < z for x, _ in held[k : k + 1]):
            out.append((kind, a, z))
            free = z
    return out


def mentions(text: str, base: list[Span]) -> list[dict]:
    """All base spans and candidates with their instance and patterns."""
    if not _ANY.search(text):
        return []
    out = []
    for is_base, spans in ((True, base), (False, candidates(text, base))):
        for kind, a, z in spans:
            own = text[a:z].lower() if kind in (EMAIL, IP) else _NO_DIGIT.sub("", text[a:z])
            key = hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            out.append({"kind": kind, "base": is_base, "start": a, "end": z, "key": key, "patterns": _patterns(text, a, z)})
    return out


_MENTION = "array<struct<kind:int,base:boolean,start:bigint,end:bigint,key:string,patterns:array<string>>>"


def _scanned(docs: DataFrame) -> DataFrame:
    """``row, doc_id, mentions`` of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [mentions(x, seeds(x)) for x in b.column(1).to_pylist()]
                yield {"row": range(row, row + b.num_rows), "doc_id": b.column(0), "mentions": found}
                row += b.num_rows

    return common.map_rows(common.texts(docs), run, f"row bigint, doc_id bigint, mentions {_MENTION}")


def accepted(found: DataFrame) -> DataFrame | None:
    """``kind, pattern, key`` of the candidates, and the patterns that they stand in, that reach ACCEPT; None if no pattern can."""
    edges = found.select(F.col("kind"), F.explode("patterns").alias("pattern"), "key", "base")
    edges = common.cut_lineage(edges.groupBy("kind", "pattern", "key").agg(F.max("base").alias("base")))
    own = lambda test: F.sum(test.cast("bigint"))
    counts = [own((F.col("kind") == k) & (F.col("base") == b)).alias(f"{'seeds' if b else 'others'}_{k}") for k in range(4) for b in (True, False)]
    totals = edges.groupBy("pattern").agg(F.count("*").alias("all"), *counts)
    per = totals.select("pattern", "all", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"seeds_{k}").alias("seeds"), F.col(f"others_{k}").alias("others")) for k in range(4)
    ])).alias("x")).select("pattern", "all", "x.*")
    able = per.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("others") > 0) & (F.col("seeds") + F.col("others") >= ACCEPT * (F.col("all") + 1)))
    able = common.cut_lineage(able.select(F.struct("kind", "pattern").alias("at"), "seeds", "all"))
    if able.isEmpty():
        return None
    open_ = edges.where(~F.col("base") & (F.col("kind") >= 0)).select(F.struct("kind", "pattern").alias("at"), F.struct("kind", "key").alias("who"))
    graph = common.cut_lineage(common.looked_up(open_, able, "at").where("seeds is not null"))
    scores = graph.select("who").distinct().withColumn("score", F.lit(0.0))
    sure = None
    for _ in range(ROUNDS):
        lifted = common.looked_up(graph, scores, "who")
        sure = lifted.groupBy("at").agg(((F.max("seeds") + F.sum("score")) / (F.max("all") + 1)).alias("sure"))
        sure = common.cut_lineage(sure)
        scores = common.cut_lineage(common.looked_up(graph.select("at", "who"), sure, "at").groupBy("who").agg(F.max("sure").alias("score")))
    best = common.looked_up(graph.select("at", "who"), sure, "at").where(F.col("sure") >= ACCEPT)
    return best.select("at.kind", "at.pattern", "who.key").distinct()


RESULT = "doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans"


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` of every document: arrays of (kind, start, end), kinds by their place in KINDS."""
    rows = common.saved(_scanned(docs), "mentions")
    span = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    every = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    good = accepted(every)
    if good is None:
        more = rows.select("row").where("false").withColumn("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    else:
        loose = every.where(~F.col("base") & (F.col("kind") >= 0))
        at = loose.select("row", "kind", "start", "end", F.explode("patterns").alias("pattern"), "key").withColumn("who", F.struct("kind", "pattern", "key"))
        good = good.select(F.struct("kind", "pattern", "key").alias("who"), F.lit(True).alias("good"))
        hits = common.looked_up(at, good, "who").where("good").select("row", F.struct("kind", "start", "end").alias("span")).distinct()
        more = hits.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("added"))  # of one document
    base = F.transform(F.filter("mentions", lambda m: m["base"]), span)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return rows.join(more, "row", "left").select("doc_id", F.sort_array(base).alias("base"), F.coalesce("added", none).alias("added"))


def _told(column: str | Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The columns of :data:`RESULT`: counts and digest of the base spans, and all spans by kind and place."""
    found = spans(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_told("base"), 256).alias("base_sha256"),
        _told(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.dealt(common.table(spark, sf_dir, "documents")))
