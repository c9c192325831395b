"""Quality rules: length-normalised log-likelihood ratio of hashed n-grams, trusted target against raw corpus.

Native Spark functions only.  Every document gets four base counts and a base
verdict, and a score: the mean, over its hashed words and word pairs, of
log(p_target / p_raw).  Both multinomials are counted over whole tables (the
target: the documents that the labels call good; the raw corpus: all
documents) with additive smoothing, so the ratio of every bucket is defined.
A document is kept if the base rules pass and the score reaches ``threshold``.

The counts are one grouped aggregation whose result has ``2 * buckets`` rows
whatever the corpus; the ratios reach the tasks as one constant array, so
scoring shuffles nothing and a hot source or word is no single task.

Null text has no words (all counts 0, base_failed true, kept false); repeated
rows are judged each; an empty table gives no rows; with no trusted document
all ratios are 0, so the base rules alone decide.  :func:`with_verdict` keeps
every column of its input; in :func:`judged` the results replace columns of
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Trusted ids up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
BUCKETS = 1 << 14
SMOOTHING = 8.0
THRESHOLD = -0.11


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, common.WORD_SEPARATORS), "")


def repeated_words(word_hashes: Column) -> Column:
    """Words in 5-word windows found twice or more in the text, first occurrences included."""
    n = F.size(word_hashes)
    windows = lambda h: F.transform(F.slice(h, 1, n - 4), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)]))

    def places(s: Column) -> Column:
        same = lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])
        return F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(
            same(e, i), F.get(s, i - 1)["h"] == e["h"], F.get(s, i + 1)["h"] == e["h"], F.lit(False),
        )), lambda e: e["i"]))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        add = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"))
        return F.aggregate(_let(pairs, places), start, add, lambda acc: acc["n"])

    # Sorting pairs is only for texts in which some window does repeat.
    return F.when(n < 5, 0).otherwise(_let(
        windows(word_hashes), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0),
    )).cast("long")


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.crc32(x))


def features(docs: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """``docs`` with the base counts in the struct ``{prefix}base`` and the hashed words in ``{prefix}g``; no column may begin with the prefix."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    col = lambda name: F.col(prefix + name)
    out = docs.select("*", words(text).alias(prefix + "w")).select(
        "*",
        F.transform(col("w"), lambda w: F.xxhash64(w)).alias(prefix + "h"),
        word_hashes(col("w")).alias(prefix + "g"),
        F.char_length(F.array_join(col("w"), "")).cast("long").alias(prefix + "chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias(prefix + "symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias(prefix + "lines"),
    )
    out = out.select("*", F.size(col("h")).cast("long").alias(prefix + "n"), repeated_words(col("h")).alias(prefix + "repeats"))
    failed = (col("n") < 10) | (100 * col("repeats") > 20 * col("n"))
    base = F.struct(
        col("n").alias("n_words"), col("chars").alias("word_chars"), col("symbols").alias("n_symbols"), col("lines").alias("n_dup_lines"),
        col("repeats").alias("n_repeat_words"), failed.alias("base_failed"),
    )
    return out.select(*_all(docs), base.alias(prefix + "base"), col("g"))


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def hashed_grams(g: Column, buckets: int) -> Column:
    """Words to buckets 0 .. buckets - 1 and pairs of neighbours to buckets .. 2 * buckets - 1."""
    ones = F.transform(g, lambda x: F.pmod(x, F.lit(buckets)))
    pairs = F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda i: F.lit(buckets) + F.pmod(F.get(g, i - 1) * 31 + F.get(g, i), F.lit(buckets)))
    return F.concat(ones, F.when(F.size(g) > 1, pairs).otherwise(F.array().cast("array<bigint>"))).cast("array<int>")


def gram_counts(docs: DataFrame, buckets: int, target: Column, text_col: str = "text") -> DataFrame:
    """``bucket, raw, target``: occurrences in all documents, and in those for which ``target`` is 1."""
    g = word_hashes(words(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(g.alias("_g"), target.alias("_t")).select("_t", F.explode(hashed_grams(F.col("_g"), buckets)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))


def ratios(
    docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, id_col: str = "doc_id",
    text_col: str = "text",
) -> list[float]:
    """log(p_target / p_raw) of each of the ``2 * buckets`` buckets."""
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias(id_col)).where(F.col(id_col).isNotNull()).distinct().withColumn("_trusted", F.lit(1))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select(id_col, text_col).join(F.broadcast(ids) if few else ids, id_col, "left")
    # 2 * buckets rows at most, whatever the corpus.
    found = {r["bucket"]: (r["raw"], r["target"]) for r in gram_counts(marked, buckets, F.coalesce("_trusted", F.lit(0)), text_col).collect()}
    out: list[float] = []
    for half in (range(buckets), range(buckets, 2 * buckets)):
        counts = [found.get(b, (0, 0)) for b in half]
        raw, target = (sum(c) for c in zip(*counts, strict=True))
        # Both with the same prior, the raw counts at the target's size: a bucket with little evidence has a ratio near 1.
        out += [math.log((t + smoothing) / (r * target / raw + smoothing)) if target else 0.0 for r, t in counts]
    return out


def with_verdict(
    docs: DataFrame, trusted_ids: DataFrame, name: str, buckets: int = BUCKETS, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one more column, a struct ``name`` of the base counts, ``base_failed``, ``score`` and ``kept``."""
    # A constant that the optimizer folds into one array of fixed size.
    table = F.split(
        F.lit(",".join(f"{x:.6f}" for x in ratios(docs, trusted_ids, buckets, id_col=id_col, text_col=text_col))), ",",
    ).cast("array<double>")
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    col = lambda part: F.col(prefix + part)
    total = F.aggregate(col("grams"), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    # The row number keeps a caller's filter on ``kept`` above this projection; pushed below, it would repeat the work for every word.
    score = F.when(F.size(col("grams")) > 0, total / F.size(col("grams"))).otherwise(0.0)
    scored = features(docs, text_col, prefix).withColumn(prefix + "grams", hashed_grams(col("g"), buckets)).select(
        *_all(docs), col("base"), score.alias(prefix + "score"), F.monotonically_increasing_id().alias(prefix + "row"),
    )
    kept = ~col("base")["base_failed"] & (col("score") >= threshold) & (col("row") >= 0)
    counts = [col("base")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return scored.select(*_all(docs), F.struct(*counts, col("score").alias("score"), kept.alias("kept")).alias(name))


def judged(
    docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``score`` and ``kept``."""
    name = common.free_name(docs, "verdict")
    found = with_verdict(docs, trusted_ids, name, buckets, threshold, id_col, text_col)
    results = [f.name for f in found.schema[name].dataType.fields]
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results], *[F.col(name)[r].alias(r) for r in results])


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.dealt(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged(docs, trusted(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


#: The same rules in DuckDB: words unnested, crc32 by its table, counts and ratios as above.
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, range(0, 8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
u AS (SELECT doc_id, i, w[i] AS x, w[i - 1] AS y FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
h AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, (length(hx) // 2)::BIGINT), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM (SELECT x, hex(encode(x)) AS hx, tbl FROM (SELECT DISTINCT x FROM u), t)),
g AS (SELECT doc_id, h.h % {BUCKETS} AS b FROM u JOIN h ON u.x = h.x UNION ALL SELECT doc_id, {BUCKETS} + (p.h * 31 + h.h) % {BUCKETS} FROM u JOIN h ON u.x = h.x JOIN h p ON u.y = p.x WHERE u.i > 1),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
c AS (SELECT b, count(*)::DOUBLE AS raw, count(good.doc_id)::DOUBLE AS target FROM g LEFT JOIN good ON g.doc_id = good.doc_id GROUP BY b),
s AS (SELECT b >= {BUCKETS} AS pair, sum(raw) AS raw, sum(target) AS target FROM c GROUP BY 1),
r AS (SELECT b, CASE WHEN s.target > 0 THEN ln((c.target + {SMOOTHING}) / (c.raw * s.target / s.raw + {SMOOTHING})) ELSE 0.0 END AS r FROM c JOIN s ON s.pair = (b >= {BUCKETS})),
score AS (SELECT doc_id, avg(r) AS score FROM g JOIN r ON g.b = r.b GROUP BY doc_id),
five AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS f FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, f FROM five GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT five.doc_id, i, unnest(range(0, 5)) AS k FROM five JOIN twice ON five.doc_id = twice.doc_id AND five.f = twice.f) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
base AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT f.*, NOT base_failed AND coalesce(score, 0.0) >= {THRESHOLD} AS kept FROM f LEFT JOIN score ON f.doc_id = score.doc_id
"""
