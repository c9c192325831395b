"""Language identification by Bayesian evidence fusion.

posterior(L | page) ~ P(text | L) * P(declared markup language | L)
                      * P(address suffix | L) * P(L | host)

* Text: hashed character trigrams, a multinomial for each language counted
  over all documents with a declared language; the mean log-likelihood of a
  page counts for at most ``TEXT_WEIGHT`` independent trigrams.
* Markup (the ``lang`` of the html element) and the suffix of the host: their
  shares within a language, counted over all pages by grouped aggregation of
  the posteriors that the text alone gives, with additive smoothing.
* Host: shares at the host, smoothed towards its domain, that towards all
  pages; the page's own part is taken out of every count.

Counts with a row per host stay in Spark and are joined to the pages; only
tables of a fixed size (languages x trigram buckets, languages x shares of all
pages) reach the driver.

Null html or a page without text has no text evidence; a null or relative
address has an empty host and suffix; an unknown or missing markup language is
a value of its own; repeated rows are judged each (their copies count at their
host); equal scores go to the first language by name; pages of any length are
read whole; columns beside those named are ignored; without labelled documents
or pages the result has no rows or a null language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common, html_extraction

BITS = 14
TEXT_WEIGHT = 60.0
#: Numbers of a table that is sent to every task.
BROADCAST_CELLS = 500_000
#: Weight of the wider level in pages.
KAPPA = 5.0
#: A comment or the html element, whichever comes first; an open comment runs to the end.
_HTML = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<html(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)", re.I | re.S)
#: The attributes of an element: name, and value in either quotes or bare.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CODE = re.compile(r"\s*([A-Za-z]{2,3})\b")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", re.I)


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed character trigrams of the lower-cased text, words set off by single blanks."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) < 3:
        return np.zeros(1 << BITS)
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
    return np.bincount((h ^ (h >> np.uint32(15))) & np.uint32((1 << BITS) - 1), minlength=1 << BITS)


def declared_language(page: str) -> str:
    """The ``lang`` (or else ``xml:lang``) of the page's first html element outside comments, wherever it stands; "" if it has none."""
    for element in _HTML.finditer(page):
        if element[1] is not None:
            found = {name.lower(): "".join(values) for name, *values in reversed(_ATTRIBUTE.findall(element[1]))}
            m = _CODE.match(found.get("lang") or found.get("xml:lang") or "")
            return m[1].lower() if m else ""
    return ""


def text_model(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The languages and log P(trigram bucket | language), counted over all of ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for x, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = found.setdefault(lang, np.zeros(1 << BITS, np.int64))
                own += trigrams(x).astype(np.int64)
        for lang, n in found.items():
            yield {"lang": [lang], "counts": [n]}

    rows = docs.where("lang is not null").select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    counts = common.map_rows(rows.select("text", "lang"), run, "lang string, counts array<bigint>")
    total = counts.select("lang", F.posexplode("counts").alias("bin", "n")).where("n > 0").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    table, at = np.full((len(names), 1 << BITS), smoothing), {x: k for k, x in enumerate(names)}
    # At most languages x buckets rows, however many documents; one row for each language.
    for r in total.groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("n")).toLocalIterator():
        table[at[r["lang"]], r["bins"]] += r["n"]
    return names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table


def page_evidence(pages: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """Per page: address parts, markup language, log-likelihoods of the text and the posterior it gives alone."""
    sent = pages.sparkSession.sparkContext.broadcast((table.astype(np.float32), html_extraction.default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        logs, model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                likes, alone, declared, hosts = [], [], [], []
                for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    page = page or ""
                    text = html_extraction.main_text(page, model) or " ".join(x.text for x in html_extraction.parse(page))
                    n = trigrams(text)
                    like = logs @ n / max(1, n.sum()) * min(TEXT_WEIGHT, n.sum()) if len(logs) else np.zeros(0)
                    p = np.exp(like - like.max()) if len(like) else like
                    likes.append(like.astype(float).tolist())
                    alone.append((p / p.sum()).astype(float).tolist() if len(p) else [])
                    declared.append(declared_language(page))
                    m = _HOST.match(url or "")
                    hosts.append(m[1].lower().rstrip(".") if m else "")
                parts = [h.split(".") for h in hosts]
                yield {
                    "page_id": b.column(0), "url": b.column(1), "host": hosts, "domain": [".".join(p[-2:]) for p in parts],
                    "suffix": [p[-1] for p in parts], "declared": declared, "likes": likes, "alone": alone,
                }

    return common.map_rows(
        pages.select("page_id", "url", "html"), run,
        "page_id bigint, url string, host string, domain string, suffix string, declared string, likes array<double>, alone array<double>",
    )


def _beside(rows: DataFrame, table: DataFrame, level: str, width: int) -> DataFrame:
    """``rows`` with their value's sums: a table of at most BROADCAST_CELLS numbers goes to every task, only the hot values of a larger one."""
    few = BROADCAST_CELLS // max(1, width)
    if table.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(table), level)
    return common.looked_up(rows, table, level)


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, url, lang, probability, text_lang, declared, host`` of every page."""
    spark = pages.sparkSession
    names, table = text_model(docs)
    found = common.saved(page_evidence(pages, names, table), "page-evidence")
    size = range(len(names))
    vector = lambda f: F.array(*[f(k) for k in size]).cast("array<double>")
    sums = vector(lambda k: F.sum(F.col("alone")[k]))
    total = found.agg(sums.alias("s")).first()["s"] if names else []
    total = [x or 0.0 for x in total]
    shares = [(x + 1) / (sum(total) + len(names)) for x in total]
    out = found
    for level in ("domain", "host", "suffix", "declared"):
        out = _beside(out, common.cut_lineage(found.groupBy(level).agg(sums.alias(f"n_{level}"))), level, len(names))

    # Arrays by language, so the plan doesn't grow with their number.
    for level in ("domain", "host", "suffix", "declared"):
        out = out.withColumn(f"own_{level}", F.zip_with(f"n_{level}", "alone", lambda n, own: F.greatest(F.lit(0.0), n - own)))
    for level in ("domain", "host"):
        out = out.withColumn(f"rest_{level}", F.aggregate(f"own_{level}", F.lit(0.0), lambda acc, x: acc + x))
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")
    wider = lambda level, share: F.zip_with(f"own_{level}", share, lambda n, x: (n + KAPPA * x) / (F.col(f"rest_{level}") + KAPPA))
    out = out.withColumn("p_domain", wider("domain", numbers(shares))).withColumn("p_host", wider("host", F.col("p_domain")))
    # P(value | L): the value's own share of the language, in which a value never seen has half a page.
    given = lambda level: F.zip_with(f"own_{level}", numbers(total), lambda n, t: (n + 0.5) / (t + 50.0))
    plus_log = lambda scores, p: F.zip_with(scores, p, lambda x, y: x + F.log(y))
    scored = out.withColumn("score", plus_log(plus_log(plus_log(F.col("likes"), F.col("p_host")), given("suffix")), given("declared")))
    known = F.array(*[F.lit(x) for x in names]).cast("array<string>")
    best = lambda c: F.get(known, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    spread = F.aggregate("score", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("score")))
    return scored.select(
        "page_id", "url", best(F.col("score")).alias("lang"), F.try_divide(F.lit(1.0), spread).alias("probability"),
        best(F.col("likes")).alias("text_lang"), "declared", "host",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(common.dealt(common.table(spark, sf_dir, "pages")), common.dealt(common.table(spark, sf_dir, "documents")))
