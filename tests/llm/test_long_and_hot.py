"""One id on nearly all rows, turns of megabytes and texts of megabytes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from oreflow.llm import chat_format, common, ngram_join, packing, phrase_fingerprint, token_output, tokens

TOKENIZER = "byte_bpe_50k.json"


def test_rows_of_one_id_are_many_ranges(spark, tmp_path, monkeypatch):
    docs = spark.range(4000).select(F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id") * 7919 % 4000).alias("text"))
    sizes = []
    old = common.map_rows

    def seen(df, *more):
        sizes.append(sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()))
        return old(df, *more)

    monkeypatch.setattr(common, "map_rows", seen)
    token_output.write(docs, str(tmp_path / "ids"), tokens.tokenizer_path(TOKENIZER), 2)
    phrase_fingerprint.with_next(docs)
    assert sizes[0][-1] < 2000 and sizes[1][-1] < 2000
    monkeypatch.undo()
    got = token_output.documents(token_output.read(spark, str(tmp_path / "ids")))
    want = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    enc = tokens.encoder(tokens.tokenizer_path(TOKENIZER))
    starts = np.cumsum([0, *[len(x) // 4 + 1 for x in enc.encode([t for _, t in want])]])[:-1]
    assert sorted((r["start"], r["doc_id"]) for r in got.collect()) == sorted(zip(starts.tolist(), [i for i, _ in want], strict=True))


def test_long_turns_are_not_copied(spark, monkeypatch):
    long = "word number nine " * 60_000
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "before"), (1, 2, "user", long), (1, 3, "assistant", "yes"), (1, 4, "user", "and " * 300)]
    rows += [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 90) for k in range(5, 60)] + [(2, 0, "system", "much " * 4000), (2, 1, "user", "hi")]
    rows += [(2, k, "assistant" if k % 2 else "user", f"turn {k} " * 150) for k in range(2, 99)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    sizes = []
    old = common.map_rows

    def seen(df, run, schema):
        if schema == chat_format.WINDOW:
            sizes.append(df.agg(F.sum(F.length("text"))).first()[0])
        return old(df, run, schema)

    monkeypatch.setattr(common, "map_rows", seen)
    written = chat_format.windows(turns, tokens.tokenizer_path(TOKENIZER), 256, 64).cache()
    assert sizes[0] < 1.3 * sum(len(r[3]) for r in rows)
    assert written.where("n_repeated > 0").count() > 10
    for r in chat_format.read_back(written).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in own).encode()).hexdigest()
    # Nothing from before the long turn is repeated behind it.
    assert not written.where(F.col("text").contains("before") & (F.col("window") > 20)).count()


def test_texts_of_megabytes(spark, tmp_path):
    texts = ["one two three four five six seven eight nine ten. " * 60_000, "x" * 2_000_000, "short text of a few words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    path = tokens.tokenizer_path(TOKENIZER)
    token_output.write(docs, str(tmp_path / "ids"), path, 2)
    got = {r["doc_id"]: r["n_tokens"] for r in token_output.documents(token_output.read(spark, str(tmp_path / "ids"))).collect()}
    assert got == {i: len(x) // 4 + 1 for i, x in enumerate(tokens.encoder(path).encode(texts))}
    assert {r["doc_id"]: r["n_chars"] for r in phrase_fingerprint.with_next(docs).collect()} == {i: len(t) for i, t in enumerate(texts)}
    pieces = packing.packed(docs, tokens.tokenizer_path("word_bpe_49k.json"))
    assert pieces.groupBy("doc_id").agg(F.max(F.col("start") + F.col("length")).alias("n")).where("doc_id = 0").first()["n"] > 600_000
    linked = {r["doc_id"]: r["n_shingles"] for r in ngram_join.near_duplicates(docs).collect()}
    assert linked == {0: 10, 1: 1, 2: 2}
