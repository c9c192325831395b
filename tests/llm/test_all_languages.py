"""The markup language anywhere in a page, and more than 200 languages."""

import random

from oreflow.llm import language_id


def test_declared_language_anywhere(spark):
    pages = [
        "<!-- " + "x" * 9000 + " <html lang=de> --><html lang=fr><p>x", "<html " + "data-a='b' " * 900 + 'lang="de-AT">',
        "<html data-lang=xx class='a>b' lang = pt>", "<html xml:lang=en>", "<!-- open <html lang=de>", "<html><p lang=fr>",
    ]
    df = spark.createDataFrame([(i, "https://a.example/", x) for i, x in enumerate(pages)], "page_id bigint, url string, html string")
    docs = spark.createDataFrame([("one two three", "en")], "text string, lang string")
    got = {r["page_id"]: r["declared"] for r in language_id.identified(df, docs).collect()}
    assert [got[i] for i in range(len(pages))] == ["fr", "de", "pt", "en", "", ""]


def test_every_language_can_be_the_answer(spark):
    rnd, words = random.Random(8), {}
    for k in range(205):
        words[f"l{k:03}"] = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
    text = lambda lang: " ".join(rnd.choice(words[lang]) for _ in range(60))
    last = "l204"  # one document, so it was beyond the 200 commonest
    docs = spark.createDataFrame([(text(lang), lang) for lang in words for _ in range(1 if lang == last else 2)], "text string, lang string")
    pages = spark.createDataFrame(
        [(1, "https://a.example/", f"<html><body><p>{text(last)}</p></body></html>")], "page_id bigint, url string, html string",
    )
    assert [(r["lang"], r["text_lang"]) for r in language_id.identified(pages, docs).collect()] == [(last, last)]


def test_posterior_by_brute_force(spark):
    """The fused scores against their definition, page by page, also where hosts are looked up in parts."""
    import math

    import numpy as np

    from oreflow.llm import html_extraction

    rnd = random.Random(9)
    vocabulary = {lang: ["".join(rnd.choice(signs) for _ in range(5)) for _ in range(40)] for lang, signs in (("aa", "abcdefg"), ("bb", "abcdexyz"), ("cc", "mnopqrs"))}
    text = lambda lang, n: " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))
    docs = [(text(lang, 40), lang) for lang in vocabulary for _ in range(4)] + [(None, "aa"), (text("aa", 5), None)]
    pages = []
    for i in range(300):
        lang = rnd.choice(sorted(vocabulary))
        host = rnd.choice(("a.one.org", "b.one.org", "two.com", f"h{i}.net", ""))
        said = rnd.choice((f' lang="{lang}"', "", ' lang="zz"'))
        pages.append((i, f"https://{host}/x" if host else None, f"<html{said}><body><p>{text(lang, rnd.choice((0, 1, 30)))}</p></body></html>"))
    pages += [pages[0], (500, None, None)]
    d = spark.createDataFrame(docs, "text string, lang string").withColumnRenamed("text", "text")
    p = spark.createDataFrame([(*r, 7, "x") for r in pages], "page_id bigint, url string, html string, likes int, host string")
    names = sorted(vocabulary)
    counts = np.full((3, 1 << language_id.BITS), 0.5)
    for x, lang in docs:
        if lang:
            counts[names.index(lang)] += language_id.trigrams(x or "")
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    model, rows = html_extraction.default_model(), []
    for i, url, page in pages:
        n = language_id.trigrams(html_extraction.main_text(page or "", model) or " ".join(x.text for x in html_extraction.parse(page or "")))
        like = logs @ n / max(1, n.sum()) * min(language_id.TEXT_WEIGHT, n.sum())
        alone = np.exp(like - like.max())
        host = url.split("/")[2] if url else ""
        rows.append((
            i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], language_id.declared_language(page or ""), like,
            alone / alone.sum(),
        ))
    total = sum(r[6] for r in rows)
    shares = (total + 1) / (total.sum() + 3)
    want = {}
    for r in rows:
        own = [np.maximum(0.0, sum(o[6] for o in rows if o[k] == r[k]) - r[6]) for k in range(5)]
        share = (own[2] + language_id.KAPPA * shares) / (own[2].sum() + language_id.KAPPA)
        share = (own[1] + language_id.KAPPA * share) / (own[1].sum() + language_id.KAPPA)
        score = r[5] + np.log(share) + np.log((own[3] + 0.5) / (total + 50)) + np.log((own[4] + 0.5) / (total + 50))
        want[r[0]] = (names[int(score.argmax())], float(1 / np.exp(score - score.max()).sum()), r[4], r[1])
    for cells in (language_id.BROADCAST_CELLS, 0):
        before, language_id.BROADCAST_CELLS = language_id.BROADCAST_CELLS, cells
        got = language_id.identified(p, d).collect()
        language_id.BROADCAST_CELLS = before
        assert len(got) == len(pages)
        for r in got:
            lang, probability, declared, host = want[r["page_id"]]
            assert (r["lang"], r["declared"], r["host"]) == (lang, declared, host) and math.isclose(
                r["probability"], probability, rel_tol=1e-4, abs_tol=1e-6,
            )
    long = spark.createDataFrame(
        [(1, "https://two.com/", "<html><body><p>" + text("cc", 300_000) + "</p></body></html>")],
        "page_id bigint, url string, html string",
    )
    assert language_id.identified(long, d).first()["lang"] == "cc"
