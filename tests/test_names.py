"""Every operator and model on fields whose names hold dots, blanks and backticks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oreflow.functions import expressions as X
from oreflow.functions.values import col
from oreflow.operators import field, models, record, report, trained

A, B, C, D = "a.b", "a b", "a`b", "x.y.z"


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(120).select(
        F.col("id").alias("id.n"), (F.col("id") % 7).cast("double").alias(A), F.when(F.col("id") % 11 > 0, F.concat(F.lit("v"), F.col("id") % 3)).alias(B),
        F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias(C), F.when(F.col("id") % 7 > 3, "yes").otherwise("no").alias(D),
    )
    return base.persist()


KEY = ["id.n"]


def test_record_operators(rows):
    assert record.aggregate(rows, [B], [A, C], ["Mean", "Sum", "Min", "Max", "SDev"]).count() == 4
    assert record.distinct(rows, [B, A], KEY).count() == 28 and record.distinct(rows, [], KEY).count() == 120
    assert record.distinct(rows, ["no such"], KEY).collect()[0]["id.n"] == 0
    assert record.append([rows, rows.withColumn(A, F.lit("t"))], "from.where").count() == 240
    assert record.merge(rows, rows.select("`id.n`", f"`{A}`"), "id.n", "id.n", "full").count() == 120
    assert record.sort(rows, C, False, KEY).first()[C] == 178.5
    assert record.sample_first(rows, 3, KEY).count() == 3 and record.sample_every(rows, 10, KEY).count() == 12
    assert record.reservoir(rows, 9, 1, KEY).count() == 9 and record.sample_random(rows, 50, 1, KEY).count() > 20
    assert record.select(rows, record.condition(rows, A, ">", "3")).count() == 51
    assert record.mode(rows, B, KEY).first()["value"] in ("v0", "v1", "v2") and record.value_counts(rows, D).count() == 2
    assert record.quantiles(rows, [D], A, [0.5]).count() == 2


def test_field_operators(rows):
    for method in ("mean", "median", "mode", "constant", "remove"):
        assert field.fill(rows, [C, B], method, "0", KEY).columns == rows.columns
    assert field.clean_text(rows, [B]).first()[B] is None and field.retype(rows, {A: "string"}).count() == 120
    assert field.derive(rows, "n.w", X.fields(rows)[A] + X.fields(rows)[C]).count() == 120
    assert field.derive(rows, "t.f", X.fields(rows)[A] > 2).first()["t.f"] == "F"
    assert "a.b_BIN" in field.binning(rows, A, 3).columns and "p.q" in field.partition(rows, KEY, name="p.q").columns
    assert field.drop_rename(rows, [C], {A: "new.name"}).columns == ["id.n", "new.name", B, D]


def test_reports(rows):
    assert report.audit(rows).count() == 5 and report.shapes(rows).count() > 5 and report.table(rows, KEY, 5).count() == 5
    assert report.histogram(rows, C).count() > 5 and report.distribution(rows, B, D).count() == 6 and report.distribution(rows, A).count() == 7
    assert report.plot(rows, A, C, KEY, D).count() == 96 and report.shares(report.distribution(rows, B), rows, B).count() == 3
    assert report.class_metrics(rows, D, D).first()["accuracy"] == 1 and report.regression_metrics(rows, A, A).first()["mae"] == 0


@pytest.mark.parametrize("kind", ["tree", "svm", "ann", "logistic", "linear", "bayes", "chaid", "kmeans", "single", "anomaly", "knn"])
def test_models_saved_and_read_again(spark, rows, tmp_path, kind):
    inputs = [A, B, C]
    fit = {
        "tree": lambda: models.tree(rows, D, inputs), "svm": lambda: models.svm(rows, D, inputs, iterations=5),
        "ann": lambda: models.ann(rows, D, inputs, 2, 5), "logistic": lambda: models.logistic(rows, D, inputs, iterations=5),
        "linear": lambda: models.linear(rows, C, [A, B]), "bayes": lambda: models.NaiveBayes(rows, D, inputs), "chaid": lambda: models.Chaid(rows, D, inputs),
        "kmeans": lambda: models.KMeans.fit(rows, inputs, 3, keys=KEY), "single": lambda: models.KMeans.fit(rows, inputs, 1),
        "anomaly": lambda: models.Anomaly.fit(rows, inputs, 2, keys=KEY),
        "knn": lambda: models.Neighbours.fit(rows, D, inputs, "id.n", models.Encoder.fit(rows, inputs), 3),
    }[kind]
    m = fit()
    trained.save(m, str(tmp_path / "m"), spark)
    again = trained.load(spark, str(tmp_path / "m"))
    new = rows.drop(D) if kind != "linear" else rows.drop(C)
    got = trained.score(again, new)
    added = [c for c in got.columns if c.startswith("$")]
    want = m.transform(rows).select(col("id.n"), *[col(c) for c in added])
    assert added and sorted(map(str, got.select(col("id.n"), *[col(c) for c in added]).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError, match="the data lack"):
        trained.score(again, new.drop(A))
    with pytest.raises(ValueError, match="as a number"):
        trained.score(again, new.withColumn(A, F.lit("old")))


def test_saved_rules(spark, tmp_path):
    sets = spark.createDataFrame([(str(i), ["Bread", "Butter"]) for i in range(5)], "basket string, items array<string>")
    m = models.Rules(models.apriori(sets, 10, 50)[1])
    trained.save(m, str(tmp_path / "m"), spark)
    out = trained.score(trained.load(spark, str(tmp_path / "m")), spark.createDataFrame([("99", ["Bread"])], "basket string, items array<string>")).collect()
    assert [(r["Recommendation"], r["Confidence"]) for r in out] == [("Butter", 1.0)]


def test_what_models_learnt_as_tables(spark, rows):
    m = models.logistic(rows, D, [A, B], iterations=20)
    table = {r["term"]: r for r in m.coefficients(spark).collect()}
    assert set(table) == {A, f"{B}=v1", f"{B}=v2", "(Intercept)"} or len(table) == 4
    assert table[A]["coefficient"] > 0 and abs(table[A]["odds_ratio"] - 2.718281828 ** table[A]["coefficient"]) < 1e-6
    assert models.linear(rows, C, [A]).coefficients(spark).count() == 2 and models.svm(rows, D, [A], iterations=3).weights(spark).count() == 4
    scored = models.KMeans.fit(rows, [A, B], 2, keys=KEY).transform(rows)
    profile = models.profiles(scored, [A, B], "$KM-K-Means").collect()
    assert {(r["cluster"], r["field"]) for r in profile} == {(f"cluster-{k}", f) for k in (1, 2) for f in (A, B)} and sum(r["n"] for r in profile) == 240
    found = models.silhouette(scored.withColumn("x", F.array(col(A))), F.col("x"), "$KM-K-Means", "id.n")
    told = {r["cluster"]: r for r in models.silhouette_summary(found).collect()}
    assert told["all"]["n"] == 120 and told["all"]["structure"] in ("strong", "reasonable", "weak", "none")


def test_anomalies_by_index(rows):
    m = models.Anomaly.fit(rows, [A, C], 1, index=1.2)
    out = m.transform(rows).collect()
    assert m.cut == 1.2 and all((r["$O-Anomaly"] == "anomaly") == (r["$OA-Anomaly"] > 1.2) for r in out) and any(r["$OR-Anomaly"] for r in out)
