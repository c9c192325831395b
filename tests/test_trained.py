"""Models saved, read again, checked against new data and scored without a target."""

import pytest
from pyspark.sql import functions as F

from oreflow.operators import field, models, trained
from oreflow.sources import samples

INPUTS = ["Age", "Tenure", "Plan", "Region"]


@pytest.fixture(scope="module")
def rows(spark):
    return field.clean_text(samples.sample_data(spark, "customers"), ["Region"]).withColumn("Age", F.col("Age").cast("double")).persist()


@pytest.mark.parametrize("fit,prefix", [(models.tree, "R"), (models.svm, "SVM"), (models.logistic, "L"), (models.ann, "ANN"), (models.NaiveBayes, "B"), (models.Chaid, "CH")])
def test_saved_models_score_alike(spark, rows, tmp_path, fit, prefix):
    m = fit(rows, "Churn", INPUTS, iterations=10) if fit in (models.svm, models.ann, models.logistic) else fit(rows, "Churn", INPUTS)
    trained.save(m, str(tmp_path / "m"), spark)
    again = trained.load(spark, str(tmp_path / "m"))
    new = rows.drop("Churn")
    names = ["CustomerID", f"`${prefix}-Churn`", f"`${prefix}C-Churn`"]
    want, got = m.transform(rows).select(*names), trained.score(again, new).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match='reads Tenure, which the data lack'):
        trained.score(again, new.drop("Tenure"))
    with pytest.raises(ValueError, match='reads Age as a number'):
        trained.score(again, new.withColumn("Age", F.lit("old")))


def test_saved_regression(spark, tmp_path):
    h = samples.sample_data(spark, "housing")
    m = models.linear(h, "Price", ["SqFt", "Bedrooms", "Neighborhood"])
    trained.save(m, str(tmp_path / "m"), spark)
    got = trained.score(trained.load(spark, str(tmp_path / "m")), h.drop("Price"))
    assert got.select("HouseID", "`$E-Price`").exceptAll(m.transform(h).select("HouseID", "`$E-Price`")).isEmpty()


def test_confidence_and_importance(spark, rows):
    f = samples.sample_data(spark, "iris")
    out = models.svm(f, "Species", ["Sepal_Length", "Sepal_Width", "Petal_Length", "Petal_Width"], cost=50, iterations=60).transform(f)
    low, high = out.agg(F.min("`$SVMC-Species`"), F.max("`$SVMC-Species`")).first()
    assert 1 / 3 <= low < high <= 1
    gains = models.tree(rows, "Churn", INPUTS).importance()
    assert list(gains)[0] == "Tenure" and abs(sum(gains.values()) - 1) < 1e-6 and set(gains) <= set(INPUTS)


def test_samples(spark):
    c, u, f = (samples.sample_data(spark, n) for n in ("customers", "usage", "basket_flags"))
    assert c.count() == 512 and c.distinct().count() == 500
    assert u.where("CustomerID is null").count() > 0 and u.join(c.distinct(), "CustomerID", "left_anti").where("CustomerID is not null").count() == 8
    sets = {r["basket"]: set(r["items"]) for r in models.flag_baskets(f, list(samples.ITEMS), "BasketID").collect()}
    rows = {r["basket"]: set(r["items"]) for r in models.baskets(samples.sample_data(spark, "baskets"), "BasketID", "Item").collect()}
    assert {k: v for k, v in sets.items() if v} == rows


def test_rules_with_signs_in_items(spark):
    df = spark.createDataFrame([(str(i), x) for i in range(5) for x in ("Salt & Pepper", "Fish")], "id string, item string")
    _, rules = models.apriori(models.baskets(df, "id", "item"), 10, 50)
    new = models.recommend(spark.createDataFrame([("9", ["Salt & Pepper"])], "basket string, items array<string>"), rules)
    assert [tuple(r)[:2] for r in new.collect()] == [("9", "Fish")]
    with pytest.raises(ValueError, match="minimum support"):
        models.apriori(models.baskets(df, "id", "item"), 10, 50, most=0)


def test_values_of_any_number(spark):
    """Naive Bayes with more values of a text field than a plan could hold as constants."""
    df = spark.range(30_000).select((F.col("id") % 2).cast("string").alias("y"), F.concat(F.lit("v"), F.col("id") % 10_000).alias("t"))
    m = models.NaiveBayes(df, "y", ["t"])
    out = m.transform(df)
    assert out.where("`$B-y` = y").count() == 30_000
