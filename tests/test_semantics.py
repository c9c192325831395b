"""Missing values, text forms, CSV, random numbers and models, on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from oreflow.functions import rng, values
from oreflow.operators import field, models, record
from oreflow.sources import files, samples


def _draws(seed, n):
    a, out = (seed & 0xFFFFFFFF) or 1, []
    for _ in range(n):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ (a >> 15)) * (1 | a) & 0xFFFFFFFF
        t = ((t + ((t ^ (t >> 7)) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        out.append((t ^ (t >> 14)) / 2**32)
    return out


def test_draws_equal_the_sequential_generator(spark):
    for seed in (1, 1234):
        got = [r[0] for r in spark.range(500).select(rng.uniform(seed, F.col("id"))).collect()]
        assert got == _draws(seed, 500)


def test_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), ""), (float("inf"), " "), (None, None), (0.0, "A")], "n double, s string")
    assert [r[0] for r in df.select(values.known(df, "n")).collect()] == [1.0, None, None, None, 0.0]
    assert [r[0] for r in df.select(values.known(df, "s")).collect()] == ["a", None, " ", None, "A"]
    assert record.select(df, record.condition(df, "n", ">", "0"), keep=False).count() == 4
    with pytest.raises(ValueError):
        record.condition(df, "n", "=", "x")


def test_text_to_number(spark):
    cases = {
        "007": 7.0, "1e3": 1000.0, "NaN": None, "Infinity": None, "1d": None, "": None, "$": 0.0, "$1,234.50": 1234.5, "12%": 12.0,
        " 12 ": 12.0, "x": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in df.select(values.as_number(F.col("s"))).collect()] == list(cases.values())
    assert [r[0] for r in spark.createDataFrame([(5.0,), (1e7,), (2.5,)], "x double").select(values.number_text(F.col("x"))).collect()] == ["5", "10000000", "2.5"]


def test_title_case(spark):
    df = spark.createDataFrame([("north-west foo/bar a_b",), ("  NORTH   west ",), (" x ",), ("  ",), (None,)], "s string")
    assert [r[0] for r in field.clean_text(df, ["s"]).collect()] == ["North-West Foo/Bar A_B", "North West", "X", None, None]


def test_joins_by_text(spark):
    left = spark.createDataFrame([(1001.0, "a"), (None, "b"), (7.0, "c")], "k double, v string")
    right = spark.createDataFrame([("1001", 1), ("1001.0", 2), (None, 3), ("7", 4), ("7", 5)], "k string, w int")
    assert record.merge(left, right, "k", "k").count() == 3
    assert record.merge(left, right, "k", "k", "left").count() == 4
    full = record.merge(left, right, "k", "k", "full")
    assert full.count() == 6 and full.where("k = '1001.0'").count() == 1


def test_empty_groups_and_ties(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert record.aggregate(none, ["g"], ["v"], ["Sum"]).count() == 0
    assert record.aggregate(none, [], ["v"], ["Sum"]).count() == 0
    ties = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "a")], "i int, s string")
    assert record.mode(ties, "s", ["i"]).first()["value"] == "b"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;text;id;\n1;"a;b";x;\n2;"say ""hi""";;\n3;last;y;\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "text", "id_2", "Field4"] and dict(df.dtypes)["id"] == "double" and dict(df.dtypes)["text"] == "string"
    assert [r["text"] for r in df.orderBy("id").collect()] == ["a;b", 'say "hi"', "last"]
    assert files.read_csv(spark, str(tmp_path / "a.csv"), ["text"], 2, "sample", 42).count() == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["no"])
    files.write_csv(df.select("id", "text"), str(tmp_path / "out"))
    again = files.read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.select("id", "text").collect()))


def test_chi_square_tail():
    assert math.isclose(models.chi_square_p(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(models.chi_square_p(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(models.chi_square_p(40.0, 2), math.exp(-20), rel_tol=1e-9)


def test_classifiers_reach_the_reference_accuracy(spark):
    rows = field.partition(samples.sample_data(spark, "iris"), ["Row"], 70, 42).persist()
    train, test = rows.where("Partition = '1_Training'"), rows.where("Partition = '2_Testing'")
    inputs = ["Sepal_Length", "Sepal_Width", "Petal_Length", "Petal_Width"]
    for fit, name in (
        (models.tree, "R"), (models.logistic, "L"), (models.ann, "ANN"), (lambda *a: models.svm(*a, cost=50), "SVM"),
        (models.NaiveBayes, "B"), (models.Chaid, "CH"),
    ):
        out = fit(train, "Species", inputs).transform(test)
        assert out.where(F.col(f"`${name}-Species`") == F.col("Species")).count() / test.count() > 0.85, name
    out = models.knn(train, test, "Species", inputs, "Row", block=40)
    assert out.where(F.col("`$KNN-Species`") == F.col("Species")).count() / test.count() > 0.85
    # Rows held out don't touch a fit.
    poisoned = train.unionByName(test.withColumn("Sepal_Length", F.lit(1e9)))
    again = models.NaiveBayes(poisoned.where("Partition = '1_Training'"), "Species", inputs).transform(test)
    assert again.exceptAll(models.NaiveBayes(train, "Species", inputs).transform(test)).isEmpty()


def test_one_class_is_refused(spark):
    with pytest.raises(ValueError):
        models.logistic(spark.createDataFrame([(1.0, "a"), (2.0, "a")], "x double, y string"), "y", ["x"])


def test_rules(spark):
    df = spark.createDataFrame([(str(i), x) for i in range(5) for x in ("Bread", "Butter ")], "id string, item string")
    sets = models.baskets(df, "id", "item")
    _, rules = models.apriori(sets, 10, 50)
    assert {(r["Antecedent"], r["Consequent"], r["Confidence"]) for r in rules.collect()} == {("Bread", "Butter", 1.0), ("Butter", "Bread", 1.0)}
    new = models.recommend(spark.createDataFrame([("99", ["Bread"])], "basket string, items array<string>"), rules)
    assert [tuple(r)[:2] for r in new.collect()] == [("99", "Butter")]


def test_stream(spark, tmp_path):
    from oreflow.streaming import scoring

    src = f"{tmp_path}/in"
    spark.range(20).selectExpr("id", "cast(id % 3 as double) AS v").coalesce(2).write.parquet(src)
    s = scoring.read_folder(spark, src, spark.read.parquet(src).schema)
    q = scoring.run(
        s, [lambda d: record.select(d, record.condition(d, "v", ">", "0")), lambda d: field.derive(d, "w", "v * 2")], f"{tmp_path}/out",
        f"{tmp_path}/ck",
    )
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 13
