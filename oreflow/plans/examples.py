"""The ready-made flows over the sample data, each from source to report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.operators import field, models, record, report
from oreflow.sources import samples

FLOWER = ["Sepal_Length", "Sepal_Width", "Petal_Length", "Petal_Width"]
TRAINING = "Partition = '1_Training'"


def _split(spark: SparkSession, train: float = 70, seed: int = 42) -> DataFrame:
    return field.partition(samples.sample_data(spark, "iris"), ["Row"], train, seed).persist()


def churn(spark: SparkSession) -> DataFrame:
    """Customers without repeats, joined, cleaned, filled and split; precision, recall and accuracy of a tree and of logistic regression."""
    c = record.distinct(samples.sample_data(spark, "customers"), ["CustomerID"], ["CustomerID"])
    rows = record.merge(c, samples.sample_data(spark, "usage"), "CustomerID", "CustomerID")
    rows = field.fill(field.clean_text(rows, ["Region"]), ["Age", "Income"], "median")
    rows = field.partition(rows, ["CustomerID"]).persist()
    inputs, train = ["Age", "Tenure", "Plan", "Region", "MonthlyCharges"], rows.where(TRAINING)
    tree = models.tree(train, "Churn", inputs, max_depth=4, min_leaf=10).transform(rows)
    logistic = models.logistic(train, "Churn", inputs).transform(rows)
    found = [report.class_metrics(x, "Churn", f"${p}-Churn", "Partition") for x, p in ((tree, "R"), (logistic, "L"))]
    return record.append(found, "model", ["tree", "logistic"])


def classify_flowers(spark: SparkSession) -> DataFrame:
    """Accuracies of neighbours, a tree and CHAID on both parts."""
    rows = _split(spark)
    train = rows.where(TRAINING)
    scored = [
        (models.knn(train, rows, "Species", FLOWER, "Row", k=5), "KNN"),
        (models.tree(train, "Species", FLOWER, max_depth=3, min_leaf=3).transform(rows), "R"),
        (models.Chaid(train, "Species", FLOWER, max_depth=3, min_parent=20, min_child=5).transform(rows), "CH"),
    ]
    return record.append([report.class_metrics(x, "Species", f"${p}-Species", "Partition") for x, p in scored], "model", [p for _, p in scored])


def surrogate(spark: SparkSession) -> DataFrame:
    """A network's accuracy, and how far a shallow tree that learns its answers agrees with them."""
    rows = _split(spark)
    taught = models.ann(rows.where(TRAINING), "Species", FLOWER, hidden=8, iterations=500, seed=42).transform(rows).persist()
    name = "$ANN-Species"
    tree = models.tree(taught.where(TRAINING), name, FLOWER, max_depth=3, min_leaf=5).transform(taught)
    found = [report.class_metrics(taught, "Species", name, "Partition"), report.class_metrics(tree, name, f"$R-{name}", "Partition")]
    return record.append(found, "compared", ["network with truth", "tree with network"])


def margins(spark: SparkSession) -> DataFrame:
    """A linear support vector machine's accuracy on both parts."""
    rows = _split(spark)
    scored = models.svm(rows.where(TRAINING), "Species", FLOWER, cost=50).transform(rows)
    return report.class_metrics(scored, "Species", "$SVM-Species", "Partition")


def house_prices(spark: SparkSession) -> DataFrame:
    """Errors of linear regression and of a tree on both parts."""
    rows = field.partition(samples.sample_data(spark, "housing"), ["HouseID"], 75, 7).persist()
    inputs, train = ["SqFt", "Bedrooms", "AgeYears", "Neighborhood"], rows.where(TRAINING)
    linear = models.linear(train, "Price", inputs).transform(rows)
    tree = models.tree(train, "Price", inputs, max_depth=5, min_leaf=8).transform(rows)
    found = [report.regression_metrics(x, "Price", f"${p}-Price", "Partition") for x, p in ((linear, "E"), (tree, "R"))]
    return record.append(found, "model", ["linear", "tree"])


def clusters(spark: SparkSession) -> DataFrame:
    """Three clusters against the species."""
    rows = samples.sample_data(spark, "iris")
    x = F.array(*models.encode(rows, FLOWER).values())
    return report.distribution(models.kmeans(rows, x, 3, "Row"), "$KM-K-Means", "Species")


def anomalies(spark: SparkSession) -> DataFrame:
    """Flowers far from the centre of all, or of their peer group, with the field behind it."""
    rows = _split(spark, 70, 3)
    one = models.single_cluster(rows, models.encode(rows, FLOWER), 5.0).select("Row", "`$KMI-K-Means`", "`$KMA-K-Means`")
    peers = models.anomaly(rows.where(TRAINING), rows, FLOWER, 3, 5.0)
    return peers.select("Row", *[F.col(f"`{c}`") for c in peers.columns if c.startswith("$")]).join(one, "Row")


def market_basket(spark: SparkSession) -> DataFrame:
    return models.apriori(models.baskets(samples.sample_data(spark, "baskets"), "BasketID", "Item"), 5, 50)[1]


def basket_flags(spark: SparkSession) -> DataFrame:
    flags = samples.sample_data(spark, "basket_flags")
    return models.apriori(models.flag_baskets(flags, list(samples.ITEMS), "BasketID"), 5, 50)[1]


EXAMPLES: dict[str, Callable[[SparkSession], DataFrame]] = {
    "example_churn": churn, "example_classify_flowers": classify_flowers, "example_surrogate": surrogate, "example_margins": margins,
    "example_house_prices": house_prices, "example_clusters": clusters, "example_anomalies": anomalies, "example_market_basket": market_basket,
    "example_basket_flags": basket_flags,
}
