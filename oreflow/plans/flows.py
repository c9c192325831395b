"""Whole flows over the given tables, each from source to report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.operators import field, models, record, report

TRAINING = "Partition = '1_Training'"
#: Dimensions of the vectors that the flows' models see.
DIMENSIONS = [f"e{i}" for i in range(8)]


def _buyers(t) -> DataFrame:
    """Customers with their orders, cleaned, filled and split; ``Churn`` says who ordered less than most."""
    orders = t("orders").select("o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    spent = record.aggregate(orders, ["c_custkey"], ["o_totalprice"], ["Mean", "Sum"])
    rows = record.merge(record.distinct(t("customer"), ["c_custkey"], ["c_custkey"]), spent, "c_custkey", "c_custkey")
    rows = field.fill(field.clean_text(rows, ["c_mktsegment"]), ["c_acctbal"], "median")
    middle = record.quantile(rows, "Record_Count", 0.5)[0]
    rows = rows.withColumn("Churn", F.when(F.col("Record_Count") < middle, "Yes").otherwise("No"))
    return field.partition(rows, ["c_custkey"]).persist()


def example_churn(t) -> DataFrame:
    """Precision, recall and accuracy of a tree and of logistic regression."""
    rows, inputs = _buyers(t), ["c_acctbal", "c_mktsegment", "c_nationkey", "o_totalprice_Mean", "o_totalprice_Sum"]
    train = rows.where(TRAINING)
    tree = models.tree(train, "Churn", inputs, max_depth=4, min_leaf=10).transform(rows)
    logistic = models.logistic(train, "Churn", inputs, iterations=60).transform(rows)
    found = [report.class_metrics(x, "Churn", f"${p}-Churn", "Partition") for x, p in ((tree, "R"), (logistic, "L"))]
    return record.append(found, "model", ["tree", "logistic"])


def _vectors(t) -> DataFrame:
    rows = t("embeddings").select("vec_id", F.concat(F.lit("k"), "label").alias("kind"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(DIMENSIONS)])
    return field.partition(rows, ["vec_id"], 70, 42).persist()


def example_classify_flowers(t) -> DataFrame:
    """Accuracies of neighbours, a tree and CHAID on the kinds of vectors, on both parts."""
    rows = _vectors(t)
    train = rows.where(TRAINING)
    scored = [
        (models.knn(train, rows, "kind", DIMENSIONS, "vec_id", k=5), "KNN"), (models.tree(train, "kind", DIMENSIONS, max_depth=5, min_leaf=3).transform(rows), "R"),
        (models.Chaid(train, "kind", DIMENSIONS, max_depth=3, min_parent=20, min_child=5).transform(rows), "CH"),
    ]
    return record.append([report.class_metrics(x, "kind", f"${p}-kind", "Partition") for x, p in scored], "model", [p for _, p in scored])


def example_surrogate(t) -> DataFrame:
    """A network's accuracy, and how far a tree that learns its answers agrees with them."""
    rows = _vectors(t)
    taught = models.ann(rows.where(TRAINING), "kind", DIMENSIONS, hidden=8, iterations=80, rate=0.5).transform(rows).persist()
    name = "$ANN-kind"
    tree = models.tree(taught.where(TRAINING), name, DIMENSIONS, max_depth=6, min_leaf=5).transform(taught)
    found = [report.class_metrics(taught, "kind", name, "Partition"), report.class_metrics(tree, name, f"$R-{name}", "Partition")]
    return record.append(found, "compared", ["network with truth", "tree with network"])


def example_margins(t) -> DataFrame:
    """A linear support vector machine's accuracy on both parts."""
    rows = _vectors(t)
    scored = models.svm(rows.where(TRAINING), "kind", DIMENSIONS, cost=50, iterations=80).transform(rows)
    return report.class_metrics(scored, "kind", "$SVM-kind", "Partition")


def example_house_prices(t) -> DataFrame:
    """Errors of linear regression and of a tree on the parts' prices, on both parts."""
    rows = field.partition(t("part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice"), ["p_partkey"], 75, 7).persist()
    inputs, train = ["p_size", "p_brand", "p_type", "p_partkey"], rows.where(TRAINING)
    linear = models.linear(train, "p_retailprice", inputs).transform(rows)
    tree = models.tree(train, "p_retailprice", inputs, max_depth=5, min_leaf=8).transform(rows)
    found = [report.regression_metrics(x, "p_retailprice", f"${p}-p_retailprice", "Partition") for x, p in ((linear, "E"), (tree, "R"))]
    return record.append(found, "model", ["linear", "tree"])


def example_clusters(t) -> DataFrame:
    """Clusters of the vectors against their kinds."""
    rows = _vectors(t)
    scored = models.KMeans.fit(rows, DIMENSIONS, 10, keys=["vec_id"]).transform(rows)
    return report.distribution(scored, "$KM-K-Means", "kind")


def example_anomalies(t) -> DataFrame:
    """Customers far from the centre of all, or of their peer group, with the field behind it."""
    rows, inputs = _buyers(t), ["c_acctbal", "o_totalprice_Mean", "o_totalprice_Sum"]
    one = models.KMeans.fit(rows, inputs, 1).transform(rows).select("c_custkey", "`$KMI-K-Means`", "`$KMA-K-Means`")
    peers = models.anomaly(rows.where(TRAINING), rows, inputs, 3, 5.0, keys=["c_custkey"])
    return peers.select("c_custkey", *[F.col(f"`{c}`") for c in peers.columns if c.startswith("$")]).join(one, "c_custkey")


FLOWS = (example_churn, example_classify_flowers, example_surrogate, example_margins, example_house_prices, example_clusters, example_anomalies)
