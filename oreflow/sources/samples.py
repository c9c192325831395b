"""Sample data made by rule: every row is a function of its number and a seed, so it is made in parallel at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.functions.rng import uniform
from oreflow.operators.lineage import kept

ITEMS = (
    "Bread", "Butter", "Milk", "Eggs", "Cheese", "Beer", "Chips", "Salsa", "Diapers", "Wipes", "Pasta", "Pasta Sauce", "Coffee", "Sugar",
    "Apples", "Bananas", "Yogurt", "Cereal",
)


def _pick(u: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


def _bell(seed: int, i: Column) -> Column:
    """About normal with deviation 1: twice the sum of three draws less their mean."""
    return 2 * (uniform(seed, i) + uniform(seed + 1, i) + uniform(seed + 2, i) - 1.5)


def flowers(spark: SparkSession, n: int = 150) -> DataFrame:
    i = F.col("id")
    k = (i % 3).cast("int")
    mean = lambda *m: F.get(F.array(*[F.lit(x) for x in m]), k)
    return spark.range(n).select(
        (mean(5.0, 5.9, 6.6) + _bell(11, i) * 0.35).alias("Sepal_Length"), (mean(3.4, 2.8, 3.0) + _bell(31, i) * 0.3).alias("Sepal_Width"),
        (mean(1.5, 4.3, 5.6) + _bell(51, i) * 0.3).alias("Petal_Length"), (mean(0.25, 1.3, 2.0) + _bell(71, i) * 0.15).alias("Petal_Width"),
        _pick(k / 3.0 + 0.01, ["setosa", "versicolor", "virginica"]).alias("Species"), i.alias("Row"),
    )


def customers(spark: SparkSession, n: int = 500, again: int = 12) -> DataFrame:
    """``n`` customers and ``again`` of them twice."""
    rows = spark.range(n + again).select(F.when(F.col("id") < n, F.col("id")).otherwise((F.col("id") - n) * 37 % n).alias("id"))
    i = F.col("id")
    u = lambda s: uniform(s, i)
    tenure = F.floor(u(5) * 72) + 1
    churn = u(9) < F.when(tenure < 12, 0.5).when(tenure < 36, 0.25).otherwise(0.1)
    return rows.select(
        (1001 + i).alias("CustomerID"), F.when(u(1) < 0.97, 18 + F.floor(u(2) * 60)).cast("double").alias("Age"),
        _pick(u(3), ["F", "M"]).alias("Gender"), _pick(u(4), ["North", "north ", "SOUTH", "East", "west"]).alias("Region"),
        tenure.cast("double").alias("Tenure"), F.when(u(6) < 0.94, F.round(20000 + u(7) * 90000, -2)).alias("Income"),
        _pick(u(8), ["Basic", "Plus", "Premium"]).alias("Plan"), F.when(churn, "Yes").otherwise("No").alias("Churn"),
    )


def usage(spark: SparkSession, n: int = 480, orphans: int = 8) -> DataFrame:
    """Of ``n`` customers, a twenty-fifth without an id, and of ``orphans`` that aren't customers."""
    i = F.col("id")
    customer = F.when(i >= n, 2001 + i - n).when(uniform(24, i) >= 0.04, 1001 + i)
    return spark.range(n + orphans).select(
        customer.alias("CustomerID"), F.round(20 + uniform(21, i) * 100, 2).alias("MonthlyCharges"),
        F.floor(uniform(22, i) * 8).cast("double").alias("SupportCalls"), F.round(uniform(23, i) * 50, 1).alias("DataGB"),
    )


def housing(spark: SparkSession, n: int = 300) -> DataFrame:
    i = F.col("id")
    area, beds, age = 600 + F.floor(uniform(41, i) * 2400), 1 + F.floor(uniform(42, i) * 5), F.floor(uniform(43, i) * 60)
    place = _pick(uniform(44, i), ["Downtown", "Rural", "Suburb"])
    price = 40000 + 110 * area + 9000 * beds - 700 * age + F.when(place == "Downtown", 60000).when(place == "Suburb", 25000).otherwise(0) + _bell(45, i) * 9000
    return spark.range(n).select(
        (i + 1).alias("HouseID"), place.alias("Neighborhood"), area.cast("double").alias("SqFt"), beds.cast("double").alias("Bedrooms"),
        age.cast("double").alias("AgeYears"), F.round(price).alias("Price"),
    )


def _holdings(spark: SparkSession, n: int) -> DataFrame:
    """For each basket whether it has each item: by its own chance; butter follows bread, salsa follows chips, wipes follow diapers."""
    i = F.col("id")
    has = {x: (uniform(61 + k, i) < 0.12 + 0.02 * (k % 5)).alias(x) for k, x in enumerate(ITEMS)}
    rows = spark.range(n).select("id", *has.values(), uniform(97, i).alias("__u"))
    for a, b in (("Bread", "Butter"), ("Chips", "Salsa"), ("Diapers", "Wipes"), ("Pasta", "Pasta Sauce")):
        rows = rows.withColumn(b, F.col(b) | F.col(a) & (F.col("__u") < 0.7))
    return rows.select((i + 1).alias("BasketID"), *ITEMS)


def baskets(spark: SparkSession, n: int = 400) -> DataFrame:
    """A row for each item of a basket."""
    items = F.array_compact(F.array(*[F.when(F.col(x), x) for x in ITEMS]))
    return _holdings(spark, n).select("BasketID", F.explode(items).alias("Item"))


def basket_flags(spark: SparkSession, n: int = 400) -> DataFrame:
    """The same baskets with a field of T and F for each item."""
    return _holdings(spark, n).select("BasketID", *[F.when(F.col(x), "T").otherwise("F").alias(x) for x in ITEMS])


SAMPLES = {"iris": flowers, "customers": customers, "usage": usage, "housing": housing, "baskets": baskets, "basket_flags": basket_flags}


def sample_data(spark: SparkSession, name: str) -> DataFrame:
    if name not in SAMPLES:
        raise ValueError("Choose a dataset.")
    # Kept, as the draws make long expressions that no later plan should carry along.
    return kept(SAMPLES[name](spark))
