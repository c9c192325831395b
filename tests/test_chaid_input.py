from pyspark.sql import functions as F

from oreflow.operators import models


def test_chaid_makes_its_training_rows_once(spark):
    """However many fields are cut and levels grown, the rows behind the training table are made once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(i):
        made.add(1)
        return float(i * 37 % 101)

    rows = spark.range(400).select("id", seen("id").alias("a"), (F.col("id") % 13).alias("b")).withColumn("y", F.when(F.col("a") + F.col("b") > 55, "p").otherwise("q"))
    tree = models.Chaid(rows, "y", ["a", "b"])
    assert len(tree.nodes) > 1 and 0 < made.value <= 800
