"""Reports as DataFrames: table, audit, distribution, plot, analysis of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreflow.functions.values import as_text, col, cols, is_number, known


def table(df: DataFrame, keys: list[str], n: int = 500) -> DataFrame:
    return df.orderBy(*cols(keys)).limit(n)


def _value_counts(df: DataFrame) -> DataFrame:
    """``field, value, n`` of all fields: each row is unpivoted once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), as_text(df, c).alias("value")) for c in df.columns])
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


def audit(df: DataFrame) -> DataFrame:
    """One row per field: kind, range, mean, deviation (numbers), distinct values, commonest value (text), valid and missing rows.

    One aggregation for the statistics, one grouped count for the values.
    """
    numbers = [c for c in df.columns if is_number(df, c)]
    out = []
    for c in df.columns:
        v = known(df, c)
        num = v.cast("double") if c in numbers else F.lit(None).cast("double")
        sd = F.when(F.count(num) == 1, 0.0).otherwise(F.stddev_samp(num))
        out.append(F.struct(
            F.lit(c).alias("field"), F.lit("number" if c in numbers else "string").alias("kind"), F.min(num).alias("min"),
            F.max(num).alias("max"), F.avg(num).alias("mean"), sd.alias("sdev"), F.count(v).alias("valid"),
            (F.count(F.lit(1)) - F.count(v)).alias("missing"),
        ))
    rows = df.agg(F.array(*out).alias("rows")).select(F.inline("rows"))
    first = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    values = _value_counts(df).groupBy("field").agg(
        F.count("*").alias("distinct"), F.when(~F.col("field").isin(numbers) if numbers else F.lit(True), first).alias("top"),
    )
    joined = rows.join(F.broadcast(values), "field", "left")  # a row for each field
    return joined.select("field", "kind", "min", "max", "mean", "sdev", F.coalesce("distinct", F.lit(0)).alias("distinct"), "valid", "missing", "top")


def shapes(df: DataFrame, bins: int = 12, most: int = 12) -> DataFrame:
    """The audit's small charts as ``field, place, n``: a number's histogram of ``bins``, or the counts of a text's ``most`` commonest values."""
    numbers = [c for c in df.columns if is_number(df, c)]
    texts = [c for c in df.columns if c not in numbers]
    out = df.sparkSession.createDataFrame([], "field string, place bigint, n bigint")
    if numbers:
        v = {c: known(df, c).cast("double") for c in numbers}
        edges = df.agg(*[x for i, c in enumerate(numbers) for x in (F.min(v[c]).alias(f"lo{i}"), F.max(v[c]).alias(f"hi{i}"))]).first()
        places = []
        for i, c in enumerate(numbers):
            lo, hi = edges[f"lo{i}"], edges[f"hi{i}"]
            if lo is not None:
                width = (hi - lo) / bins or 1.0
                place = F.least(F.lit(bins - 1), F.floor((v[c] - lo) / width)).cast("bigint")
                places.append(F.struct(F.lit(c).alias("field"), place.alias("place")))
        if places:
            long = df.select(F.explode(F.array(*places)).alias("x")).select("x.*").where("place is not null")
            out = out.union(long.groupBy("field", "place").agg(F.count("*").alias("n")))
    counts = _value_counts(df.select(*cols(texts))) if texts else None
    for c in texts:  # a top-k each, merged from the tasks' own
        top = counts.where(F.col("field") == c).orderBy(F.desc("n"), "value").limit(most)
        out = out.union(top.select("field", F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1, "n"))
    return out


def histogram(df: DataFrame, field: str, bins: int = 10) -> DataFrame:
    """Equal widths over the whole range, the last bin closed: bin number, bounds and count."""
    c = known(df, field).cast("double")
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, low double, high double, n bigint")
    width = (hi - lo) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((c - lo) / width)).cast("bigint")
    found = df.where(c.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return found.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "n")


def distribution(df: DataFrame, field: str, overlay: str | None = None, bins: int = 10, most: int = 40, groups: int = 10) -> DataFrame:
    """Counts of a field's values by an overlay's groups.

    Text: the ``most`` commonest values; whole numbers of at most 25 kinds:
    each value; other numbers: a histogram.  The overlay shows its first
    ``groups`` names in alphabetical order.
    """
    label = as_text(df, field)
    if is_number(df, field):
        c = known(df, field).cast("double")
        whole, kinds = df.agg(F.min((c == F.floor(c)).cast("int")), F.count_distinct(c)).first()
        if not (whole == 1 and kinds <= 25):
            lo, hi = df.agg(F.min(c), F.max(c)).first()
            width = ((hi - lo) / max(2, bins) or 1.0) if lo is not None else 1.0
            label = F.least(F.lit(max(2, bins) - 1), F.floor((c - F.lit(lo)) / width)).cast("string")
    out = df.select(label.alias("label"), *([as_text(df, overlay).alias("group")] if overlay else []))
    total = out.groupBy("label").agg(F.count("*").alias("total"))
    if not is_number(df, field):
        total = total.orderBy(F.desc("total"), "label").limit(most)
    if not overlay:
        return total.withColumnRenamed("total", "n")
    names = out.where("group is not null").select("group").distinct().orderBy("group").limit(groups)
    return out.join(F.broadcast(names), "group").join(total, "label").groupBy("label", "group").agg(F.count("*").alias("n"))


def shares(found: DataFrame, df: DataFrame, field: str) -> DataFrame:
    """A distribution of ``field`` with each count's share of those shown, and how many rows of ``df`` lack the field."""
    missing = df.where(known(df, field).isNull()).count()
    every = Window.partitionBy(F.lit(0))  # as many rows as bars
    return found.where("label is not null").withColumn("share", F.col("n") / F.sum("n").over(every)).withColumn("missing", F.lit(missing).cast("bigint"))


def plot(df: DataFrame, x: str, y: str, keys: list[str], colour: str | None = None, most: int = 3000) -> DataFrame:
    """The first points with both numbers, in the order of ``keys``."""
    ok = known(df, x).isNotNull() & known(df, y).isNotNull()
    return df.where(ok).orderBy(*cols(keys)).limit(most).select(
        col(x).cast("double").alias("x"), col(y).cast("double").alias("y"),
        *([F.coalesce(as_text(df, colour), F.lit("$null$")).alias("colour")] if colour else []),
    )


def confusion(df: DataFrame, actual: str, predicted: str, part: str | None = None) -> DataFrame:
    """Counts of (actual, predicted), compared as text; rows that lack either are left out."""
    a, p = as_text(df, actual), as_text(df, predicted)
    group = col(part) if part else F.lit("All records")
    return df.where(a.isNotNull() & p.isNotNull()).groupBy(group.alias("part"), a.alias("actual"), p.alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, actual: str, predicted: str, part: str | None = None) -> DataFrame:
    """Precision and recall of every class (NULL without such rows) and the accuracy of its part."""
    c = confusion(df, actual, predicted, part)
    both = c.select(
        "part", F.col("actual").alias("class"), "n", (F.col("actual") == F.col("predicted")).alias("hit"), F.lit(True).alias("is_actual"),
    ).union(c.select("part", "predicted", "n", F.col("actual") == F.col("predicted"), F.lit(False)))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    per = both.groupBy("part", "class").agg(
        count(F.col("hit") & F.col("is_actual")).alias("hits"), count(F.col("is_actual")).alias("actual"),
        count(~F.col("is_actual")).alias("predicted"),
    )
    w = Window.partitionBy("part")  # as many rows as classes
    return per.select(
        "part", "class", (F.col("hits") / F.nullif(F.col("predicted"), F.lit(0))).alias("precision"),
        (F.col("hits") / F.nullif(F.col("actual"), F.lit(0))).alias("recall"),
        (F.sum("hits").over(w) / F.sum("actual").over(w)).alias("accuracy"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, part: str | None = None) -> DataFrame:
    """Mean absolute error, root mean square error, R squared (0 for a constant target) and bias."""
    y, p = known(df, actual).cast("double"), known(df, predicted).cast("double")
    e = y - p
    rows = df.where(y.isNotNull() & p.isNotNull())
    sst = F.var_pop(y) * F.count(y)
    return rows.groupBy((col(part) if part else F.lit("All records")).alias("part")).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(sst == 0, 0.0).otherwise(1 - F.sum(e * e) / sst).alias("r2"), F.avg(e).alias("bias"),
    )
