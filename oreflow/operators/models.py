"""Models on Spark: each fits by aggregations or MLlib and scores with Columns or a transformer."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreflow.functions.values import as_text, col, cols, is_number, known, round_to
from oreflow.operators import cart, clusters, gradient, record
from oreflow.operators.associations import Rules, apriori, baskets, flag_baskets, recommend, value_baskets  # noqa: F401
from oreflow.operators.chaid import Chaid, chi_square_p  # noqa: F401
from oreflow.operators.neighbours import Neighbours, matrix
from oreflow.operators.lineage import kept

#: Rows of a table that is sent to every task; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def _sized(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


# -- features -----------------------------------------------------------------


@dataclass
class Encoder:
    """Numbers standardised (missing: 0), text one-hot over its commonest values; what it holds can be written as JSON."""

    numbers: dict[str, tuple[float, float]]  # mean and deviation
    texts: dict[str, list[str]]
    order: list[str]

    @classmethod
    def fit(cls, train: DataFrame, fields: list[str], most: int = 30, drop_first: bool = False) -> Encoder:
        """The statistics of ``train``."""
        numbers = [f for f in fields if is_number(train, f)]
        own = [x for f in numbers for x in (F.avg(known(train, f)).alias(f"m_{f}"), F.stddev_samp(known(train, f)).alias(f"s_{f}"))]
        stats = train.agg(*own).first() if numbers else {}
        scale = {f: (float(stats[f"m_{f}"] or 0.0), float(stats[f"s_{f}"] or 0.0)) for f in numbers}
        texts = {}
        for f in fields:
            if f not in numbers:
                common = train.groupBy(as_text(train, f).alias("v")).count().where("v is not null").orderBy(F.desc("count"), "v").limit(most)
                texts[f] = [r["v"] for r in common.collect()][1 if drop_first else 0 :]
        return cls(scale, texts, list(fields))

    def terms(self) -> list[str]:
        """The names of the encoded columns."""
        return [t for f in self.order for t in ([f] if f in self.numbers else [f"{f}={v}" for v in self.texts[f]])]

    def sources(self) -> list[str]:
        """The field of each encoded column."""
        return [f for f in self.order for _ in ([f] if f in self.numbers else self.texts[f])]

    def columns(self, df: DataFrame) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for f in self.order:
            if f in self.numbers:
                m, s = self.numbers[f]
                out[f] = F.coalesce((known(df, f).cast("double") - m) / (s if s > 0 else 1.0), F.lit(0.0))
            else:
                out |= {f"{f}={v}": F.coalesce((as_text(df, f) == v).cast("double"), F.lit(0.0)) for v in self.texts[f]}
        return out


def encode(train: DataFrame, fields: list[str], most: int = 30, drop_first: bool = False) -> dict[str, Column]:
    """The feature Columns of an :class:`Encoder` fitted on ``train``; they apply to any frame with the fields."""
    return Encoder.fit(train, fields, most, drop_first).columns(train)


def with_vector(df: DataFrame, features: dict[str, Column], name: str = "features") -> DataFrame:
    names = [f"__f{i}" for i in range(len(features))]
    ready = df.select("*", *[c.alias(n) for n, c in zip(names, features.values(), strict=True)])
    return VectorAssembler(inputCols=names, outputCol=name).transform(ready).drop(*names)


class Supervised:
    """A fitted MLlib model of a number with its features: adds ``$prefix-target``."""

    def __init__(self, prefix: str, target: str, encoder: Encoder, model: PipelineModel):
        self.prefix, self.target, self.encoder, self.model = prefix, target, encoder, model

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``term, coefficient``, the intercept last."""
        m = self.model.stages[0]
        rows = [*zip(self.encoder.terms(), map(float, m.coefficients), strict=True), ("(Intercept)", float(m.intercept))]
        return spark.createDataFrame(rows, "term string, coefficient double")

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(with_vector(df, self.encoder.columns(df), "__x"))
        return scored.select(*cols(df.columns), F.col("__p").alias(f"${self.prefix}-{self.target}"))


def _classes(train: DataFrame, target: str) -> DataFrame:
    rows = train.withColumn("__t", as_text(train, target)).where("__t is not null")
    if rows.select("__t").distinct().limit(2).count() < 2:
        raise ValueError("The target has to have two or more different values.")
    return rows


def tree(train: DataFrame, target: str, inputs: list[str], max_depth: int = 4, min_leaf: int = 5) -> cart.Cart:
    """CART by Gini or variance (:mod:`oreflow.operators.cart`)."""
    return cart.grow(train, target, inputs, max_depth, min_leaf)


class Svm:
    """One separating plane for each class: the greatest margin wins, and the confidence is the softmax of the margins."""

    def __init__(self, target: str, encoder: Encoder, classes: list[str], planes: list[tuple[list[float], float]]):
        self.target, self.encoder, self.classes, self.planes = target, encoder, classes, planes

    def transform(self, df: DataFrame) -> DataFrame:
        x = list(self.encoder.columns(df).values())
        margins = [sum((c * w for c, w in zip(x, ws, strict=True) if w), F.lit(b)) for ws, b in self.planes]
        return gradient.chosen(df.withColumn("__s", F.array(*margins)), df.columns, self.classes, f"$SVM-{self.target}", f"$SVMC-{self.target}")

    def weights(self, spark: SparkSession) -> DataFrame:
        """``term, class, weight`` of every plane, the intercept last."""
        rows = [(t, c, float(w)) for c, (ws, b) in zip(self.classes, self.planes, strict=True) for t, w in zip([*self.encoder.terms(), "(Intercept)"], [*ws, b], strict=True)]
        return spark.createDataFrame(rows, "term string, class string, weight double")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value:g}; it can be from {low:g} to {high:g}.")


def svm(train: DataFrame, target: str, inputs: list[str], cost: float = 1.0, iterations: int = 1000, rate: float = 0.1) -> Svm:
    """Half the squared weights plus ``cost`` times the mean hinge loss, for each class against the rest, by ``iterations`` steps of a falling rate."""
    _within("SVM cost", cost, 1e-6, 100)
    _within("SVM iterations", iterations, 1, 10_000)
    encoder, classes, data, n = gradient.encoded(train, target, inputs, lambda rows: Encoder.fit(rows, inputs))
    start = [np.zeros((len(classes), len(encoder.terms()))), np.zeros(len(classes))]
    w, b = gradient.descend(data, start, *gradient.svm_step(n, cost, rate), iterations)
    data.unpersist()
    return Svm(target, encoder, classes, [(x.tolist(), float(y)) for x, y in zip(w, b, strict=True)])


def ann(
    train: DataFrame, target: str, inputs: list[str], hidden: int = 8, iterations: int = 500, seed: int = 42, rate: float = 0.1, l2: float = 1e-3,
) -> gradient.Network:
    """One layer of ``hidden`` tanh units and a softmax, by steps of backpropagation from a seeded start."""
    _within("ANN hidden units", hidden, 1, 128)
    _within("ANN iterations", iterations, 1, 10_000)
    encoder, classes, data, n = gradient.encoded(train, target, inputs, lambda rows: Encoder.fit(rows, inputs))
    start = gradient.network_start(len(encoder.terms()), hidden, len(classes), seed)
    w = gradient.descend(data, start, *gradient.network_step(n, l2, rate), iterations)
    data.unpersist()
    return gradient.Network("ANN", target, encoder, classes, [(w[0].tolist(), w[1].tolist()), (w[2].tolist(), w[3].tolist())])


def logistic(train: DataFrame, target: str, inputs: list[str], l2: float = 1e-3, iterations: int = 300, rate: float = 0.3) -> gradient.Network:
    """Softmax regression with an L2 term on all but the intercepts, by steps from zero; a text's commonest value is the base."""
    _within("Logistic iterations", iterations, 1, 10_000)
    encoder, classes, data, n = gradient.encoded(train, target, inputs, lambda rows: Encoder.fit(rows, inputs, drop_first=True))
    start = [np.zeros((len(classes), len(encoder.terms()))), np.zeros(len(classes))]
    w, b = gradient.descend(data, start, *gradient.logistic_step(n, l2, rate), iterations)
    data.unpersist()
    return gradient.Network("L", target, encoder, classes, [(w.tolist(), b.tolist())])


def linear(train: DataFrame, target: str, inputs: list[str], ridge: float = 0.0) -> Supervised:
    """Least squares by normal equations; the penalty is scaled as MLlib expects it."""
    sd = train.agg(F.stddev_pop(known(train, target).cast("double"))).first()[0] or 1.0
    train = train.select(*cols(dict.fromkeys([target, *inputs]))).persist()  # read by several aggregations
    rows = train.withColumn("__t", known(train, target).cast("double")).where("__t is not null")
    encoder = Encoder.fit(rows, inputs, drop_first=True)
    vectors = with_vector(rows, encoder.columns(rows), "__x").select("__x", F.col("__t").alias("__y"))
    body = Pipeline(stages=[LinearRegression(
        featuresCol="__x", labelCol="__y", predictionCol="__p", solver="normal", standardization=False, elasticNetParam=0.0, regParam=(1e-6 + ridge) * sd,
    )]).fit(vectors)
    train.unpersist()
    return Supervised("E", target, encoder, body)


# -- models by aggregation ------------------------------------------------------


class NaiveBayes:
    """Gaussian and categorical naive Bayes from grouped aggregations; scores by Columns.

    The means of numbers are constants of the plan, one for each class; the
    counts of a text field's values are a table that is joined, by broadcast
    if it is short, so any number of values will do.
    """

    def __init__(self, train: DataFrame, target: str, inputs: list[str], laplace: float = 1.0):
        a = laplace or 1.0
        rows = _classes(train, target)
        self.target, self.numbers = target, [f for f in inputs if is_number(train, f)]
        self.texts = [f for f in inputs if f not in self.numbers]
        per = {r["__t"]: r for r in rows.groupBy("__t").agg(
            F.count("*").alias("n"),
            *[x for f in self.numbers for x in (F.avg(known(train, f)).alias(f"m_{f}"), F.stddev_samp(known(train, f)).alias(f"s_{f}"))],
        ).collect()}
        self.classes, total = sorted(per), sum(r["n"] for r in per.values())
        self.prior = [math.log(per[k]["n"] / total) for k in self.classes]
        self.bells: dict[str, list[tuple[float, float] | None]] = {}
        for f in self.numbers:
            means = [(per[k][f"m_{f}"], per[k][f"s_{f}"] or 0.0) for k in self.classes]
            self.bells[f] = [None if m is None else (m, max(s, 1e-3 * (abs(m) + 1))) for m, s in means]
        self.tables: dict[str, tuple[DataFrame, list[float]]] = {}
        for f in self.texts:
            counts = rows.groupBy(as_text(train, f).alias("v"), "__t").agg(F.count("*").alias("n")).where("v is not null")
            size = {r["__t"]: r["n"] for r in counts.groupBy("__t").agg(F.sum("n").alias("n")).collect()}
            kinds = counts.select("v").distinct().count()
            base = [size.get(k, 0) + a * (kinds + 1) for k in self.classes]
            logs = [F.log((F.coalesce(F.sum(F.when(F.col("__t") == k, F.col("n"))), F.lit(0)) + a) / x) for k, x in zip(self.classes, base, strict=True)]
            self.tables[f] = kept(counts.groupBy("v").agg(F.array(*logs).alias("logs"))), [math.log(a / x) for x in base]

    def transform(self, df: DataFrame) -> DataFrame:
        out, found = df, []
        for i, (f, (table, unseen)) in enumerate(self.tables.items()):
            out = out.withColumn(f"__v{i}", as_text(df, f)).join(
                _sized(table.select(F.col("v").alias(f"__v{i}"), F.col("logs").alias(f"__l{i}"))), f"__v{i}", "left",
            )
            found.append((F.col(f"__v{i}"), F.col(f"__l{i}"), unseen))
        logs = []
        for k in range(len(self.classes)):
            log: Column = F.lit(self.prior[k])
            for f, bells in self.bells.items():
                if bells[k]:
                    (m, s), x = bells[k], known(df, f).cast("double")
                    log = log + F.coalesce(-math.log(s) - (x - m) * (x - m) / (2 * s * s), F.lit(0.0))
            for value, own, unseen in found:
                log = log + F.when(value.isNull(), 0.0).otherwise(F.coalesce(F.get(own, F.lit(k)), F.lit(unseen[k])))
            logs.append(log)
        out = out.withColumn("__s", F.array(*logs))
        best = F.array_max(F.transform("__s", lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))
        spread = F.aggregate("__s", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("__b")["s"]))
        names = F.array(*[F.lit(k) for k in self.classes])
        scored = out.withColumn("__b", best)
        return scored.select(
            *cols(df.columns), F.get(names, -F.col("__b")["i"]).alias(f"$B-{self.target}"),
            round_to(1 / spread).alias(f"$BC-{self.target}"),
        )


def knn(train: DataFrame, df: DataFrame, target: str, inputs: list[str], key: str, k: int = 5, block: int = 4000) -> DataFrame:
    """Exact k nearest neighbours of each row of ``df``: vote of the classes, or mean of numbers; ties of distance by ``key``."""
    return Neighbours.fit(train, target, inputs, key, Encoder.fit(train, inputs), k).transform(df, block)


def _distances(vector: Column, centres: list[list[float]]) -> Column:
    """The distance to each centre, as an array."""
    square = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(F.lit([[float(x) for x in c] for c in centres]), lambda c: F.sqrt(square(c)))


def _nearest(vector: Column, centres: list[list[float]]) -> Column:
    """``d`` and ``k`` (from 0) of the first nearest centre."""
    return F.array_min(F.transform(_distances(vector, centres), lambda d, i: F.struct(d.alias("d"), i.alias("k"))))


def assign(df: DataFrame, vector: Column, centres: list[list[float]], prefix: str = "KM") -> DataFrame:
    """The nearest centre (ties: the first) as ``cluster-k`` and the distance."""
    near = df.withColumn("__b", _nearest(vector, centres))
    return near.select(
        *cols(df.columns), F.concat(F.lit("cluster-"), F.col("__b")["k"] + 1).alias(f"${prefix}-K-Means"), F.col("__b")["d"].alias(f"${prefix}D-K-Means"),
    )


def kmeans_centres(df: DataFrame, vector: Column, k: int, seed: int = 1, iterations: int = 50, keys: list[str] | None = None) -> list[list[float]]:
    """Lloyd's algorithm from a seeded start (:mod:`oreflow.operators.clusters`); rows in the order of ``keys``, else of their vectors."""
    return clusters.fit(df, vector, k, seed, iterations, keys)[0].tolist()


def kmeans(df: DataFrame, vector: Column, k: int, key: str, seed: int = 1, iterations: int = 50, full: int = 2000) -> DataFrame:
    """Cluster and distance of each row and, of up to ``full`` rows, its silhouette ``$KMS-K-Means``."""
    out = kept(assign(df, vector, kmeans_centres(df, vector, k, seed, iterations, [key])))
    if out.limit(full + 1).count() > full:
        return out
    found = silhouette(out, vector, "$KM-K-Means", key, full=full)
    return out.join(F.broadcast(found.select(F.col("key").alias(key), round_to(F.col("silhouette")).alias("$KMS-K-Means"))), key, "left")


def single_cluster(df: DataFrame, features: dict[str, Column], percent: float = 5.0) -> DataFrame:
    """One centre: distance, index (distance by its mean) and the flag of those beyond the quantile."""
    x = list(features.values())
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    d = F.sqrt(sum(((c - means[f"m{i}"]) ** 2 for i, c in enumerate(x)), F.lit(0.0)))
    return _flagged(df, d, *_cut_off(df, d, percent))


def _share(percent: float | None) -> float:
    return min(50.0, max(0.1, percent or 5.0)) / 100


def _cut_off(df: DataFrame, d: Column, percent: float) -> tuple[float, float]:
    """The mean of a distance, and its quantile that leaves ``percent`` of the rows beyond."""
    out = df.select(d.alias("d"))
    return out.agg(F.avg("d")).first()[0] or 1.0, (record.quantile(out, "d", 1 - _share(percent)) or [math.inf])[0]


def _flagged(df: DataFrame, d: Column, mean: float, cut: float) -> DataFrame:
    out = df.withColumn("$KMD-K-Means", d)
    return out.withColumn("$KMI-K-Means", col("$KMD-K-Means") / mean).withColumn(
        "$KMA-K-Means", F.when(col("$KMD-K-Means") > cut, "anomaly").otherwise("normal"),
    )


class KMeans:
    """Saved centres: adds cluster and distance or, of one centre, distance, index and flag."""

    def __init__(self, encoder: Encoder, centres: list[list[float]], mean: float | None = None, cut: float | None = None):
        self.encoder, self.centres, self.mean, self.cut = encoder, centres, mean, cut

    @classmethod
    def fit(cls, train: DataFrame, inputs: list[str], k: int = 3, seed: int = 1, iterations: int = 50, keys: list[str] | None = None, percent: float = 5.0) -> KMeans:
        """``k`` clusters; with one, the cut-off that flags ``percent`` of the training rows."""
        encoder = Encoder.fit(train, inputs)
        x = F.array(*encoder.columns(train).values()).cast("array<double>")
        if k > 1:
            return cls(encoder, kmeans_centres(train, x, k, seed, iterations, keys))
        means = train.agg(*[F.avg(c) for c in encoder.columns(train).values()]).first()
        centre = [[float(m or 0.0) for m in means]]
        return cls(encoder, centre, *_cut_off(train, _nearest(x, centre)["d"], percent))

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.array(*self.encoder.columns(df).values()).cast("array<double>")
        if self.mean is None:
            return assign(df, x, self.centres)
        return _flagged(df, _nearest(x, self.centres)["d"], self.mean, self.cut)


class Anomaly:
    """Peer groups: adds flag, index (distance by its group's mean), group and, of anomalies, the field behind most of the distance."""

    def __init__(self, encoder: Encoder, centres: list[list[float]], means: list[float], cut: float):
        self.encoder, self.centres, self.means, self.cut = encoder, centres, means, cut

    @classmethod
    def fit(
        cls, train: DataFrame, inputs: list[str], groups: int = 3, percent: float = 5.0, seed: int = 1, centres: list[list[float]] | None = None,
        index: float | None = None, keys: list[str] | None = None,
    ) -> Anomaly:
        """The cut-off is the index that ``percent`` of the training rows exceed, or ``index`` itself if given."""
        encoder = Encoder.fit(train, inputs)
        x = F.array(*encoder.columns(train).values()).cast("array<double>")
        centres = centres or kmeans_centres(train, x, groups, seed, keys=keys)
        near = kept(train.select(_nearest(x, centres).alias("b")).select("b.*"))
        found = {r["k"]: r["m"] for r in near.groupBy("k").agg(F.avg("d").alias("m")).collect()}  # a row for each group
        overall = near.agg(F.avg("d")).first()[0] or 0.0
        means = [m if (m := found.get(k, 0.0)) > 1e-9 else overall if overall > 1e-9 else 1.0 for k in range(len(centres))]
        out = cls(encoder, centres, means, index if index is not None else math.inf)
        if index is None:
            out.cut = record.quantile(near.select((F.col("d") / F.get(F.lit(means), "k")).alias("i")), "i", 1 - _share(percent))[0]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        x = list(self.encoder.columns(df).values())
        out = df.withColumn("__b", _nearest(F.array(*x).cast("array<double>"), self.centres))
        out = out.withColumn("__i", F.col("__b")["d"] / F.get(F.lit(self.means), F.col("__b")["k"]))
        middle = F.get(F.lit(self.centres), F.col("__b")["k"])
        owners = self.encoder.sources()
        share = [F.struct(
            sum(((c - F.get(middle, F.lit(i))) ** 2 for i, (c, own) in enumerate(zip(x, owners, strict=True)) if own == f), F.lit(0.0)).alias("s"),
            F.lit(-k).alias("k"), F.lit(f).alias("f"),
        ) for k, f in enumerate(self.encoder.order)]
        flag = F.col("__i") > self.cut
        return out.select(
            *cols(df.columns), F.col("__i").alias("$OA-Anomaly"), F.when(flag, "anomaly").otherwise("normal").alias("$O-Anomaly"),
            F.concat(F.lit("peer-"), F.col("__b")["k"] + 1).alias("$OP-Anomaly"), F.when(flag, F.array_max(F.array(*share))["f"]).alias("$OR-Anomaly"),
        )


def anomaly(
    train: DataFrame, df: DataFrame, inputs: list[str], groups: int = 3, percent: float = 5.0, seed: int = 1, centres: list[list[float]] | None = None,
    index: float | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """:class:`Anomaly` fitted on ``train``, or about given ``centres``, and applied to ``df``."""
    return Anomaly.fit(train, inputs, groups, percent, seed, centres, index, keys).transform(df)


def profiles(scored: DataFrame, inputs: list[str], cluster: str) -> DataFrame:
    """``cluster, n, field, value``: each cluster's mean of a number and commonest value of a text (of equally common ones the first)."""
    numbers = [f for f in inputs if is_number(scored, f)]
    name = col(cluster).alias("cluster")
    sizes = scored.groupBy(name).agg(F.count("*").alias("n"), *[F.avg(known(scored, f).cast("double")).alias(f"m{i}") for i, f in enumerate(numbers)])
    shown = [F.struct(F.lit(f).alias("field"), round_to(F.col(f"m{i}")).cast("string").alias("value")) for i, f in enumerate(numbers)]
    none = F.array().cast("array<struct<field:string,value:string>>")
    out = sizes.select("cluster", "n", F.inline(F.array(*shown) if shown else none))
    for f in (f for f in inputs if f not in numbers):
        counts = scored.groupBy(name, as_text(scored, f).alias("v")).agg(F.count("*").alias("c")).where("v is not null")
        top = counts.groupBy("cluster").agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("value"))
        out = out.unionByName(sizes.join(F.broadcast(top), "cluster").select("cluster", "n", F.lit(f).alias("field"), "value"))
    return out


#: The least mean silhouette of each band, and its name.
BANDS = ((0.7, "strong"), (0.5, "reasonable"), (0.25, "weak"))


def silhouette_summary(found: DataFrame) -> DataFrame:
    """``cluster, n, silhouette, structure`` of scored records by cluster, and of all of them as cluster ``all``."""
    rows = found.select("cluster", "silhouette").unionByName(found.select(F.lit("all").alias("cluster"), "silhouette"))
    per = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"))
    band: Column = F.lit("none")
    for least, name in reversed(BANDS):
        band = F.when(F.col("silhouette") > least, name).otherwise(band)
    return per.withColumn("structure", band)


def silhouette(
    df: DataFrame, vector: Column, cluster: str, key: str, sample: int = 1000, seed: int = 7919, full: int = 2000,
    of: DataFrame | None = None, block: int = 4000,
) -> DataFrame:
    """Euclidean silhouettes against all rows: of every record up to ``full`` rows, above that of ``sample`` records (those with the smallest seeded hash).

    With ``of``, rows of ``df`` themselves, of those records instead.  Scored
    records and all rows are dealt into blocks of about ``block``; each pair of
    blocks is one group that adds up its distances by cluster, and only
    (record, cluster, sum, count) rows are merged.  ``key`` is a whole number.
    """
    shape = lambda x: x.select(col(key).cast("bigint").alias("key"), col(cluster).alias("cluster"), vector.cast("array<double>").alias("x"))
    rows = shape(df)
    if of is not None:
        chosen = kept(shape(of))
    else:
        n = df.limit(full + 1).count()
        chosen = kept(rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(full if n <= full else sample))
    left, right, _ = paired(chosen.withColumnRenamed("key", "id"), rows.withColumnRenamed("key", "id"), block)

    def add(q: pa.Table, t: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "cluster": [], "other": [], "s": [], "n": []}
        if q.num_rows and t.num_rows:
            x, y = (matrix(s.column("x")) for s in (q, t))
            keys, own, names = q.column("id").to_pylist(), q.column("cluster").to_pylist(), np.array(t.column("cluster").to_pylist(), object)
            members = {c: np.flatnonzero(names == c) for c in dict.fromkeys(names.tolist())}
            for at in range(0, len(x), 256):
                some = x[at : at + 256]
                d = np.sqrt(np.maximum(0, (some**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * some @ y.T))
                for c, where in members.items():
                    out["key"] += keys[at : at + 256]
                    out["cluster"] += own[at : at + 256]
                    out["other"] += [c] * len(some)
                    out["s"] += d[:, where].sum(axis=1).tolist()
                    out["n"] += [len(where)] * len(some)
        return pa.table(out, schema=pa.schema([("key", pa.int64()), ("cluster", pa.string()), ("other", pa.string()), ("s", pa.float64()), ("n", pa.int64())]))

    sums = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(add, "key bigint, cluster string, other string, s double, n bigint")
    # Kept, so that no later step's unused columns are pruned below the pairing.
    sums = kept(sums.groupBy("key", "cluster", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    same = F.col("other") == F.col("cluster")
    per = sums.groupBy("key", "cluster").agg(
        F.max(F.when(same, F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)))).alias("a"),
        F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"),
    )
    return per.select("key", "cluster", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def paired(left: DataFrame, right: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with block numbers ``a`` and ``b``, copied so that every block of one meets every block of the other, and the number of pairs; rows are dealt by ``id``."""
    sizes = [max(1, -(-x.count() // block)) for x in (left, right)]
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return left.select("*", part(sizes[0]).alias("a"), every(sizes[1]).alias("b")), right.select("*", every(sizes[0]).alias("a"), part(sizes[1]).alias("b")), sizes[0] * sizes[1]


# -- splits, contingency, rules ----------------------------------------------------


def best_splits(df: DataFrame, target: str, inputs: list[str], cuts: int = 256) -> DataFrame:
    """For each numeric input the threshold with the largest Gini gain (midpoints of neighbouring values; ties: the lowest).

    One grouped count per (input, value, class); prefix sums run over ranges of distinct values.
    """
    t = as_text(df, target)
    long = df.where(t.isNotNull()).select(
        t.alias("cls"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), known(df, f).cast("double").alias("v")) for f in inputs])).alias("x"),
    ).select("cls", "x.*").where("v is not null")
    counts = long.groupBy("field", "v", "cls").agg(F.count("*").alias("n"))
    classes = sorted(r["cls"] for r in counts.select("cls").distinct().collect())
    names = [f"c{i}" for i in range(len(classes))]
    wide = counts.groupBy("field", "v").agg(*[F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).cast("double").alias(n) for c, n in zip(classes, names, strict=True)])
    # Values are cut into ranges, so that no task sorts all values of a field; the ranges' sums give each its start.
    edges = wide.groupBy("field").agg(F.approx_percentile("v", F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), F.lit(4 * cuts)).alias("edges"))
    placed = kept(wide.join(F.broadcast(edges), "field").select(
        "field", "v", *names, F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("bin"),
    ))
    order, every = Window.partitionBy("field").orderBy("bin"), Window.partitionBy("field")  # as many rows as cuts
    bins = placed.groupBy("field", "bin").agg(F.min("v").alias("v"), *[F.sum(n).alias(n) for n in names])
    bins = bins.select(
        "field", "bin", F.lead("v").over(order).alias("next"), *[(F.sum(n).over(order) - F.col(n)).alias(f"b_{n}") for n in names],
        *[F.sum(n).over(every).alias(f"t_{n}") for n in names],
    )
    w = Window.partitionBy("field", "bin").orderBy("v")
    sums = placed.join(F.broadcast(bins), ["field", "bin"]).select(
        "field", "v", F.coalesce(F.lead("v").over(w), "next").alias("up"),
        *[(F.sum(n).over(w) + F.col(f"b_{n}")).alias(f"l_{n}") for n in names], *[f"t_{n}" for n in names],
    )

    def impurity(parts: list[Column]) -> Column:
        total = sum(parts[1:], parts[0])
        return total - sum((p * p for p in parts[1:]), parts[0] * parts[0]) / total

    left = [F.col(f"l_{n}") for n in names]
    total = [F.col(f"t_{n}") for n in names]
    right = [a - b for a, b in zip(total, left, strict=True)]
    gain = impurity(total) - impurity(left) - impurity(right)
    found = sums.where("up is not null").select("field", ((F.col("v") + F.col("up")) / 2).alias("threshold"), gain.alias("gain"))
    return found.groupBy("field").agg(F.max(F.struct(round_to(F.col("gain"), 6).alias("gain"), (-F.col("threshold")).alias("t"))).alias("b")).select(
        "field", (-F.col("b")["t"]).alias("threshold"), F.col("b")["gain"].alias("gain"),
    )


def chi_square(df: DataFrame, field: str, target: str) -> DataFrame:
    """Pearson's chi-square of two text fields and its degrees of freedom, from one contingency count."""
    c = df.groupBy(
        as_text(df, field).alias("a"), as_text(df, target).alias("b"),
    ).agg(F.count("*").alias("n")).where("a is not null and b is not null")
    rows = c.groupBy("a").agg(F.sum("n").alias("na"))
    cols = c.groupBy("b").agg(F.sum("n").alias("nb"))
    total = c.agg(F.sum("n").alias("n")).first()["n"] or 1
    # chi2 = n * (sum n_ab^2 / (n_a n_b) - 1); empty cells add nothing.
    share = c.join(rows, "a").join(cols, "b").agg(
        F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.count_distinct("a").alias("ra"),
        F.count_distinct("b").alias("rb"),
    )
    return share.select((total * (F.col("s") - 1)).alias("chi2"), ((F.col("ra") - 1) * (F.col("rb") - 1)).alias("df"))
