"""Classification and regression trees, grown level by level: all nodes of a level at once.

A level is one grouped count of (node, field, value) with the classes' counts
(or the sums of a number and of its square).  Numbers are cut at midpoints
between neighbouring values, by prefix sums that run within ranges of values
(CUTS of them for each field, from its quantiles) with the ranges' own sums
before them, so no task sorts all values of a field; a text field's values
are each tried against all others.  Only one row for each node, its best cut,
reaches the driver.

A missing number counts as the field's mean over the training rows, a missing
text as the value ``(missing)``.  Of equal gains the first field wins, then
the lowest threshold or value.  A tree of up to MOST_DEPTH levels is one flat
table of nodes, and a row finds its node in as many steps as the tree is deep.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreflow.functions.values import as_text, col, cols, is_number, known, round_to
from oreflow.operators.lineage import kept

CUTS, MOST_DEPTH, MOST_CLASSES = 256, 16, 500
#: Gains below this are none.
NO_GAIN = 1e-9
#: Gains are compared at this many digits behind the point.
DIGITS = 6
MISSING = "(missing)"


def few_whole(df: DataFrame, field: str) -> bool:
    """Whether a number field has whole values only, of at most five kinds."""
    kinds = [r[0] for r in df.select(known(df, field).cast("double").alias("v")).where("v is not null").distinct().limit(6).collect()]
    return 0 < len(kinds) <= 5 and all(v == int(v) for v in kinds)


class Cart:
    """A fitted tree; adds ``$R-target`` and, for classes, ``$RC-target``, the share of the class in the leaf."""

    prefix = "R"

    def __init__(self, target: str, numbers: dict[str, float], order: list[str], classes: list[str] | None, nodes: list[dict[str, Any]]):
        self.target, self.numbers, self.order, self.classes, self.nodes = target, numbers, order, classes, nodes

    # -- a row's way down -------------------------------------------------------

    def _inputs(self, df: DataFrame) -> tuple[Column, Column]:
        """All number inputs and all text inputs as arrays, in the order of the fields; the other kind's places are filled."""
        nums = [F.coalesce(known(df, f).cast("double"), F.lit(self.numbers[f])) if f in self.numbers else F.lit(0.0) for f in self.order]
        texts = [F.lit("") if f in self.numbers else F.coalesce(as_text(df, f), F.lit(MISSING)) for f in self.order]
        return F.array(*nums), F.array(*texts)

    def place(self, nums: Column, texts: Column) -> Column:
        """The number of the node that a row reaches."""
        splits = [n.get("split") or {} for n in self.nodes]
        depth = max(n["depth"] for n in self.nodes)
        if not depth:
            return F.lit(0)
        of = lambda values: F.lit(values)
        at = lambda values, k: F.get(of(values), k)
        field = [self.order.index(s["field"]) if s else -1 for s in splits]
        number = [bool(s) and s["value"] is None for s in splits]
        threshold, value = [float(s["threshold"]) if s and s["value"] is None else 0.0 for s in splits], [s["value"] or "" if s else "" for s in splits]
        left, right = [n.get("left", -1) for n in self.nodes], [n.get("right", -1) for n in self.nodes]

        def step(k: Column, _: Column) -> Column:
            f = at(field, k)
            goes = F.when(at(number, k), F.get(nums, f) <= at(threshold, k)).otherwise(F.get(texts, f) == at(value, k))
            return F.when(f < 0, k).when(goes, at(left, k)).otherwise(at(right, k))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)

    def transform(self, df: DataFrame) -> DataFrame:
        k = self.place(F.col("__cart_n"), F.col("__cart_t"))
        nums, texts = self._inputs(df)
        scored = df.select(*cols(df.columns), nums.alias("__cart_n"), texts.alias("__cart_t")).withColumn("__cart_k", k)
        out = [F.get(F.lit([n["prediction"] for n in self.nodes]), F.col("__cart_k")).alias(f"${self.prefix}-{self.target}")]
        if self.classes is not None:
            out.append(round_to(F.get(F.lit([float(n["confidence"]) for n in self.nodes]), F.col("__cart_k"))).alias(f"${self.prefix}C-{self.target}"))
        return scored.select(*cols(df.columns), *out)

    # -- what it learnt -----------------------------------------------------------

    def importance(self) -> dict[str, float]:
        """Each input field's share of the gains, the greatest first; fields without any are left out."""
        total = dict.fromkeys(self.order, 0.0)
        for n in self.nodes:
            if n.get("split"):
                total[n["split"]["field"]] += n["split"]["gain"]
        whole = sum(total.values()) or 1.0
        return {f: g / whole for f, g in sorted(total.items(), key=lambda x: -x[1]) if g > 0}

    def rules(self, spark: SparkSession) -> DataFrame:
        """A row for each node: its number, depth, the conditions of the path to it, rows, prediction, confidence, gain and whether it is a leaf."""
        rows = []

        def walk(k: int, path: list[str]) -> None:
            n = self.nodes[k]
            s = n.get("split")
            rows.append((
                k, n["depth"], " and ".join(path) or "all", int(n["n"]), str(n["prediction"]), n.get("confidence"), s["gain"] if s else None, s is None,
            ))
            if s:
                yes, no = ("<=", ">") if s["value"] is None else ("=", "!=")
                what = f"{s['threshold']:.12g}" if s["value"] is None else f"'{s['value']}'"
                walk(n["left"], [*path, f"{s['field']} {yes} {what}"])
                walk(n["right"], [*path, f"{s['field']} {no} {what}"])

        walk(0, [])
        return spark.createDataFrame(
            rows, "node int, depth int, rule string, n bigint, prediction string, confidence double, gain double, leaf boolean",
        )


def _impurity(parts: list[Column], classes: bool) -> Column:
    """Rows times Gini, of the classes' counts; or the sum of squares about the mean, of (n, sum, sum of squares)."""
    if classes:
        total = sum(parts[1:], parts[0])
        return total - sum((p * p for p in parts[1:]), parts[0] * parts[0]) / total
    return parts[2] - parts[1] * parts[1] / parts[0]


def _size(parts: list[Any], classes: bool) -> Any:
    return sum(parts[1:], parts[0]) if classes else parts[0]


def _node(parts: list[float], classes: list[str] | None, depth: int) -> dict[str, Any]:
    """A node without a split, from its counts or sums."""
    n = _size(parts, classes is not None)
    if classes is None:
        return {"depth": depth, "n": n, "parts": parts, "prediction": parts[1] / n if n else 0.0, "impurity": parts[2] - parts[1] ** 2 / n if n else 0.0}
    top = max(range(len(parts)), key=lambda i: (parts[i], -i))
    return {
        "depth": depth, "n": n, "parts": parts, "prediction": classes[top], "confidence": parts[top] / n if n else 0.0,
        "impurity": n - sum(p * p for p in parts) / n if n else 0.0,
    }


def grow(train: DataFrame, target: str, inputs: list[str], max_depth: int = 5, min_leaf: int = 1, kind: str | None = None) -> Cart:
    """Fits a tree; ``kind`` is ``classes`` or ``number``, by default a number where the target is one and not :func:`few_whole`."""
    if not 1 <= max_depth <= MOST_DEPTH:
        raise ValueError(f"A tree can have 1 to {MOST_DEPTH} levels.")
    inputs, min_leaf = list(dict.fromkeys(inputs)), max(1, min_leaf)
    as_classes = kind == "classes" or kind is None and (not is_number(train, target) or few_whole(train, target))
    t = as_text(train, target) if as_classes else known(train, target).cast("double")
    rows = train.where(t.isNotNull())
    numbers = [f for f in inputs if is_number(train, f)]
    base = rows.select(t.alias("t"), *[(known(rows, f).cast("double") if f in numbers else as_text(rows, f)).alias(f"x{i}") for i, f in enumerate(inputs)])
    base = kept(base)  # read once for each level
    own = {f: f"x{i}" for i, f in enumerate(inputs)}
    stats = base.agg(F.count("*").alias("n"), *[F.avg(own[f]).alias(f"m{i}") for i, f in enumerate(numbers)], *[
        F.approx_percentile(own[f], F.lit([i / CUTS for i in range(1, CUTS)]), F.lit(4 * CUTS)).alias(f"e{i}") for i, f in enumerate(numbers)
    ]).first()
    fills = {f: float(stats[f"m{i}"] or 0.0) for i, f in enumerate(numbers)}
    edges = {f: sorted(set(stats[f"e{i}"] or [])) for i, f in enumerate(numbers)}
    classes: list[str] | None = None
    if as_classes:
        found = base.groupBy("t").count().limit(MOST_CLASSES + 1).collect()
        classes = sorted(r["t"] for r in found)
        if len(classes) < 2:
            raise ValueError("A tree needs two or more classes to tell apart.")
        if len(classes) > MOST_CLASSES:
            raise ValueError(f"A tree can tell at most {MOST_CLASSES} classes apart.")
        of = {r["t"]: float(r["count"]) for r in found}
        parts = [of[c] for c in classes]
        measures = [(F.col("t") == c).cast("double") for c in classes]
    else:
        if not stats["n"]:
            raise ValueError("A tree needs rows with a known target.")
        # Squares about the overall mean keep their digits.
        row = base.agg(F.avg("t").alias("m"), F.count("t").cast("double").alias("n")).first()
        shift = row["m"]
        measures = [F.lit(1.0), F.col("t") - shift, (F.col("t") - shift) ** 2]
        s, q = base.agg(F.sum(measures[1]), F.sum(measures[2])).first()
        parts = [row["n"], s, q]
    names = [f"c{i}" for i in range(len(measures))]
    model = Cart(target, fills, inputs, classes, [_node(parts, classes, 0)])
    nums = F.array(*[F.coalesce(F.col(own[f]), F.lit(fills[f])) if f in fills else F.lit(0.0) for f in inputs])
    texts = F.array(*[F.lit("") if f in fills else F.coalesce(F.col(own[f]), F.lit(MISSING)) for f in inputs])
    vectors = base.select(*[m.alias(n) for m, n in zip(measures, names, strict=True)], nums.alias("nums"), texts.alias("texts"))
    bins = F.get(F.lit([[float("nan"), *edges.get(f, [])] for f in inputs]), F.col("f"))  # a first edge that is above none
    frontier = [0]
    for depth in range(max_depth):
        frontier = [k for k in frontier if model.nodes[k]["n"] >= 2 * min_leaf and model.nodes[k]["impurity"] > NO_GAIN]
        if not frontier:
            break
        active = [k in set(frontier) for k in range(len(model.nodes))]
        at = vectors.withColumn("node", model.place(F.col("nums"), F.col("texts"))).where(F.get(F.lit(active), F.col("node")))
        cells = F.array(*[F.struct(
            F.lit(i).alias("f"), (F.get("nums", F.lit(i)) if f in fills else F.lit(None).cast("double")).alias("v"),
            (F.lit(None).cast("string") if f in fills else F.get("texts", F.lit(i))).alias("value"),
        ) for i, f in enumerate(inputs)])
        counts = at.select("node", *names, F.explode(cells).alias("x")).select("node", "x.*", *names)
        counts = counts.groupBy("node", "f", "v", "value").agg(*[F.sum(n).alias(n) for n in names])
        bin_ = F.when(F.col("v").isNotNull(), F.size(F.filter(bins, lambda e: e < F.col("v"))))
        counts = kept(counts.withColumn("bin", bin_))
        best = _best(counts, model, names, [k for k in frontier], min_leaf, as_classes)
        frontier = []
        for r in sorted(best.collect(), key=lambda r: r["node"]):  # one row for each node
            node, s = model.nodes[r["node"]], r["best"]
            gain = -s["loss"]
            if gain <= NO_GAIN:
                continue
            left = [float(x) for x in s["left"]]
            right = [a - b for a, b in zip(node["parts"], left, strict=True)]
            node["split"] = {"field": inputs[s["f"]], "threshold": s["threshold"], "value": s["value"], "gain": gain}
            for side, parts in (("left", left), ("right", right)):
                node[side] = len(model.nodes)
                frontier.append(len(model.nodes))
                model.nodes.append(_node(parts, classes, depth + 1))
    for n in model.nodes:
        if classes is None:
            n["prediction"] += shift
        del n["parts"], n["impurity"]
    return model


def _best(counts: DataFrame, model: Cart, names: list[str], frontier: list[int], min_leaf: int, classes: bool) -> DataFrame:
    """``node, best`` (loss, f, threshold, value, left) of the nodes that can be cut."""
    spark = counts.sparkSession
    total = spark.createDataFrame([(k, [float(x) for x in model.nodes[k]["parts"]]) for k in frontier], "node int, total array<double>")
    numbers = counts.where("v is not null")
    group, inside = ["node", "f"], ["node", "f", "bin"]
    order = Window.partitionBy(*group).orderBy("bin")  # as many rows as CUTS
    sums = numbers.groupBy(*inside).agg(F.min("v").alias("v"), *[F.sum(n).alias(n) for n in names])
    sums = sums.select(*inside, F.lead("v").over(order).alias("next"), *[(F.sum(n).over(order) - F.col(n)).alias(f"b_{n}") for n in names])
    w = Window.partitionBy(*inside).orderBy("v")
    cuts = numbers.join(sums, inside).select(
        *group, "v", F.coalesce(F.lead("v").over(w), "next").alias("up"), *[(F.sum(n).over(w) + F.col(f"b_{n}")).alias(n) for n in names],
    ).where("up is not null").select(*group, ((F.col("v") + F.col("up")) / 2).alias("threshold"), F.lit(None).cast("string").alias("value"), *names)
    tried = cuts.unionByName(counts.where("v is null").select(*group, F.lit(None).cast("double").alias("threshold"), "value", *names))
    left = [F.col(n) for n in names]
    tried = tried.join(F.broadcast(total), "node")  # a row for each open node
    whole = [F.get("total", F.lit(i)) for i in range(len(names))]
    right = [a - b for a, b in zip(whole, left, strict=True)]
    tried = tried.where((_size(left, classes) >= min_leaf) & (_size(right, classes) >= min_leaf))
    gain = _impurity(whole, classes) - _impurity(left, classes) - _impurity(right, classes)
    choice = F.struct((-round_to(gain, DIGITS)).alias("loss"), "f", "threshold", "value", F.array(*left).alias("left"))
    return tried.groupBy("node").agg(F.min(choice).alias("best"))
