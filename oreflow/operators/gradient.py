"""Fits by full-batch steps of fixed rates: support vector planes, softmax regression, and a network with one hidden layer.

A step is one pass over blocks of at most 4,096 encoded rows (:mod:`oreflow.operators.blocks`):
the weights go out with the step's tasks, sums of gradients come back, and the
driver, which holds the weights only, moves them.  The number of steps, the
rates and the seeded start are parameters, so a fit is the same at every run
and number of tasks, up to the order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.functions import rng
from oreflow.functions.values import as_text, cols, round_to
from oreflow.operators import blocks

Weights = list[np.ndarray]


def _parts(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> Weights:
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


def descend(data: DataFrame, start: Weights, gradient: Callable[[Weights, np.ndarray, np.ndarray], Weights], move: Callable[[int, Weights, Weights], Weights], steps: int) -> Weights:
    """``steps`` times: sum ``gradient(weights, x, y)`` over all blocks and ``move(step, weights, sums)``."""
    shapes = [w.shape for w in start]

    def stepped(weights: Weights, total: Callable[[Weights], Weights]) -> Weights:
        for k in range(steps):
            weights = move(k, weights, total(weights))
            if not all(np.isfinite(w).all() for w in weights):
                raise ValueError("The fit ran away from its data; a smaller rate keeps it near.")
        return weights

    if data.count() > 1:
        flat = lambda w: (lambda x, y: np.concatenate([g.ravel() for g in gradient(w, x, y)]))
        return stepped(start, lambda w: _parts(blocks.summed(data, flat(w)), shapes))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The sums of a single block need no one else: its task makes all steps.
        for _, x, y in blocks.matrices(batches):
            weights = stepped(start, lambda w, x=x, y=y: gradient(w, x, y))
            yield pa.RecordBatch.from_pydict({"w": [np.concatenate([w.ravel() for w in weights]).tobytes()]})

    return _parts(np.frombuffer(data.mapInArrow(whole, "w binary").first()["w"], float), shapes)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def svm_step(n: int, cost: float, rate: float):
    """Hinge losses of all classes against the rest: gradient and move of (planes, intercepts)."""

    def gradient(w: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
        sign = np.where(y[:, None] == np.arange(len(w[1])), 1.0, -1.0)
        pull = np.where(sign * (x @ w[0].T + w[1]) < 1, sign * cost / n, 0.0)
        return [-(pull.T @ x), -pull.sum(axis=0)]

    def move(k: int, w: Weights, g: Weights) -> Weights:
        r = rate / (1 + 0.01 * k)
        return [w[0] - r * (w[0] + g[0]), w[1] - r * g[1]]

    return gradient, move


def logistic_step(n: int, l2: float, rate: float):
    """Cross-entropy of softmax regression: gradient and move of (coefficients, intercepts)."""

    def gradient(w: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
        miss = softmax(x @ w[0].T + w[1])
        miss[np.arange(len(y)), y] -= 1
        return [miss.T @ x, miss.sum(axis=0)]

    def move(_: int, w: Weights, g: Weights) -> Weights:
        return [w[0] - rate * (g[0] / n + l2 * w[0]), w[1] - rate * g[1] / n]

    return gradient, move


def network_start(inputs: int, hidden: int, classes: int, seed: int) -> Weights:
    """Uniform weights within the square root of 6 / (fan in + fan out), drawn row by row; no bias."""
    u = rng.draws(seed, hidden * inputs + classes * hidden) * 2 - 1
    first, second = u[: hidden * inputs].reshape(hidden, inputs), u[hidden * inputs :].reshape(classes, hidden)
    return [first * np.sqrt(6 / (hidden + inputs)), np.zeros(hidden), second * np.sqrt(6 / (classes + hidden)), np.zeros(classes)]


def network_step(n: int, l2: float, rate: float):
    """Cross-entropy behind a layer of tanh units: gradient and move of (first, its bias, second, its bias)."""

    def gradient(w: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
        h = np.tanh(x @ w[0].T + w[1])
        miss = softmax(h @ w[2].T + w[3])
        miss[np.arange(len(y)), y] -= 1
        back = (miss @ w[2]) * (1 - h * h)
        return [back.T @ x, back.sum(axis=0), miss.T @ h, miss.sum(axis=0)]

    def move(_: int, w: Weights, g: Weights) -> Weights:
        return [a - rate * (b / n + (l2 * a if k % 2 == 0 else 0.0)) for k, (a, b) in enumerate(zip(w, g, strict=True))]

    return gradient, move


def _layer(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """The sums of one layer's units."""
    if not weights[0]:  # no inputs
        return F.lit(bias)
    sums = F.transform(F.lit(weights), lambda w: F.aggregate(F.zip_with(w, x, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v))
    return F.zip_with(sums, F.lit(bias), lambda s, b: s + b)


class Network:
    """Layers of weights with tanh between them; adds ``$prefix-target`` and the softmax share of the first best class as confidence."""

    def __init__(self, prefix: str, target: str, encoder, classes: list[str], layers: list[tuple[list[list[float]], list[float]]]):
        self.prefix, self.target, self.encoder, self.classes, self.layers = prefix, target, encoder, classes, layers

    def scores(self, df: DataFrame) -> Column:
        """The last layer's sums as an array Column."""
        out = F.array(*self.encoder.columns(df).values()).cast("array<double>")
        for k, (weights, bias) in enumerate(self.layers):
            out = _layer(out, weights, bias)
            if k < len(self.layers) - 1:
                out = F.transform(out, lambda v: F.tanh(v))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return chosen(df.withColumn("__s", self.scores(df)), df.columns, self.classes, f"${self.prefix}-{self.target}", f"${self.prefix}C-{self.target}")

    def coefficients(self, spark) -> DataFrame:
        """Of a single layer: ``term, class, coefficient`` and, with two classes, the odds ratio of the second over the first."""
        if len(self.layers) > 1:
            raise ValueError("Only a single layer has coefficients of the inputs.")
        weights, bias = self.layers[0]
        rows = [(term, c, w[j]) for c, w in zip(self.classes, weights, strict=True) for j, term in enumerate(self.encoder.terms())]
        rows += [("(Intercept)", c, b) for c, b in zip(self.classes, bias, strict=True)]
        if len(self.classes) == 2:
            first = {t: v for t, c, v in rows if c == self.classes[0]}
            rows = [(t, c, v - first[t], float(np.exp(v - first[t]))) for t, c, v in rows if c == self.classes[1]]
        else:
            rows = [(*r, None) for r in rows]
        return spark.createDataFrame(rows, "term string, class string, coefficient double, odds_ratio double")


def chosen(scored: DataFrame, columns: list[str], classes: list[str], name: str, confidence: str) -> DataFrame:
    """``columns`` with the first class of the greatest of ``__s`` and its softmax share."""
    best = F.array_max(F.transform("__s", lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))
    spread = F.aggregate("__s", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("__b")["s"]))
    out = scored.withColumn("__b", best)
    return out.select(*cols(columns), F.get(F.lit(classes), -F.col("__b")["i"]).alias(name), round_to(1 / spread).alias(confidence))


def encoded(train: DataFrame, target: str, inputs: list[str], encoder_of: Callable[[DataFrame], object]):
    """The encoder, classes, blocks and number of the rows with a known target."""
    train = train.select(*cols(dict.fromkeys([target, *inputs]))).persist()  # read by several aggregations
    t = as_text(train, target)
    rows = train.where(t.isNotNull())
    encoder = encoder_of(rows)
    classes = sorted(r["t"] for r in rows.select(t.alias("t")).distinct().collect())
    if len(classes) < 2:
        raise ValueError("The target has to have two or more different values.")
    x = F.array(*encoder.columns(rows).values())
    data = blocks.blocked(rows, x, F.array_position(F.lit(classes), t) - 1)
    train.unpersist()
    n = data.agg(F.sum("n")).first()[0]
    return encoder, classes, blocks.joined(data) if n <= blocks.SIZE else data, n
