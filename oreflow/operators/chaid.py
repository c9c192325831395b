"""CHAID: multiway trees whose categories are merged while alike, split on the smallest adjusted p-value.

Each level is one grouped count of (node, field, code, class) in Spark.  The
contingency table of a node and field, at most codes x classes numbers, is one
small group that a task merges; the driver gets the merged groups of the
fields and picks each node's split.

Numbers have ordered codes, of which only neighbours may be merged, and one
for missing values, which may join any of them; texts have a code for each
value, missing included, of which any two may be merged.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.functions.values import as_text, col, cols, is_number, known, round_to
from oreflow.operators import record
from oreflow.operators.lineage import kept

#: Categories of a text field at most; of more the commonest that are asked for.
MOST_CATEGORIES = 5000
MISSING = "(missing)"


def upper_tails(chi2: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > chi2) of the chi-square distribution for each place: finite sums, as df / 2 is whole or a half more."""
    out = np.ones(len(chi2))
    for d in np.unique(df):
        at = np.flatnonzero((df == d) & (chi2 > 0))
        if d <= 0 or not len(at):
            continue
        z = chi2[at] / 2
        if d % 2:
            total = np.fromiter(map(math.erfc, np.sqrt(z)), float, len(z))
            term = 2 * np.sqrt(z / math.pi) * np.exp(-z)
            for k in range((int(d) - 1) // 2):
                total = total + term
                term = term * z / (k + 1.5)
        else:
            term = total = np.exp(-z)
            for k in range(1, int(d) // 2):
                term = term * z / k
                total = total + term
        out[at] = np.minimum(1.0, total)
    return out


def chi_square_p(chi2: float, df: int) -> float:
    """The upper tail for one value."""
    return float(upper_tails(np.array([float(chi2)]), np.array([df]))[0])


def log_upper_tail(chi2: float, df: int) -> float:
    """The logarithm of the same, also where the tail itself is below the least number."""
    if df <= 0 or chi2 <= 0:
        return 0.0
    z, logs = chi2 / 2, []
    if df % 2:
        x = math.sqrt(z)
        # Far out, erfc(x) = exp(-z) / (x sqrt(pi)) (1 - 1 / 2z + 3 / 4z^2 - ...).
        far = -z - math.log(x * math.sqrt(math.pi)) + math.log1p(-1 / (2 * z) + 3 / (4 * z * z) - 15 / (8 * z**3)) if x > 20 else math.log(math.erfc(x))
        logs = [far, *(-z + (k + 0.5) * math.log(z) - math.lgamma(k + 1.5) for k in range((df - 1) // 2))]
    else:
        logs = [-z + k * math.log(z) - math.lgamma(k + 1) for k in range(df // 2)]
    top = max(logs)
    return min(0.0, top + math.log(math.fsum(math.exp(x - top) for x in logs)))


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def log_stirling(n: int, r: int) -> float:
    """The logarithm of the number of ways to make ``r`` groups of ``n`` things."""
    row = np.full(r + 1, -np.inf)
    row[0] = 0.0
    logs = np.log(np.arange(1, r + 1))
    for _ in range(n):
        row[1:] = np.logaddexp(row[1:] + logs, row[:-1])
        row[0] = -np.inf
    return float(row[r])


def pearson(table: np.ndarray) -> tuple[float, int]:
    """Chi-square and degrees of freedom of a table of counts, empty rows and columns left out."""
    m = table[table.sum(1) > 0][:, table.sum(0) > 0]
    if min(m.shape) < 2:
        return 0.0, 0
    want = m.sum(1)[:, None] * m.sum(0)[None] / m.sum()
    return float(((m - want) ** 2 / want).sum()), (m.shape[0] - 1) * (m.shape[1] - 1)


def _against(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """p-values of one row of counts with each of many."""
    both = one + many
    a, b = one.sum(), many.sum(1)
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        # Of two rows: n^2 / (a b) * sum over classes of (x b - y a)^2 / (n^2 (x + y)).
        parts = np.where(both > 0, (one * b[:, None] - many * a) ** 2 / both, 0.0).sum(1) / (a * b)
    return upper_tails(np.where(a * b > 0, parts, 0.0), (both > 0).sum(1) - 1)


def _least(groups: np.ndarray, alive: np.ndarray, least: int) -> int:
    """The smallest living group of fewer than ``least`` rows, or -1."""
    size = np.where(alive, groups.sum(1), np.inf)
    k = int(size.argmin())
    return k if size[k] < least else -1


def merge_unordered(counts: np.ndarray, alpha: float, least: int) -> list[list[int]]:
    """Groups of rows: the most alike pair is merged while p > alpha, then groups under ``least`` rows join the most alike one.

    Each group keeps its best partner behind it; a merge changes one group, so
    only the rows that lost their partner look through all others again.
    """
    groups, alive = counts.astype(float).copy(), np.ones(len(counts), bool)
    members = [[i] for i in range(len(counts))]
    best, partner = np.full(len(counts), -1.0), np.full(len(counts), -1)

    def look(i: int) -> None:
        others = np.flatnonzero(alive[i + 1 :]) + i + 1
        best[i], partner[i] = -1.0, -1
        if len(others):
            p = _against(groups[i], groups[others])
            best[i], partner[i] = p.max(), others[p.argmax()]

    def join(i: int, j: int) -> None:
        groups[i] += groups[j]
        members[i] = sorted(members[i] + members[j])
        alive[j], best[j] = False, -1.0
        look(i)
        before = np.flatnonzero(alive[:i])
        if len(before):
            p = _against(groups[i], groups[before])
            lost = (partner[before] == j) | (partner[before] == i) & (p < best[before])
            won = (p > best[before]) | (p == best[before]) & (i <= partner[before])
            best[before[won]], partner[before[won]] = p[won], i
            for r in before[lost & ~won]:
                look(int(r))
        for r in np.flatnonzero(alive[i + 1 : j] & (partner[i + 1 : j] == j)) + i + 1:
            look(int(r))

    for i in range(len(counts)):
        look(i)
    while alive.sum() > 1:
        i = int(best.argmax())
        if best[i] <= alpha:
            break
        join(i, int(partner[i]))
    while alive.sum() > 1 and (k := _least(groups, alive, least)) >= 0:
        others = np.flatnonzero(alive & (np.arange(len(alive)) != k))
        j = int(others[_against(groups[k], groups[others]).argmax()])
        join(min(k, j), max(k, j))
    return [members[i] for i in np.flatnonzero(alive)]


def merge_ordered(counts: np.ndarray, missing: int | None, alpha: float, least: int) -> list[list[int]]:
    """The same where only neighbours may be merged; row ``missing``, until it has joined another, with any."""
    groups = [([i], counts[i].astype(float), i == missing) for i in range(len(counts))]
    seen: dict[tuple[tuple[int, ...], tuple[int, ...]], float] = {}

    def p(i: int, j: int) -> float:
        key = tuple(groups[i][0]), tuple(groups[j][0])
        if key not in seen:
            seen[key] = float(_against(groups[i][1], groups[j][1][None])[0])
        return seen[key]

    def pairs() -> list[tuple[int, int]]:
        tied = [i for i, g in enumerate(groups) if not g[2]]
        out = list(zip(tied, tied[1:], strict=False))
        return out + [(i, j) for i, g in enumerate(groups) if g[2] for j in tied]

    def join(i: int, j: int) -> None:
        a, b = groups[i], groups[j]
        groups[min(i, j)] = sorted(a[0] + b[0]), a[1] + b[1], a[2] and b[2]
        del groups[max(i, j)]
        groups.sort(key=lambda g: g[0][0])

    while len(groups) > 1:
        best = max(pairs(), key=lambda x: p(*x), default=None)
        if best is None or p(*best) <= alpha:
            break
        join(*best)
    while len(groups) > 1:
        k = min(range(len(groups)), key=lambda i: groups[i][1].sum())
        if groups[k][1].sum() >= least:
            break
        best = max((x for x in pairs() if k in x), key=lambda x: p(*x), default=None)
        if best is None:
            break
        join(*best)
    return [g[0] for g in groups]


def grouping(counts: np.ndarray, ordered: bool, missing: int | None, alpha: float, least: int) -> tuple[list[list[int]], float, int, float]:
    """The merged rows of a table of counts, their chi-square, degrees of freedom and the logarithm of the adjusted p-value."""
    groups = merge_ordered(counts, missing, alpha, least) if ordered else merge_unordered(counts, alpha, least)
    r = len(groups)
    if r < 2:
        return groups, 0.0, 0, 0.0
    chi2, df = pearson(np.array([counts[g].sum(0) for g in groups], float))
    if ordered:
        held = missing is not None
        ranges = sum(any(i != missing for i in g) for g in groups)
        ways = log_choose(max(0, len(counts) - held - 1), max(0, ranges - 1)) + (math.log(r) if held else 0.0)
    else:
        ways = log_stirling(len(counts), r)
    return groups, chi2, df, min(0.0, log_upper_tail(chi2, df) + max(0.0, ways))


class Chaid:
    """A fitted tree; adds ``$CH-target`` and ``$CHC-target``, the share of the class in the node."""

    def __init__(
        self, train: DataFrame, target: str, inputs: list[str], max_depth: int = 3, min_parent: int = 30, min_child: int = 10,
        alpha_split: float = 0.05, alpha_merge: float = 0.05, bins: int = 10, most: int | None = None,
    ):
        inputs = list(dict.fromkeys(inputs))
        t = as_text(train, target)
        # Kept: each field's cuts and values are passes of their own, and must not make the training rows again.
        rows = kept(train.where(t.isNotNull()).select(*cols(dict.fromkeys([target, *inputs]))))
        self.target, self.inputs = target, inputs
        self.ordered = {f: is_number(train, f) for f in inputs}
        self.cuts: dict[str, list[float]] = {}
        self.values: dict[str, list[str]] = {}
        for f in inputs:
            if self.ordered[f]:
                self.cuts[f] = _cuts(rows, f, bins)
                continue
            common = rows.groupBy(F.coalesce(as_text(train, f), F.lit(MISSING)).alias("v")).count().orderBy(F.desc("count"), "v")
            values = [r["v"] for r in common.limit(most or MOST_CATEGORIES + 1).collect()]
            if most is None and len(values) > MOST_CATEGORIES:
                raise ValueError(f"{f} has over {MOST_CATEGORIES} categories; say how many of the commonest to tell apart.")
            self.values[f] = values
        coded = kept(self._coded(rows.withColumn("__t", t)).select("__t", "__codes"))
        found = {r["__t"]: r["count"] for r in coded.groupBy("__t").count().collect()}
        if len(found) < 2:
            raise ValueError("CHAID needs two or more classes to tell apart.")
        self.nodes: list[dict[str, Any]] = [{"depth": 0, "counts": found}]
        frontier = [0]
        for depth in range(max(1, max_depth)):
            frontier = [k for k in frontier if (n := sum(self.nodes[k]["counts"].values())) >= max(2, min_parent) and max(self.nodes[k]["counts"].values()) < n]
            if not frontier:
                break
            open_ = [k in set(frontier) for k in range(len(self.nodes))]
            at = coded.withColumn("node", self._place(F.col("__codes"))).where(F.get(F.lit(open_), F.col("node")))
            counts = at.select("node", "__t", F.posexplode("__codes").alias("f", "code")).groupBy("node", "f", "code", "__t").count()
            kinds = [(1, self._missing(f)) if self.ordered[f] else (0, -1) for f in inputs]
            merged = counts.groupBy("node", "f").applyInArrow(_merging(kinds, alpha_merge, max(1, min_child)), _MERGED)
            best: dict[int, Any] = {}
            for r in merged.where("df > 0").collect():  # a row for each open node and field
                old = best.get(r["node"])
                if old is None or (r["log_p"], -r["chi2"], r["f"]) < (old["log_p"], -old["chi2"], old["f"]):
                    best[r["node"]] = r
            frontier = []
            for k, r in sorted(best.items()):
                if r["log_p"] >= math.log(alpha_split):
                    continue
                children = {}
                for codes, own in zip(r["groups"], r["counts"], strict=True):
                    children |= dict.fromkeys(codes, len(self.nodes))
                    frontier.append(len(self.nodes))
                    counted = {c: n for c, n in zip(r["classes"], own, strict=True) if n}
                    self.nodes.append({"depth": depth + 1, "counts": counted})
                self.nodes[k]["split"] = {"field": r["f"], "chi2": r["chi2"], "df": r["df"], "log_p": r["log_p"], "children": children}

    def _missing(self, f: str) -> int:
        return len(self.cuts[f]) + 1

    def _coded(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__codes``: each input's range of a number (missing: the last) or place of a text value (unknown ones: -1, or the last if only the commonest are told apart)."""
        out, codes = df, []
        for i, f in enumerate(self.inputs):
            if self.ordered[f]:
                c = known(df, f).cast("double")
                codes.append(F.when(c.isNull(), self._missing(f)).otherwise(_below(self.cuts[f], c)))
                continue
            table = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(self.values[f])], f"__v{i} string, __k{i} int")
            out = out.withColumn(f"__v{i}", F.coalesce(as_text(df, f), F.lit(MISSING))).join(F.broadcast(table), f"__v{i}", "left")  # at most MOST_CATEGORIES rows
            codes.append(F.coalesce(F.col(f"__k{i}"), F.lit(len(self.values[f]))))
        return out.select(*cols(df.columns), F.array(*[c.cast("int") for c in codes]).alias("__codes"))

    def _place(self, codes: Column) -> Column:
        """The number of the deepest node that a row of codes reaches."""
        depth = max(n["depth"] for n in self.nodes)
        if not depth:
            return F.lit(0)
        splits = [n.get("split") for n in self.nodes]
        field = F.lit([s["field"] if s else -1 for s in splits])
        child = F.lit([[s["children"].get(c, -1) for c in range(max(s["children"]) + 1)] if s else [-1] for s in splits])

        def step(k: Column, _: Column) -> Column:
            to = F.get(F.get(child, k), F.get(codes, F.get(field, k)))
            return F.when((F.get(field, k) >= 0) & (to >= 0), to).otherwise(k)

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)

    def transform(self, df: DataFrame) -> DataFrame:
        top = [max(sorted(n["counts"]), key=n["counts"].get) for n in self.nodes]
        share = [n["counts"][t] / sum(n["counts"].values()) for n, t in zip(self.nodes, top, strict=True)]
        out = self._coded(df).withColumn("__n", self._place(F.col("__codes")))
        return out.select(
            *cols(df.columns), F.get(F.lit(top), F.col("__n")).alias(f"$CH-{self.target}"), round_to(F.get(F.lit(share), F.col("__n"))).alias(f"$CHC-{self.target}"),
        )

    def importance(self) -> dict[str, float]:
        """Each input field's share of the chi-squares of the splits, the greatest first."""
        total = dict.fromkeys(self.inputs, 0.0)
        for n in self.nodes:
            if n.get("split"):
                total[self.inputs[n["split"]["field"]]] += n["split"]["chi2"]
        whole = sum(total.values()) or 1.0
        return {f: x / whole for f, x in sorted(total.items(), key=lambda x: -x[1]) if x > 0}

    def condition(self, f: str, codes: list[int]) -> str:
        """A group of codes in words."""
        if not self.ordered[f]:
            names = [self.values[f][c] if c < len(self.values[f]) else "(others)" for c in sorted(codes)]
            return f"{f} in ({', '.join(repr(n) for n in names)})"
        own = sorted(c for c in codes if c != self._missing(f))
        if not own:
            return f"{f} is missing"
        low, high = own[0], own[-1]
        parts = [f"{f} > {self.cuts[f][low - 1]:.12g}"] if low else []
        parts += [f"{f} <= {self.cuts[f][high]:.12g}"] if high < len(self.cuts[f]) else []
        told = " and ".join(parts) or f"{f} is any number"
        return f"({told} or missing)" if len(own) < len(codes) else told

    def rules(self, spark: SparkSession) -> DataFrame:
        """A row for each node: its number, depth, the conditions of the path to it, rows, prediction, confidence, chi-square, df and log p of its split."""
        rows = []

        def walk(k: int, path: list[str]) -> None:
            n, s = self.nodes[k], self.nodes[k].get("split")
            top = max(sorted(n["counts"]), key=n["counts"].get)
            size = sum(n["counts"].values())
            told = (s["chi2"], s["df"], s["log_p"]) if s else (None, None, None)
            rows.append((k, n["depth"], " and ".join(path) or "all", size, top, n["counts"][top] / size, *told, s is None))
            for child in sorted(set(s["children"].values())) if s else []:
                f = self.inputs[s["field"]]
                walk(child, [*path, self.condition(f, [c for c, x in s["children"].items() if x == child])])

        walk(0, [])
        return spark.createDataFrame(
            rows, "node int, depth int, rule string, n bigint, prediction string, confidence double, chi2 double, df int, log_p double, leaf boolean",
        )


def _below(cuts: list[float], value: Column) -> Column:
    """How many of the cuts are less than the value."""
    return F.size(F.filter(F.lit([math.inf, *cuts]), lambda x: x < value))


def _cuts(rows: DataFrame, f: str, bins: int) -> list[float]:
    """Midpoints between the values of a number of at most ``bins`` of them, else its quantiles."""
    bins = max(2, bins)
    few = sorted(r["v"] for r in rows.select(known(rows, f).cast("double").alias("v")).where("v is not null").distinct().limit(bins + 1).collect())
    if len(few) <= bins:
        return [(a + b) / 2 for a, b in zip(few, few[1:], strict=False)]
    return sorted(set(record.quantile(rows, f, *[i / bins for i in range(1, bins)])))


_MERGED = "node int, f int, groups array<array<int>>, classes array<string>, counts array<array<bigint>>, chi2 double, df int, log_p double"


def _merging(kinds: list[tuple[int, int]], alpha: float, least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, f = (k.as_py() for k in key)
        codes, classes = sorted(set(table.column("code").to_pylist())), sorted(set(table.column("__t").to_pylist()))
        counts = np.zeros((len(codes), len(classes)), np.int64)
        at = np.searchsorted(codes, table.column("code").to_numpy()), [classes.index(t) for t in table.column("__t").to_pylist()]
        np.add.at(counts, at, table.column("count").to_numpy())
        ordered, missing = kinds[f]
        lost = codes.index(missing) if ordered and missing in codes else None
        groups, chi2, df, log_p = grouping(counts, bool(ordered), lost, alpha, least)
        return pa.table({
            "node": pa.array([node], pa.int32()), "f": pa.array([f], pa.int32()),
            "groups": pa.array([[[codes[i] for i in g] for g in groups]], pa.list_(pa.list_(pa.int32()))),
            "classes": pa.array([classes], pa.list_(pa.string())),
            "counts": pa.array([[counts[g].sum(0).tolist() for g in groups]], pa.list_(pa.list_(pa.int64()))),
            "chi2": [chi2], "df": pa.array([df], pa.int32()), "log_p": [log_p],
        })

    return run
