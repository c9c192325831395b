"""Field operators: drop and rename, type, fill, clean, derive, bin, partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.functions import rng
from oreflow.functions.expressions import Value
from oreflow.functions.values import WIDE_SPACE, as_number, as_text, col, is_number, known, round_to, set_field
from oreflow.operators import record


def drop_rename(df: DataFrame, drop: list[str], rename: dict[str, str]) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(rename)


def retype(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """``number`` or ``string`` for the named fields; every field's missing values become NULL."""
    out = []
    for c in df.columns:
        want = types.get(c)
        if want == "number" and not is_number(df, c):
            out.append(as_number(col(c)).alias(c))
        elif want == "string":
            out.append(as_text(df, c).alias(c))
        else:
            out.append(known(df, c).alias(c))
    return df.select(*out)


def fill(df: DataFrame, fields: list[str], method: str, constant: str = "0", keys: list[str] | None = None) -> DataFrame:
    """Missing values by mean, median (numbers), mode (text, or all), a constant, or their rows removed.  Statistics use all rows."""
    if method == "remove":
        test = F.lit(True)
        for c in fields:
            test = test & known(df, c).isNotNull()
        return df.where(test)
    stats = [c for c in fields if is_number(df, c) and method in ("mean", "median")]
    found: dict = {}
    if stats:
        rows = {c: df.agg(F.avg(known(df, c)).alias("q0")) if method == "mean" else record.quantiles(df, [], c, [0.5]) for c in stats}
        found = {c: row[0] if (row := r.select(round_to(F.col("q0"))).first()) else None for c, r in rows.items()}
    out = []
    for c in df.columns:
        if c not in fields:
            out.append(col(c))
            continue
        kind = dict(df.dtypes)[c]
        if c in found:
            value = F.lit(found[c])
            out.append(F.coalesce(known(df, c).cast("double"), value).alias(c))
            continue
        if method == "constant":
            value = F.lit(constant)
            if is_number(df, c):
                try:
                    value, kind = F.lit(float(constant)), "double"
                except ValueError:  # a number field with a text constant becomes text
                    out.append(F.coalesce(as_text(df, c), F.lit(constant)).alias(c))
                    continue
            out.append(F.coalesce(known(df, c).cast(kind), value).alias(c))
        else:
            top = record.mode(df, c, keys or [c]).first()
            out.append(F.coalesce(known(df, c), F.lit(top["value"] if top else None).cast(kind)).alias(c))
    return df.select(*out)


def clean_text(df: DataFrame, fields: list[str], trim: bool = True, case: str = "title", blank: bool = True) -> DataFrame:
    """Trim and collapse white space, change case, blank text to NULL.

    Title case: a capital at the start and after white space, - _ and /.
    """
    out = []
    for name in df.columns:
        c: Column = col(name)
        if name in fields:
            if trim:
                c = F.regexp_replace(F.regexp_replace(c, WIDE_SPACE, " "), "^ | $", "")
            if case == "lower":
                c = F.lower(c)
            elif case == "upper":
                c = F.upper(c)
            elif case == "title":
                # Split behind each separator, capitalise, and put together again.
                c = F.array_join(
                    F.transform(F.split(F.lower(c), r"(?<=[\s\-_/])"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))),
                    "",
                )
            if blank:
                c = F.when(F.regexp_replace(c, WIDE_SPACE, "") != "", c)
        out.append(c.alias(name))
    return df.select(*out)


def derive(df: DataFrame, name: str, expression: Value | Column | str) -> DataFrame:
    """A new last field from a value of the expression language, a Column or a Spark SQL expression; booleans become T and F, non-finite numbers NULL."""
    value = F.expr(expression) if isinstance(expression, str) else expression.column if isinstance(expression, Value) else expression
    out = set_field(df, name, value)
    kind = dict(out.dtypes)[name]
    if kind == "boolean":
        return out.withColumn(name, F.when(col(name), "T").when(~col(name), "F"))
    return out.withColumn(name, known(out, name))


def bin_edges(df: DataFrame, field: str, bins: int, method: str) -> list[float]:
    k, c = max(2, round(bins)), known(df, field).cast("double")
    if method == "width":
        lo, hi = df.agg(F.min(c), F.max(c)).first()
        raw = [] if lo is None else [lo + (hi - lo) * i / k for i in range(1, k)]
    else:
        raw = record.quantile(df, field, *[i / k for i in range(1, k)])
    return sorted({math.floor(x * 1e4 + 0.5) / 1e4 for x in raw})


def binning(df: DataFrame, field: str, bins: int = 4, method: str = "width", new_name: str = "") -> DataFrame:
    """The bin (from 1) as ``n: range``; equal widths or equal counts; missing values stay missing."""
    edges = bin_edges(df, field, bins, method)
    if not edges:
        raise ValueError("No numeric values to bin.")
    c = known(df, field).cast("double")
    show = lambda x: f"{x:.0f}" if x == int(x) else f"{x:.4g}" if abs(x) < 1 else f"{x:.3f}".rstrip("0").rstrip(".") if abs(x) < 1000 else f"{x:.1f}"
    labels = [
        f"1: < {show(edges[0])}", *[f"{i + 2}: {show(a)} – {show(b)}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))],
        f"{len(edges) + 1}: ≥ {show(edges[-1])}",
    ]
    place = sum(((c >= e).cast("int") for e in edges), F.lit(0))
    return set_field(df, new_name or f"{field}_BIN", F.when(c.isNotNull(), F.get(F.array(*[F.lit(x) for x in labels]), place)))


def partition(df: DataFrame, keys: list[str], train: float = 70, seed: int = 1234, name: str = "Partition") -> DataFrame:
    """``1_Training`` or ``2_Testing`` by each row's own draw in the order of ``keys``."""
    p = record.positions(df, keys)
    return set_field(p, name, F.when(rng.uniform(seed, F.col("__pos")) * 100 < train, "1_Training").otherwise("2_Testing")).drop("__pos")
