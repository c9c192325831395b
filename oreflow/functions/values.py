"""Values: what is missing, how numbers become text, labels and rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space in the wide sense, for trimming and collapsing.
WIDE_SPACE = r"[\s ﻿  -     　]+"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(name: str) -> Column:
    """The column of exactly that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(c) for c in names]


def is_number(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(df.dtypes)[name].startswith("decimal")


def known(df: DataFrame, name: str) -> Column:
    """The value, or NULL where it counts as missing: null, empty text, NaN, an infinity."""
    c = col(name)
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    if dict(df.dtypes)[name] == "string":
        return F.nullif(c, F.lit(""))
    return c


def number_text(c: Column) -> Column:
    """5 for 5.0, else the shortest digits that give the number: plain from a millionth up to 1e21, beyond with an exponent as in 1e-7 or 1.5e+21."""
    plain = F.regexp_replace(c.cast("decimal(38,22)").cast("string"), "0+$", "")
    wide = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-", "e-")
    whole = F.when((c % 1.0 == 0) & (F.abs(c) < 1e21), c.cast("decimal(38,0)").cast("string"))
    return whole.when((F.abs(c) >= 1e-6) & (F.abs(c) < 1e16), plain).otherwise(wide)


def as_text(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] in ("int", "bigint", "smallint", "tinyint"):
        return col(name).cast("string")
    return number_text(known(df, name).cast("double")) if is_number(df, name) else known(df, name).cast("string")


def as_number(c: Column) -> Column:
    """Text to a double: dollar signs, commas, per cent signs and white space are dropped; other text is NULL.

    Text of such signs alone is 0; NaN, infinities and suffixed numbers are no numbers.
    """
    bare = F.regexp_replace(c, r"[$,%\s]", "")
    return F.when(F.trim(c) == "", None).when(bare == "", 0.0).when(bare.rlike(_NUMBER), bare.try_cast("double"))


def looks_numeric(c: Column) -> Column:
    return F.trim(c).rlike(_NUMBER)


def round_to(c: Column, digits: int = 4) -> Column:
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def set_field(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the field last, in place of one of that name."""
    return df.withColumn("__new", value).drop(name).withColumnRenamed("__new", name)
