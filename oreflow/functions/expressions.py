"""Values of the expression language as Columns: its arithmetic, comparisons and functions, with its rules for missing values.

``fields(df)`` gives each field as a :class:`Value` of a kind; operators and
the functions here lower to Columns, which stay inside generated code.  In
arithmetic and comparisons by size a missing value counts as 0, a text as the
number it spells (else no number), and a boolean as 0 or 1; ``+`` with a text
on either side joins the text forms, in which a missing value is ``null``.
"No number" passes no comparison, and :func:`oreflow.operators.field.derive`
makes it NULL, as it does infinities.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.functions.values import col, is_number, number_text

_SPELLED = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_EDGES = r"^[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+$"
NAN = float("nan")


@dataclass(frozen=True, eq=False)
class Value:
    column: Column
    kind: str  # number, text or boolean

    def __add__(self, other):
        a, b = self, value(other)
        if "text" in (a.kind, b.kind):
            return Value(F.concat(said(a), said(b)), "text")
        return Value(as_size(a) + as_size(b), "number")

    def __radd__(self, other):
        return value(other) + self

    def __sub__(self, other):
        return Value(as_size(self) - as_size(value(other)), "number")

    def __rsub__(self, other):
        return value(other) - self

    def __mul__(self, other):
        return Value(as_size(self) * as_size(value(other)), "number")

    __rmul__ = __mul__

    def __truediv__(self, other):
        a, b = as_size(self), as_size(value(other))
        by_zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, float("inf")).otherwise(float("-inf"))
        return Value(F.when(b == 0, by_zero).otherwise(F.try_divide(a, b)), "number")

    def __rtruediv__(self, other):
        return value(other) / self

    def __mod__(self, other):
        a, b = as_size(self), as_size(value(other))
        return Value(F.when((b == 0) | F.isnan(a), NAN).otherwise(F.try_mod(a, b)), "number")

    def __neg__(self):
        return Value(-as_size(self), "number")

    def __lt__(self, other):
        return _compared(self, value(other), lambda a, b: a < b)

    def __le__(self, other):
        return _compared(self, value(other), lambda a, b: a <= b)

    def __gt__(self, other):
        return _compared(self, value(other), lambda a, b: a > b)

    def __ge__(self, other):
        return _compared(self, value(other), lambda a, b: a >= b)

    def __eq__(self, other):
        """Equal values, numbers and texts by size; a missing value equals a missing one only."""
        a, b = self, value(other)
        if a.kind == b.kind == "text":
            same = a.column == b.column
        else:
            x, y = as_size(a), as_size(b)
            same = (x == y) & ~F.isnan(x) & ~F.isnan(y)
        missing = a.column.isNull() | b.column.isNull()
        return Value(F.when(missing, a.column.isNull() & b.column.isNull()).otherwise(same), "boolean")

    def __ne__(self, other):
        return ~(self == other)

    def __and__(self, other):
        return Value(truth(self) & truth(value(other)), "boolean")

    def __or__(self, other):
        return Value(truth(self) | truth(value(other)), "boolean")

    def __invert__(self):
        return Value(~truth(self), "boolean")


def value(x) -> Value:
    """A constant, or a value itself."""
    if isinstance(x, Value):
        return x
    if x is None:
        return Value(F.lit(None).cast("double"), "number")
    kind = "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "text"
    return Value(F.lit(float(x) if kind == "number" else x), kind)


def fields(df: DataFrame) -> dict[str, Value]:
    """The fields of ``df`` by name."""
    kinds = dict(df.dtypes)
    number = lambda c: col(c).cast("double")
    return {c: Value(number(c), "number") if is_number(df, c) else Value(col(c), "boolean") if kinds[c] == "boolean" else Value(col(c).cast("string"), "text") for c in df.columns}


def as_size(v: Value) -> Column:
    """The number that arithmetic sees."""
    if v.kind == "boolean":
        return F.coalesce(v.column.cast("int"), F.lit(0)).cast("double")
    if v.kind == "number":
        return F.coalesce(v.column, F.lit(0.0))
    bare = F.regexp_replace(F.coalesce(v.column, F.lit("")), _EDGES, "")
    return F.when(bare == "", 0.0).when(bare.rlike(_SPELLED), bare.try_cast("double")).otherwise(NAN)


def said(v: Value) -> Column:
    """The text form, in which a missing value is ``null``."""
    if v.kind == "text":
        own = v.column
    elif v.kind == "boolean":
        own = F.when(v.column, "true").otherwise("false")
    else:
        own = F.when(F.isnan(v.column), "NaN").otherwise(number_text(v.column))
    return F.when(v.column.isNull(), "null").otherwise(own)


def truth(v: Value) -> Column:
    """Whether a value counts as true: neither missing, nor 0, no number, or an empty text."""
    if v.kind == "boolean":
        return F.coalesce(v.column, F.lit(False))
    if v.kind == "number":
        return F.coalesce((v.column != 0) & ~F.isnan(v.column), F.lit(False))
    return F.coalesce(v.column != "", F.lit(False))


def _compared(a: Value, b: Value, test) -> Value:
    x, y = as_size(a), as_size(b)
    sized = test(x, y) & ~F.isnan(x) & ~F.isnan(y)
    if a.kind == b.kind == "text":
        sized = F.when(a.column.isNotNull() & b.column.isNotNull(), test(a.column, b.column)).otherwise(sized)
    return Value(sized, "boolean")


def choose(test: Value, then, otherwise) -> Value:
    """``test ? then : otherwise``; of two kinds, both become text."""
    a, b = value(then), value(otherwise)
    if a.kind != b.kind:
        a, b = (Value(F.when(x.column.isNotNull(), said(x)), "text") for x in (a, b))
    return Value(F.when(truth(test), a.column).otherwise(b.column), a.kind)


def _number(f):
    return lambda v: Value(f(as_size(value(v))), "number")


absolute = _number(F.abs)
sqrt = _number(lambda x: F.when(x < 0, NAN).otherwise(F.sqrt(x)))
log = _number(lambda x: F.when(x < 0, NAN).when(x == 0, float("-inf")).otherwise(F.log(x)))
log10 = _number(lambda x: F.when(x < 0, NAN).when(x == 0, float("-inf")).otherwise(F.log10(x)))
exp = _number(F.exp)
#: Halves go up, also below zero.
rounded = _number(lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x + 0.5).cast("double")))
floor = _number(lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x).cast("double")))
ceil = _number(lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.ceil(x).cast("double")))


def power(a, b) -> Value:
    return Value(F.pow(as_size(value(a)), as_size(value(b))), "number")


def _extreme(pick):
    def of(*values) -> Value:
        sizes = [as_size(value(v)) for v in values]
        bad = sum((F.isnan(x).cast("int") for x in sizes), F.lit(0)) > 0
        return Value(F.when(bad, NAN).otherwise(pick(*sizes) if len(sizes) > 1 else sizes[0]), "number")

    return of


#: Of any number of values, missing ones as 0; none if one is no number.
least, greatest = _extreme(F.least), _extreme(F.greatest)


def is_missing(v) -> Value:
    v = value(v)
    if v.kind == "number":
        return Value(v.column.isNull() | F.isnan(v.column) | (F.abs(v.column) == float("inf")), "boolean")
    return Value(v.column.isNull() | (v.column == "") if v.kind == "text" else v.column.isNull(), "boolean")


def upper(v) -> Value:
    return Value(F.upper(said(value(v))), "text")


def lower(v) -> Value:
    return Value(F.lower(said(value(v))), "text")


def trim(v) -> Value:
    return Value(F.regexp_replace(said(value(v)), _EDGES, ""), "text")


def length(v) -> Value:
    """In UTF-16 units: signs beyond the basic plane count twice."""
    return Value((F.octet_length(F.encode(said(value(v)), "UTF-16BE")) / 2).cast("double"), "number")


def contains(v, part) -> Value:
    """With upper and lower case told apart."""
    return Value(said(value(v)).contains(said(value(part))), "boolean")


def number(v) -> Value:
    """The number that a value spells; a missing one stays missing."""
    v = value(v)
    return Value(F.when(~is_missing(v).column, as_size(v)), "number")


def text(v) -> Value:
    """The text form; a missing value stays missing."""
    v = value(v)
    return Value(F.when(~is_missing(v).column, said(v)), "text")
