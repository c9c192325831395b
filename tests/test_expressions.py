"""The expression language on values that are missing, no numbers, texts and booleans."""

import math

import pytest

from oreflow.functions import expressions as X
from oreflow.functions import values
from oreflow.operators import field, record

ROWS = [(1.5, " 12 ", True), (None, None, None), (-2.5, "x", False), (float("nan"), "", True), (0.0, "1e3", False), (7.0, "😀é", True)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, n double, s string, b boolean").orderBy("i")


def _all(df, build):
    out = field.derive(df, "out", build(X.fields(df))).orderBy("i").select("out").collect()
    return [r[0] for r in out]


CASES = [
    ("sum", lambda v: v["n"] + v["s"], ["1.5 12 ", "nullnull", "-2.5x", "NaN", "01e3", "7😀é"]),
    ("less", lambda v: v["n"] - v["s"], [-10.5, 0.0, None, None, -1000.0, None]),
    ("spelled", lambda v: X.number(v["s"]), [12.0, None, None, None, 1000.0, None]),
    ("of booleans", lambda v: v["b"] + 1, [2.0, 1.0, 1.0, 2.0, 1.0, 2.0]),
    ("below", lambda v: v["n"] < 1, ["F", "T", "T", "F", "T", "F"]),
    ("equal", lambda v: v["s"] == 12, ["T", "F", "F", "F", "F", "F"]),
    ("not equal", lambda v: v["n"] != 7, ["T", "T", "T", "T", "T", "F"]),
    ("true", lambda v: v["n"] & v["s"], ["T", "F", "T", "F", "F", "T"]),
    ("either", lambda v: v["n"] | v["b"], ["T", "F", "T", "T", "F", "T"]),
    ("not", lambda v: ~v["n"], ["F", "T", "F", "T", "T", "F"]),
    ("by zero", lambda v: 1 / v["n"], [1 / 1.5, None, -0.4, None, None, 1 / 7]),
    ("remainder", lambda v: v["n"] % 2, [1.5, 0.0, -0.5, None, 0.0, 1.0]),
    ("round", lambda v: X.rounded(v["n"]), [2.0, 0.0, -2.0, None, 0.0, 7.0]),
    ("floor", lambda v: X.floor(v["n"]), [1.0, 0.0, -3.0, None, 0.0, 7.0]),
    ("ceil", lambda v: X.ceil(v["n"]), [2.0, 0.0, -2.0, None, 0.0, 7.0]),
    ("root", lambda v: X.sqrt(v["n"]), [math.sqrt(1.5), 0.0, None, None, 0.0, math.sqrt(7)]),
    ("log", lambda v: X.log(v["n"]), [math.log(1.5), None, None, None, None, math.log(7)]),
    ("least", lambda v: X.least(v["n"], 1, v["s"]), [1.0, 0.0, None, None, 0.0, None]),
    ("greatest", lambda v: X.greatest(v["n"], 1), [1.5, 1.0, 1.0, None, 1.0, 7.0]),
    ("missing", lambda v: X.is_missing(v["n"]), ["F", "T", "F", "T", "F", "F"]),
    ("missing text", lambda v: X.is_missing(v["s"]), ["F", "T", "F", "T", "F", "F"]),
    ("upper", lambda v: X.upper(v["s"]), [" 12 ", "NULL", "X", None, "1E3", "😀É"]),
    ("trim", lambda v: X.trim(v["s"]), ["12", "null", "x", None, "1e3", "😀é"]),
    ("len", lambda v: X.length(v["s"]), [4.0, 4.0, 1.0, 0.0, 3.0, 3.0]),
    ("contains", lambda v: X.contains(v["s"], "1"), ["T", "F", "F", "F", "T", "F"]),
    ("text", lambda v: X.text(v["n"]), ["1.5", None, "-2.5", None, "0", "7"]),
    ("choice", lambda v: X.choose(v["n"] > 1, v["n"], v["s"]), ["1.5", None, "x", None, "1e3", "7"]),
]


@pytest.mark.parametrize("name,build,want", CASES, ids=[c[0] for c in CASES])
def test_values(df, name, build, want):
    got = _all(df, build)
    assert [g is None for g in got] == [w is None for w in want], got
    assert all(math.isclose(g, w) if isinstance(w, float) else g == w for g, w in zip(got, want, strict=True) if w is not None), got


def test_select_by_value(df):
    v = X.fields(df)
    assert [r["i"] for r in record.select(df, v["n"] > 1).collect()] == [0, 5]
    assert [r["i"] for r in record.select(df, v["n"] > 1, keep=False).collect()] == [1, 2, 3, 4]


def test_number_text(spark):
    cases = {
        5.0: "5", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e300: "1.5e+300", 1e-5: "0.00001", 1.25e-6: "0.00000125", 1e-7: "1e-7",
        -1.5e-7: "-1.5e-7", 0.001: "0.001", 12345678.5: "12345678.5", -0.00025: "-0.00025", 0.1: "0.1",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x double").select(values.number_text(X.F.col("x"))).collect()
    assert [r[0] for r in rows] == list(cases.values())
