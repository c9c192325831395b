"""All queries of the engine's own operators, each with the SQL that must agree."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.functions import expressions as X
from oreflow.functions.values import round_to
from oreflow.operators import field, models, record, report
from oreflow.plans import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
#: The generator's draw at position i, in DuckDB.
_TIMES = "((({})::HUGEINT * ({})::HUGEINT) % 4294967296)::BIGINT"


def draw_sql(seed: int, rows: str) -> str:
    """SQL that adds ``u`` to ``rows``, a query with ``i``, by the generator's four steps."""
    t = _TIMES.format("xor(a, a >> 15)", "a | 1")
    v = _TIMES.format("xor(t, t >> 7)", "t | 61")
    return f"(SELECT *, xor(w, w >> 14) / 4294967296.0 AS u FROM (SELECT *, xor((t + {v}) & 4294967295, t) AS w FROM (SELECT *, {t} AS t FROM (SELECT *, (({seed} + (i + 1)::HUGEINT * 1831565813) % 4294967296)::BIGINT AS a FROM ({rows})))))"


def query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r4(x: str) -> str:
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: round_to(F.col(n)) for n in names})


# -- selection, projection ------------------------------------------------------------


@query(f"""SELECT l_returnflag, l_linestatus, {r4('sum(revenue)')} AS revenue_Sum, {r4('avg(revenue)')} AS revenue_Mean, {r4('min(revenue)')} AS revenue_Min, {r4('max(revenue)')} AS revenue_Max, {r4('stddev_samp(revenue)')} AS revenue_SDev, count(*) AS Record_Count
FROM (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity <= 45) GROUP BY ALL""")
def pricing_summary(t):
    rows = field.derive(
        record.select(t("lineitem"), record.condition(t("lineitem"), "l_quantity", "<=", "45")), "revenue",
        "l_extendedprice * (1 - l_discount)",
    )
    out = record.aggregate(rows, ["l_returnflag", "l_linestatus"], ["revenue"], ["Sum", "Mean", "Min", "Max", "SDev"])
    return _r(record.sort(out, "l_returnflag", keys=["l_linestatus"]), *[f"revenue_{f}" for f in ("Sum", "Mean", "Min", "Max", "SDev")])


for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("gt", ">", ">"), ("ge", ">=", ">="), ("lt", "<", "<"), ("le", "<=", "<=")):

    def _select(t, op=_op):
        return record.select(t("part"), record.condition(t("part"), "p_size", op, "25")).select("p_partkey", "p_size")

    _select.__name__ = f"select_{_name}"
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {_sql} 25")(_select)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) LIKE '%hi%'")
def select_contains(t):
    return record.select(t("orders"), record.condition(t("orders"), "o_orderpriority", "contains", "HI")).select("o_orderkey", "o_orderpriority")


def _labelled(t):
    return t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"SELECT doc_id FROM {_LABELLED} WHERE quality IS NULL")
def select_missing(t):
    return record.select(_labelled(t), record.condition(_labelled(t), "quality", "is missing")).select("doc_id")


@query(f"SELECT doc_id, quality FROM {_LABELLED} WHERE NOT coalesce(quality > 0, false)")
def select_discard_keeps_missing(t):
    d = _labelled(t)
    return record.select(d, record.condition(d, "quality", ">", "0"), keep=False).select("doc_id", "quality")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_tax < 0.04 OR l_quantity = 1")
def select_expression(t):
    return record.select(t("lineitem"), "l_discount > 0.05 AND l_tax < 0.04 OR l_quantity = 1").select(*LINE)


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r4('sqrt(l_extendedprice) + ln(l_quantity) * 2')} AS score FROM lineitem")
def derive_arithmetic(t):
    return _r(field.derive(t("lineitem"), "score", "sqrt(l_extendedprice) + ln(l_quantity) * 2").select(*LINE, "score"), "score")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'T' ELSE 'F' END AS big FROM part")
def derive_boolean(t):
    return field.derive(t("part"), "big", "p_size > 25").select("p_partkey", "big")


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS p_type, length(p_name) AS n, upper(p_brand) AS brand FROM part")
def derive_text(t):
    out = field.derive(t("part"), "p_type", F.when(F.col("p_size") > 40, "large").when(F.col("p_size") > 10, "medium").otherwise("small"))
    return out.select("p_partkey", "p_type", F.length("p_name").cast("bigint").alias("n"), F.upper("p_brand").alias("brand"))


_Q = "coalesce(quality, 0)::DOUBLE"


def _to4(x):
    return X.rounded(x * 10000.0) / 10000.0


#: The expression language: a value built from the fields, and its SQL over documents with their labels.
EXPRESSIONS = {
    "missing_plus": (lambda v: v["quality"] + 1, f"{_Q} + 1"),
    "missing_below": (lambda v: v["quality"] < 1, f"CASE WHEN {_Q} < 1 THEN 'T' ELSE 'F' END"),
    "missing_equals": (lambda v: v["quality"] == 0, "CASE WHEN quality = 0 THEN 'T' ELSE 'F' END"),
    "plus_text": (lambda v: v["lang"] + "-" + v["quality"], "coalesce(lang, 'null') || '-' || coalesce(quality::VARCHAR, 'null')"),
    "and_or": (
        lambda v: (v["quality"] & (v["n_chars"] > 500)) | v["toxic"],
        f"CASE WHEN ({_Q} <> 0 AND n_chars > 500) OR coalesce(toxic, 0) <> 0 THEN 'T' ELSE 'F' END",
    ),
    "choose": (lambda v: X.choose(v["quality"] == None, "none", v["quality"] * 2), "CASE WHEN quality IS NULL THEN 'none' ELSE (quality * 2)::VARCHAR END"),  # noqa: E711
    "divide_by_zero": (lambda v: v["n_chars"] / v["quality"], "CASE WHEN quality <> 0 THEN n_chars / quality::DOUBLE END"),
    "remainder": (lambda v: (v["quality"] - v["n_chars"]) % 7 + 0, f"({_Q} - n_chars) - 7 * trunc(({_Q} - n_chars) / 7) + 0"),
    "abs": (lambda v: X.absolute(v["quality"] - 3), f"abs({_Q} - 3)"),
    "sqrt": (lambda v: _to4(X.sqrt(v["quality"] - 0.5)), f"CASE WHEN {_Q} >= 0.5 THEN {r4(f'sqrt(greatest({_Q} - 0.5, 0))')} END"),
    "log": (lambda v: _to4(X.log(v["n_chars"] * v["quality"])), f"CASE WHEN n_chars * {_Q} > 0 THEN {r4('ln(greatest(n_chars, 1))')} END"),
    "log10": (lambda v: _to4(X.log10(v["n_chars"] - 100)), f"CASE WHEN n_chars > 100 THEN {r4('log10(greatest(n_chars - 100, 1))')} END"),
    "exp": (lambda v: _to4(X.exp(v["quality"])), r4(f"exp({_Q})")),
    "round": (lambda v: X.rounded(v["quality"] - 2.5), f"floor({_Q} - 2.5 + 0.5)"),
    "floor": (lambda v: X.floor(v["n_chars"] / -7), "floor(n_chars / -7.0)"),
    "ceil": (lambda v: X.ceil(v["n_chars"] / -7), "ceil(n_chars / -7.0) + 0"),
    "min": (lambda v: X.least(v["quality"], 0.5, v["toxic"]), f"least({_Q}, 0.5, coalesce(toxic, 0))"),
    "max": (lambda v: X.greatest(v["quality"], 0.5, v["toxic"]), f"greatest({_Q}, 0.5, coalesce(toxic, 0))"),
    "pow": (lambda v: X.power(v["n_chars"], 2), "n_chars::DOUBLE * n_chars"),
    "is_missing": (lambda v: X.is_missing(v["quality"]), "CASE WHEN quality IS NULL THEN 'T' ELSE 'F' END"),
    "upper": (lambda v: X.upper(v["lang"] + v["quality"]), "upper(coalesce(lang, 'null') || coalesce(quality::VARCHAR, 'null'))"),
    "lower": (lambda v: X.lower(X.upper(v["lang"])), "lower(coalesce(lang, 'null'))"),
    "trim": (lambda v: X.trim("  " + v["lang"] + " x "), "coalesce(lang, 'null') || ' x'"),
    "len": (lambda v: X.length(v["lang"] + v["quality"]), "length(coalesce(lang, 'null') || coalesce(quality::VARCHAR, 'null'))::DOUBLE"),
    "contains": (lambda v: X.contains(v["lang"], "n"), "CASE WHEN contains(coalesce(lang, 'null'), 'n') THEN 'T' ELSE 'F' END"),
    "number": (lambda v: X.number(X.text(v["quality"])) * 2, f"{_Q} * 2"),
    "text": (lambda v: X.text(v["quality"]), "quality::VARCHAR"),
}
for _name, (_build, _sql) in EXPRESSIONS.items():

    def _expression(t, build=_build):
        rows = _labelled(t)
        return field.derive(rows, "value", build(X.fields(rows))).select("doc_id", "value")

    _expression.__name__ = f"expr_{_name}"
    query(f"SELECT doc_id, {_sql} AS value FROM {_LABELLED}")(_expression)


@query(f"SELECT doc_id FROM {_LABELLED} WHERE NOT ({_Q} < 1 AND n_chars > 300)")
def select_value_discard(t):
    rows = _labelled(t)
    v = X.fields(rows)
    return record.select(rows, (v["quality"] < 1) & (v["n_chars"] > 300), keep=False).select("doc_id")


@query("SELECT c_custkey AS id, c_name AS customer, c_mktsegment FROM customer")
def filter_drop_rename(t):
    return field.drop_rename(t("customer"), ["c_nationkey", "c_acctbal"], {"c_custkey": "id", "c_name": "customer"})


@query("SELECT p_partkey, p_size + 0.5 AS price FROM part")
def type_to_number(t):
    rows = t("part").select(
        "p_partkey", F.concat(F.lit("$1"), F.lit(","), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".50 ")).alias("price"),
    )
    return field.retype(rows, {"price": "number"}).select("p_partkey", (F.col("price") - 1000).alias("price"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def type_to_string(t):
    return field.retype(t("orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey")), {"o_custkey": "string"})


_HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders)"


def _holes(t):
    return t("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("priority"),
    )


@query(f"SELECT o_orderkey, coalesce(price, (SELECT {r4('avg(price)')} FROM {_HOLES})) AS price FROM {_HOLES}")
def fill_mean(t):
    return field.fill(_holes(t), ["price"], "mean").select("o_orderkey", "price")


@query(f"SELECT o_orderkey, coalesce(price, (SELECT {r4('median(price)')} FROM {_HOLES})) AS price FROM {_HOLES}")
def fill_median(t):
    return field.fill(_holes(t), ["price"], "median").select("o_orderkey", "price")


@query(f"SELECT o_orderkey, coalesce(nullif(priority, ''), (SELECT priority FROM {_HOLES} WHERE priority <> '' GROUP BY priority ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)) AS priority FROM {_HOLES}")
def fill_mode(t):
    return field.fill(_holes(t), ["priority"], "mode", keys=["o_orderkey"]).select("o_orderkey", "priority")


@query(f"SELECT o_orderkey, coalesce(price, 0.0) AS price FROM {_HOLES}")
def fill_constant(t):
    return field.fill(_holes(t), ["price"], "constant", "0").select("o_orderkey", "price")


@query(f"SELECT o_orderkey FROM {_HOLES} WHERE price IS NOT NULL AND priority <> ''")
def fill_remove(t):
    return field.fill(_holes(t), ["price", "priority"], "remove").select("o_orderkey")


def _dirty(t):
    return t("part").select("p_partkey", F.concat(F.lit("  "), F.lower("p_name"), F.lit("   X "), F.col("p_brand"), F.lit(" ")).alias("s"))


_DIRTY = "trim(regexp_replace('  ' || lower(p_name) || '   X ' || p_brand || ' ', '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, lower({_DIRTY}) AS s FROM part")
def clean_text_lower(t):
    return field.clean_text(_dirty(t), ["s"], case="lower")


@query(f"SELECT p_partkey, upper({_DIRTY}) AS s FROM part")
def clean_text_upper(t):
    return field.clean_text(_dirty(t), ["s"], case="upper")


@query("SELECT o_orderkey, array_to_string(list_transform(string_split(replace(replace(lower(o_orderpriority), '-', ' - '), '  ', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS s FROM orders")
def clean_text_title(t):
    rows = t("orders").select(
        "o_orderkey",
        F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), F.upper("o_orderpriority")), "-", "  -  "), " {3,}", "  ").alias("s"),
    )
    return field.clean_text(rows, ["s"])


_EDGES = "(SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)"


@query(f"SELECT bin, count(*) AS n FROM (SELECT 1 + (l_extendedprice >= {r4('lo + (hi - lo) / 4')})::BIGINT + (l_extendedprice >= {r4('lo + (hi - lo) * 2 / 4')})::BIGINT + (l_extendedprice >= {r4('lo + (hi - lo) * 3 / 4')})::BIGINT AS bin FROM lineitem, {_EDGES}) GROUP BY bin")
def bin_width(t):
    return field.binning(t("lineitem"), "l_extendedprice", 4).groupBy(F.split("l_extendedprice_BIN", ":")[0].cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query(f"SELECT bin, count(*) AS n FROM (SELECT 1 + (o_totalprice >= {r4('a')})::BIGINT + (o_totalprice >= {r4('b')})::BIGINT AS bin FROM orders, (SELECT quantile_cont(o_totalprice, 1.0 / 3) AS a, quantile_cont(o_totalprice, 2.0 / 3) AS b FROM orders)) GROUP BY bin")
def bin_frequency(t):
    return field.binning(t("orders"), "o_totalprice", 3, "freq").groupBy(F.split("o_totalprice_BIN", ":")[0].cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


_POSITIONED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders"


@query(f"SELECT o_orderkey, CASE WHEN u * 100 < 70 THEN '1_Training' ELSE '2_Testing' END AS Partition FROM {draw_sql(1234, _POSITIONED)}")
def partition_70_30(t):
    return field.partition(t("orders").select("o_orderkey"), ["o_orderkey"])


# -- rows ---------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 250")
def sample_first(t):
    return record.sample_first(t("orders").select("o_orderkey"), 250, ["o_orderkey"])


@query(f"SELECT o_orderkey FROM ({_POSITIONED}) WHERE i % 13 = 0")
def sample_every(t):
    return record.sample_every(t("orders").select("o_orderkey"), 13, ["o_orderkey"])


@query(f"SELECT o_orderkey FROM {draw_sql(7, _POSITIONED)} WHERE u * 100 < 20")
def sample_random(t):
    return record.sample_random(t("orders").select("o_orderkey"), 20, 7, ["o_orderkey"])


@query(f"SELECT arg_max(o_orderkey, i) AS o_orderkey FROM (SELECT o_orderkey, p AS i, CASE WHEN p < 100 THEN p ELSE floor(u * (p + 1)) END AS slot FROM {draw_sql(42, 'SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, row_number() OVER (ORDER BY o_orderkey) - 101 AS i FROM orders')}) WHERE slot < 100 GROUP BY slot")
def sample_reservoir(t):
    return record.reservoir(t("orders").select("o_orderkey"), 100, 42, ["o_orderkey"])


@query(f"SELECT doc_id, quality FROM {_LABELLED} ORDER BY quality DESC NULLS LAST, doc_id")
def sort_missing_last(t):
    return record.sort(_labelled(t).select("doc_id", "quality"), "quality", False, ["doc_id"])


@query(f"SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) - 1 AS place FROM {_LABELLED}")
def sort_missing_last_all(t):
    rows = _labelled(t).select("doc_id", "quality").withColumn("__down", F.coalesce(-F.col("quality"), F.lit(1)))  # quality is 0 or 1
    return record.positions(rows, ["__down", "doc_id"], "place").drop("__down")


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def distinct_first(t):
    return record.distinct(t("lineitem").select("l_returnflag", "l_linestatus", *LINE), ["l_returnflag", "l_linestatus"], LINE)


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_all(t):
    return record.distinct(t("events").select("user_id", "event_type"), [], [])


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    def _merge(t, how=_how):
        return record.merge(t("lineitem").select(*LINE), t("supplier").select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey", how)

    _merge.__name__ = f"merge_{_how}"
    query(f"""SELECT l_orderkey, l_partkey, coalesce(l_suppkey, s_suppkey) AS l_suppkey, l_linenumber, s_nationkey
FROM lineitem {_join} supplier ON l_suppkey = s_suppkey""")(_merge)


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    def _whole(t, how=_how):
        return record.merge(
            t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey", how,
        )

    # Sizes go from 1 to 50 and nations from 0 to 24, so either side has rows without a partner.
    def _unmatched(t, how=_how):
        return record.merge(t("part").select("p_partkey", "p_size"), t("nation").select("n_nationkey", "n_name"), "p_size", "n_nationkey", how)

    _whole.__name__, _unmatched.__name__ = f"merge_whole_{_how}", f"merge_unmatched_{_how}"
    query(f"SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_mktsegment FROM orders {_join} customer ON o_custkey = c_custkey")(_whole)
    query(f"SELECT p_partkey, coalesce(p_size, n_nationkey) AS p_size, n_name FROM part {_join} nation ON p_size = n_nationkey")(_unmatched)


@query("SELECT n.n_nationkey, n.n_name, r.n_name AS n_name_2 FROM nation n JOIN (SELECT r_regionkey, r_name AS n_name FROM region) r ON n.n_regionkey = r.r_regionkey")
def merge_collision(t):
    right = t("region").withColumnRenamed("r_name", "n_name").withColumn("r_regionkey", F.col("r_regionkey").cast("string"))
    return record.merge(t("nation"), right, "n_regionkey", "r_regionkey").select("n_nationkey", "n_name", "n_name_2")


_JOINED = """(SELECT d.doc_id, d.source, l.doc_id AS other, row_number() OVER (ORDER BY d.doc_id IS NULL, d.doc_id DESC, l.doc_id) - 1 AS i
FROM (SELECT doc_id, source, doc_id % 7 AS k FROM documents WHERE doc_id % 3 > 0) d FULL JOIN (SELECT doc_id, doc_id % 11 AS k FROM labels WHERE quality = 0) l ON d.k = l.k)"""


def _joined(t):
    """Documents in descending order of ids and labels in ascending order, each with its place, and how they are joined."""
    left = t("documents").where("doc_id % 3 > 0").select("doc_id", "source", (F.col("doc_id") % 7).alias("k"), (-F.col("doc_id")).alias("at"))
    right = t("labels").where("quality = 0").select(F.col("doc_id").alias("other"), (F.col("doc_id") % 11).alias("k"), F.col("doc_id").alias("at"))
    return left, right, "k", "k"


@query(f"SELECT doc_id, other FROM {_JOINED} WHERE i % 10 = 0")
def merge_then_sample_every(t):
    """The order of rows is carried through the join, of which only the sampled rows are made."""
    return record.merge_every(*_joined(t), 10, "full", ("at", "at")).select("doc_id", "other")


@query(f"SELECT source, count(*) AS Record_Count, row_number() OVER (ORDER BY min(i)) - 1 AS seen FROM {_JOINED} GROUP BY source")
def aggregate_first_seen(t):
    """Groups in the order of their first rows; the join's rows are counted, not made."""
    return record.positions(record.merge_aggregate(*_joined(t), ["source"], "full", ("at", "at")), ["Place"], "seen").select("source", "Record_Count", "seen")


@query("""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY k, CASE k WHEN 0 THEN -id ELSE id END) - 1 AS i FROM (SELECT c_custkey AS id, 0 AS k FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier)) WHERE i % 7 = 0""")
def append_then_sample_every(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), (-F.col("c_custkey")).alias("at"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("at"))
    return record.sample_every(record.append([a, b], places=["at", "at"]), 7, ["Place"]).select("id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS bal, c_mktsegment AS seg, 'customer' AS origin FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier")
def append_tagged(t):
    a = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    b = t("supplier").select(F.col("s_name").alias("key"), F.col("s_acctbal").alias("bal"))
    return record.append([a, b], "origin", ["customer", "supplier"])


# -- aggregation ------------------------------------------------------------------------


@query(f"SELECT toxic, {r4('avg(n_chars)')} AS n_chars_Mean, sum(n_chars)::DOUBLE AS n_chars_Sum, count(*) AS Record_Count FROM {_LABELLED} GROUP BY toxic")
def aggregate_null_group(t):
    return _r(record.aggregate(_labelled(t), ["toxic"], ["n_chars"], ["Mean", "Sum"]), "n_chars_Mean")


@query("SELECT l_orderkey, l_partkey, CASE WHEN count(*) = 1 THEN 0.0 ELSE floor(stddev_samp(l_quantity) * 10000.0 + 0.5) / 10000.0 END AS l_quantity_SDev, count(*) AS Record_Count FROM lineitem GROUP BY ALL")
def aggregate_single_rows(t):
    return _r(record.aggregate(t("lineitem"), ["l_orderkey", "l_partkey"], ["l_quantity"], ["SDev"]), "l_quantity_SDev")


@query("SELECT min(o_totalprice) AS o_totalprice_Min, max(o_totalprice) AS o_totalprice_Max, count(*) AS Record_Count FROM orders")
def aggregate_all_rows(t):
    return record.aggregate(t("orders"), [], ["o_totalprice"], ["Min", "Max"])


@query(f"SELECT l_returnflag, {r4('quantile_cont(l_extendedprice, 0.25)')} AS q1, {r4('median(l_extendedprice)')} AS q2, {r4('quantile_cont(l_extendedprice, 0.75)')} AS q3 FROM lineitem GROUP BY l_returnflag")
def quantiles(t):
    found = record.quantiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])
    return _r(found.toDF("l_returnflag", "q1", "q2", "q3"), "q1", "q2", "q3")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def value_counts(t):
    return record.value_counts(t("events"), "event_type")


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, min(p_partkey) LIMIT 1")
def mode_first_seen(t):
    return record.mode(t("part"), "p_brand", ["p_partkey"])


@query("SELECT least(9, floor((o_totalprice - lo) / ((hi - lo) / 10)))::BIGINT AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def histogram(t):
    return report.histogram(t("orders"), "o_totalprice").select("bin", "n")


# -- reports -------------------------------------------------------------------------------


@query(f"SELECT 'o_totalprice' AS field, 'number' AS kind, min(o_totalprice) AS min, max(o_totalprice) AS max, {r4('avg(o_totalprice)')} AS mean, {r4('stddev_samp(o_totalprice)')} AS sdev, count(DISTINCT o_totalprice) AS distinct_values, count(o_totalprice) AS valid, count(*) - count(o_totalprice) AS missing, NULL::VARCHAR AS top FROM orders UNION ALL SELECT 'o_orderpriority', 'string', NULL, NULL, NULL, NULL, count(DISTINCT o_orderpriority), count(o_orderpriority), count(*) - count(o_orderpriority), (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_orderpriority LIMIT 1) FROM orders")
def audit(t):
    return _r(report.audit(t("orders").select("o_totalprice", "o_orderpriority")), "mean", "sdev").withColumnRenamed("distinct", "distinct_values")


@query("SELECT l_returnflag AS label, l_linestatus AS \"group\", count(*) AS n FROM lineitem GROUP BY ALL")
def distribution_overlay(t):
    return report.distribution(t("lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT l_linenumber::VARCHAR AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def distribution_whole_numbers(t):
    return report.distribution(t("lineitem"), "l_linenumber")


_SHARES = "SELECT label, n, floor(n / sum(n) OVER () * 10000.0 + 0.5) / 10000.0 AS share, {} AS missing FROM ({})"


@query(_SHARES.format(f"(SELECT count(*) - count(quality) FROM {_LABELLED})", f"SELECT quality::VARCHAR AS label, count(*) AS n FROM {_LABELLED} WHERE quality IS NOT NULL GROUP BY 1"))
def distribution_shares(t):
    rows = _labelled(t)
    return _r(report.shares(report.distribution(rows, "quality"), rows, "quality"), "share")


@query(_SHARES.format("0", "SELECT least(9, floor((o_totalprice - lo) / ((hi - lo) / 10)))::BIGINT::VARCHAR AS label, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1"))
def distribution_histogram(t):
    rows = t("orders").select("o_totalprice")
    return _r(report.shares(report.distribution(rows, "o_totalprice"), rows, "o_totalprice"), "share")


@query("SELECT 'o_totalprice' AS field, least(11, floor((o_totalprice - lo) / ((hi - lo) / 12)))::BIGINT AS place, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 2 UNION ALL SELECT 'o_orderpriority', * FROM (SELECT row_number() OVER (ORDER BY n DESC, o_orderpriority) - 1 AS place, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)) WHERE place < 12")
def audit_shapes(t):
    return report.shapes(t("orders").select("o_totalprice", "o_orderpriority"))


@query("SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS colour FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 3000")
def plot_points(t):
    return report.plot(t("lineitem"), "l_quantity", "l_extendedprice", LINE, "l_returnflag")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def table_report(t):
    return report.table(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


_GUESS = "(SELECT l_returnflag AS actual, CASE WHEN l_quantity > 34 THEN 'A' WHEN l_quantity > 17 THEN 'N' ELSE 'R' END AS predicted FROM lineitem)"


def _guess(t):
    return t("lineitem").select(
        F.col("l_returnflag").alias("actual"),
        F.when(F.col("l_quantity") > 34, "A").when(F.col("l_quantity") > 17, "N").otherwise("R").alias("predicted"),
    )


@query(f"SELECT 'All records' AS part, actual, predicted, count(*) AS n FROM {_GUESS} GROUP BY ALL")
def analysis_confusion(t):
    return report.confusion(_guess(t), "actual", "predicted")


@query(f"SELECT 'All records' AS part, c AS class, {r4('sum((actual = c AND predicted = c)::INT)::DOUBLE / sum((predicted = c)::INT)')} AS precision, {r4('sum((actual = c AND predicted = c)::INT)::DOUBLE / sum((actual = c)::INT)')} AS recall, {r4('avg((actual = predicted)::INT)')} AS accuracy FROM {_GUESS}, (SELECT DISTINCT actual AS c FROM {_GUESS}) GROUP BY c")
def analysis_classes(t):
    return _r(report.class_metrics(_guess(t), "actual", "predicted"), "precision", "recall", "accuracy")


@query(f"SELECT 'All records' AS part, {r4('avg(abs(y - p))')} AS mae, {r4('sqrt(avg((y - p) * (y - p)))')} AS rmse, {r4('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2, {r4('avg(y - p)')} AS bias FROM (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)")
def analysis_regression(t):
    return _r(
        report.regression_metrics(t("lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p")), "y", "p"),
        "mae", "rmse", "r2", "bias",
    )


# -- models ---------------------------------------------------------------------------------


@query(f"SELECT c_custkey, {r4('(c_acctbal - m) / s')} AS bal, (c_mktsegment = (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))::INT::DOUBLE AS seg FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
def encode_features(t):
    c = t("customer")
    f = list(models.encode(c, ["c_acctbal", "c_mktsegment"]).values())
    return c.select("c_custkey", round_to(f[0]).alias("bal"), f[1].alias("seg"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((i + s * l_quantity) / 10) AS predicted FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)")
def linear_predict(t):
    m = models.linear(t("lineitem"), "l_extendedprice", ["l_quantity"])
    return m.transform(t("lineitem")).select(*LINE, F.round(F.col("`$E-l_extendedprice`") / 10).alias("predicted"))


@query("""WITH c AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS m, greatest(stddev_samp(l_quantity), 0.001 * (abs(avg(l_quantity)) + 1)) AS s FROM lineitem GROUP BY 1),
v AS (SELECT l_returnflag AS k, l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT count(DISTINCT l_linestatus) AS d FROM lineitem),
s AS (SELECT l.*, c.k, ln(c.n::DOUBLE / (SELECT sum(n) FROM c)) - ln(c.s) - (l.l_quantity - c.m) * (l.l_quantity - c.m) / (2 * c.s * c.s) + ln((coalesce(v.n, 0) + 1.0) / (c.n + d.d + 1)) AS score FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) l CROSS JOIN c CROSS JOIN d LEFT JOIN v ON v.k = c.k AND v.v = l.l_linestatus)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, k AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, k) AS r FROM s) WHERE r = 1""")
def naive_bayes_predict(t):
    m = models.NaiveBayes(t("lineitem"), "l_returnflag", ["l_quantity", "l_linestatus"])
    return m.transform(t("lineitem")).select(*LINE, F.col("`$B-l_returnflag`").alias("predicted"))


@query(f"SELECT o_orderkey, {r4('d / m')} AS idx, CASE WHEN d > q THEN 'anomaly' ELSE 'normal' END AS flag FROM (SELECT o_orderkey, abs(o_totalprice - a) / s AS d FROM orders, (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS s FROM orders)), (SELECT avg(abs(o_totalprice - a) / s) AS m, quantile_cont(abs(o_totalprice - a) / s, 0.95) AS q FROM orders, (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS s FROM orders))")
def kmeans_single(t):
    o = t("orders")
    out = models.single_cluster(o, models.encode(o, ["o_totalprice"]))
    return out.select("o_orderkey", round_to(F.col("`$KMI-K-Means`")).alias("idx"), F.col("`$KMA-K-Means`").alias("flag"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN least(abs(l_quantity - 5), abs(l_quantity - 25), abs(l_quantity - 45)) = abs(l_quantity - 5) THEN 'cluster-1' WHEN abs(l_quantity - 25) <= abs(l_quantity - 45) THEN 'cluster-2' ELSE 'cluster-3' END AS cluster FROM lineitem")
def kmeans_assign(t):
    return models.assign(t("lineitem"), F.array("l_quantity"), [[5.0], [25.0], [45.0]]).select(*LINE, F.col("`$KM-K-Means`").alias("cluster"))


@query()
def kmeans_multi(t):
    e = t("embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    return models.assign(e, F.col("x"), models.kmeans_centres(e, F.col("x"), 10)).select(
        "vec_id", F.col("`$KM-K-Means`").alias("cluster"), F.col("`$KMD-K-Means`").alias("distance"),
    )


_PAIRS = "(SELECT a.vec_id, a.label AS own, b.label AS other, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


@query(f"""WITH m AS (SELECT vec_id, own, other, avg(d) AS d FROM {_PAIRS} GROUP BY ALL), s AS (SELECT vec_id, own, max(CASE WHEN other = own THEN d END) AS a, min(CASE WHEN other <> own THEN d END) AS b FROM m GROUP BY ALL)
SELECT vec_id AS key, 'cluster-' || own AS cluster, floor(coalesce((b - a) / greatest(a, b), 0.0) * 1000 + 0.5) / 1000 AS silhouette FROM s""")
def silhouette_of_queries(t):
    """Of the records whose id is divisible by 20, against all."""
    e = t("embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double"))).withColumn("c", F.concat(F.lit("cluster-"), "label"))
    return models.silhouette(e, F.col("x"), "c", "vec_id", of=e.where("vec_id % 20 = 0")).withColumn("silhouette", round_to(F.col("silhouette"), 3))


@query()
def silhouette(t):
    e = t("embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double"))).withColumn("c", F.concat(F.lit("cluster-"), "label"))
    return models.silhouette(e, F.col("x"), "c", "vec_id")


_NEIGHBOURS = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, avg(v) AS m, stddev_samp(v) AS sd FROM e GROUP BY i),
z AS (SELECT vec_id, label, e.i, (v - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM e JOIN s ON e.i = s.i),
d AS (SELECT q.vec_id, t.vec_id AS other, t.label, round(sum((q.z - t.z) * (q.z - t.z)), 9) AS d FROM z q JOIN z t ON q.i = t.i WHERE q.vec_id % 20 = 0 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM d)
SELECT vec_id, floor(avg(label) * 10000.0 + 0.5) / 10000.0 AS predicted FROM p WHERE k <= 5 GROUP BY vec_id"""


def _vectors(t):
    names = [f"e{i}" for i in range(64)]
    columns = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    return t("embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *columns), names


@query(_NEIGHBOURS)
def knn_predict(t):
    """The rows whose id is divisible by 20 as queries, against all rows, on all dimensions."""
    e, names = _vectors(t)
    out = models.knn(e, e.where("vec_id % 20 = 0"), "label", names, "vec_id")
    return out.select("vec_id", round_to(F.col("`$KNN-label`")).alias("predicted"))


@query()
def knn_predict_whole(t):
    """Every row as a query, on all dimensions."""
    e, names = _vectors(t)
    return models.knn(e, e, "label", names, "vec_id").select("vec_id", round_to(F.col("`$KNN-label`")).alias("predicted"))


@query("""WITH g AS (SELECT l_quantity AS v, sum((l_returnflag = 'A')::INT)::DOUBLE AS a, sum((l_returnflag = 'N')::INT)::DOUBLE AS n, sum((l_returnflag = 'R')::INT)::DOUBLE AS r FROM lineitem GROUP BY 1),
p AS (SELECT v, lead(v) OVER (ORDER BY v) AS up, sum(a) OVER (ORDER BY v) AS a, sum(n) OVER (ORDER BY v) AS n, sum(r) OVER (ORDER BY v) AS r, sum(a) OVER () AS ta, sum(n) OVER () AS tn, sum(r) OVER () AS tr FROM g),
q AS (SELECT (v + up) / 2 AS threshold, floor(((ta + tn + tr) - (ta * ta + tn * tn + tr * tr) / (ta + tn + tr) - ((a + n + r) - (a * a + n * n + r * r) / (a + n + r)) - ((ta - a + tn - n + tr - r) - ((ta - a) * (ta - a) + (tn - n) * (tn - n) + (tr - r) * (tr - r)) / (ta - a + tn - n + tr - r))) * 1000000.0 + 0.5) / 1000000.0 AS gain FROM p WHERE up IS NOT NULL)
SELECT 'l_quantity' AS field, threshold, floor(gain * 10000.0 + 0.5) / 10000.0 AS gain FROM q ORDER BY q.gain DESC, threshold LIMIT 1""")
def tree_best_split(t):
    return _r(models.best_splits(t("lineitem"), "l_returnflag", ["l_quantity"]), "gain")


@query(f"WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), r AS (SELECT a, sum(n) AS na FROM c GROUP BY a), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY b) SELECT {r4('(SELECT sum(n) FROM c) * (sum(n * n / (na * nb)) - 1)')} AS chi2, (count(DISTINCT c.a) - 1) * (count(DISTINCT c.b) - 1) AS df FROM c JOIN r ON c.a = r.a JOIN k ON c.b = k.b")
def chaid_chi_square(t):
    return _r(models.chi_square(t("lineitem"), "l_returnflag", "l_linestatus"), "chi2")


def _scored(t, fit, prefix):
    rows = field.partition(t("customer"), ["c_custkey"])
    rows = field.derive(rows, "rich", "c_acctbal > 4500")
    rows = rows.join(
        t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("orders")),
        "c_custkey", "left",
    )
    m = fit(rows.where("Partition = '1_Training'"), "rich", ["spent", "orders", "c_nationkey", "c_mktsegment", "c_acctbal"])
    return m.transform(rows).select(
        "c_custkey", "Partition", "rich", F.col(f"`${prefix}-rich`").alias("predicted"), F.col(f"`${prefix}C-rich`").alias("confidence"),
    )


@query()
def tree_predict(t):
    return _scored(t, models.tree, "R")


@query()
def chaid_predict(t):
    return _scored(t, models.Chaid, "CH")


@query()
def svm_predict(t):
    return _scored(t, lambda *a: models.svm(*a, iterations=100), "SVM")


@query()
def ann_predict(t):
    return _scored(t, lambda *a: models.ann(*a, iterations=100), "ANN")


@query()
def logistic_predict(t):
    return _scored(t, lambda *a: models.logistic(*a, iterations=100), "L")


@query()
def anomaly_score(t):
    c = t("customer")
    out = models.anomaly(c, c, ["c_acctbal", "c_mktsegment"])
    return out.select(
        "c_custkey", F.col("`$O-Anomaly`").alias("flag"), F.col("`$OA-Anomaly`").alias("idx"), F.col("`$OP-Anomaly`").alias("peer"),
        F.col("`$OR-Anomaly`").alias("reason"),
    )


_GIVEN = "(SELECT c_custkey, (c_acctbal - 4500.0) / 3000.0 AS x, (c_mktsegment = 'BUILDING')::INT AS y FROM customer)"


@query(f"""WITH m AS (SELECT c_custkey, 0.5 * x - 0.2 AS a, 0.3 * y - 0.4 * x AS b, 0.1 - 0.7 * y AS c FROM {_GIVEN}), g AS (SELECT *, greatest(a, b, c) AS top FROM m)
SELECT c_custkey, CASE WHEN a = top THEN 'p' WHEN b = top THEN 'q' ELSE 'r' END AS predicted, {r4('1 / (exp(a - top) + exp(b - top) + exp(c - top))')} AS confidence FROM g""")
def svm_given_planes(t):
    """Scores of given planes: the greatest margin, and the softmax of the margins as confidence."""
    encoder = models.Encoder({"c_acctbal": (4500.0, 3000.0)}, {"c_mktsegment": ["BUILDING"]}, ["c_acctbal", "c_mktsegment"])
    m = models.Svm("t", encoder, ["p", "q", "r"], [([0.5, 0.0], -0.2), ([-0.4, 0.3], 0.0), ([0.0, -0.7], 0.1)])
    return m.transform(t("customer")).select("c_custkey", F.col("`$SVM-t`").alias("predicted"), F.col("`$SVMC-t`").alias("confidence"))


@query(f"""WITH z AS (SELECT c_custkey, (c_acctbal - m) / s AS x FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)),
d AS (SELECT c_custkey, least(abs(x + 1), abs(x - 1)) AS d, CASE WHEN abs(x + 1) <= abs(x - 1) THEN 1 ELSE 2 END AS k FROM z), g AS (SELECT k, avg(d) AS m FROM d GROUP BY k),
i AS (SELECT c_custkey, d.k, d / m AS idx FROM d JOIN g ON d.k = g.k), q AS (SELECT quantile_cont(idx, 0.95) AS q FROM i)
SELECT c_custkey, {r4('idx')} AS idx, 'peer-' || k AS peer, CASE WHEN idx > q THEN 'anomaly' ELSE 'normal' END AS flag, CASE WHEN idx > q THEN 'c_acctbal' END AS reason FROM i, q""")
def anomaly_given_centres(t):
    out = models.anomaly(t("customer"), t("customer"), ["c_acctbal"], centres=[[-1.0], [1.0]])
    return out.select(
        "c_custkey", round_to(F.col("`$OA-Anomaly`")).alias("idx"), F.col("`$OP-Anomaly`").alias("peer"),
        F.col("`$O-Anomaly`").alias("flag"), F.col("`$OR-Anomaly`").alias("reason"),
    )


def _level(k: int) -> str:
    """SQL: all sets of ``k`` items with the number of baskets that hold them."""
    joins = "".join(f" JOIN b x{i} ON x{i}.basket = x0.basket AND x{i}.item > x{i - 1}.item" for i in range(1, k))
    return f"SELECT [{', '.join(f'x{i}.item' for i in range(k))}] AS items, count(*) AS n FROM b x0{joins} GROUP BY 1"


def _frequent(baskets: str, support: float) -> str:
    """SQL: the frequent sets of up to four items, as ``f``."""
    return f"""WITH b AS (SELECT * FROM {baskets}), t AS (SELECT count(DISTINCT basket)::DOUBLE AS t FROM b),
f AS (SELECT items, n FROM ({' UNION ALL '.join(_level(k) for k in range(1, 5))}), t WHERE n >= ceil({support} * t))"""


def _rules_of(baskets: str, support: float, confidence: float) -> str:
    """SQL: the rules with up to three antecedents, as ``r``."""
    return f"""{_frequent(baskets, support)}, u AS (SELECT items, n, unnest(items) AS c FROM f),
v AS (SELECT list_filter(items, lambda x: x <> c) AS ante, c, n FROM u WHERE len(items) > 1),
r AS (SELECT ante, c, v.n, v.n / fa.n::DOUBLE AS conf, v.n / fa.n::DOUBLE / (fc.n / t) AS lift
FROM v JOIN f fa ON fa.items = ante JOIN f fc ON fc.items = [c], t WHERE v.n / fa.n::DOUBLE >= {confidence})"""


_SHOWN_SETS = "SELECT array_to_string(items, ' & ') AS items, n FROM f"
_SHOWN_RULES = f"SELECT array_to_string(ante, ' & ') AS antecedent, c AS consequent, {r4('conf')} AS confidence, {r4('lift')} AS lift, n AS transactions FROM r"
_BASKETS = "(SELECT DISTINCT o_custkey AS basket, o_orderpriority AS item FROM orders)"
_EVENT_BASKETS = "(SELECT DISTINCT user_id AS basket, event_type AS item FROM events)"
_BRAND_BASKETS = "(SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
_RULES = _rules_of(_BASKETS, 0.1, 0.5)


def _sets(t):
    return models.baskets(t("orders"), "o_custkey", "o_orderpriority")


def _shown_sets(sets, support):
    found, _ = models.apriori(sets, support, 0)
    return found.select(F.array_join("items", " & ").alias("items"), "n")


def _shown_rules(rules):
    names = ("Antecedent", "Consequent", "Confidence", "Lift", "Transactions")
    return _r(rules.select(*[F.col(c).alias(c.lower()) for c in names]), "confidence", "lift")


@query(f"{_frequent(_BASKETS, 0.1)} {_SHOWN_SETS}")
def apriori_itemsets(t):
    return _shown_sets(_sets(t), 10)


@query(f"{_RULES} {_SHOWN_RULES}")
def apriori_rules(t):
    return _shown_rules(models.apriori(_sets(t), 10, 50)[1])


@query(f"{_frequent(_EVENT_BASKETS, 0.02)} {_SHOWN_SETS}")
def apriori_itemsets_whole(t):
    """Of all users, the kinds of events they caused; a low support."""
    return _shown_sets(models.baskets(t("events"), "user_id", "event_type"), 2)


@query(f"{_rules_of(_EVENT_BASKETS, 0.02, 0.3)} {_SHOWN_RULES}")
def apriori_rules_whole(t):
    return _shown_rules(models.apriori(models.baskets(t("events"), "user_id", "event_type"), 2, 30)[1])


@query(f"""{_RULES}, s AS (SELECT basket, list(item) AS own FROM b GROUP BY basket),
m AS (SELECT basket, r.*, array_to_string(ante, ' & ') AS a, row_number() OVER (PARTITION BY basket, c ORDER BY conf DESC, lift DESC, array_to_string(ante, ' & ') DESC) AS k
FROM s JOIN r ON list_has_all(own, ante) AND NOT list_contains(own, c))
SELECT basket::VARCHAR AS basket, c AS recommendation, a AS antecedent, {r4('conf')} AS confidence, {r4('lift')} AS lift FROM m WHERE k = 1""")
def apriori_recommend(t):
    sets = _sets(t)
    out = models.recommend(sets, models.apriori(sets, 10, 50)[1])
    names = ("Basket", "Recommendation", "Antecedent", "Confidence", "Lift")
    return _r(out.select(*[F.col(c).alias(c.lower()) for c in names]), "confidence", "lift")


# -- what models learnt, as tables -----------------------------------------------------------


def _cut_sql(rows: str, d: int, least: int) -> str:
    """SQL: the best cut of each node of ``rows`` (node, t, x0 and x1 numbers, s text) as ``k{d}``, and the rows one level down as ``l{d + 1}``."""
    kinds = ("A", "N", "R")
    sums = ", ".join(f"sum((t = '{c}')::INT)::DOUBLE AS c{i}" for i, c in enumerate(kinds))
    imp = lambda p: f"({' + '.join(p)}) - ({' + '.join(f'{x} * {x}' for x in p)}) / ({' + '.join(p)})"
    left, total = [f"c{i}" for i in range(3)], [f"t{i}" for i in range(3)]
    right = [f"(t{i} - c{i})" for i in range(3)]
    grown = ", ".join(f"sum(c{i}) OVER w AS c{i}" for i in range(3))
    return f"""g{d} AS (
  SELECT node, 0 AS f, x0 AS v, NULL AS value, {sums} FROM {rows} GROUP BY node, x0 UNION ALL SELECT node, 1, x1, NULL, {sums} FROM {rows} GROUP BY node, x1
  UNION ALL SELECT node, 2, NULL, s, {sums} FROM {rows} GROUP BY node, s),
n{d} AS (SELECT node, {', '.join(f"sum(c{i}) AS t{i}" for i in range(3))} FROM g{d} WHERE f = 2 GROUP BY node),
m{d} AS (
  SELECT node, f, (v + lead(v) OVER w) / 2 AS threshold, value, {grown} FROM g{d} WHERE f < 2 WINDOW w AS (PARTITION BY node, f ORDER BY v)
  UNION ALL SELECT node, f, NULL, value, c0, c1, c2 FROM g{d} WHERE f = 2),
j{d} AS (SELECT m.*, floor((({imp(total)}) - ({imp(left)}) - ({imp(right)})) * 1000000.0 + 0.5) / 1000000.0 AS gain FROM m{d} m JOIN n{d} n ON m.node = n.node
  WHERE (threshold IS NOT NULL OR value IS NOT NULL) AND c0 + c1 + c2 >= {least} AND t0 + t1 + t2 - c0 - c1 - c2 >= {least}),
k{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, threshold, value) AS place FROM j{d}) WHERE place = 1 AND gain > 1e-9),
l{d + 1} AS (SELECT r.* REPLACE (CASE WHEN k.node IS NULL THEN r.node WHEN CASE k.f WHEN 0 THEN r.x0 <= k.threshold WHEN 1 THEN r.x1 <= k.threshold ELSE r.s = k.value END
  THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node) FROM {rows} r LEFT JOIN k{d} k ON r.node = k.node)"""


_TREE = f"""WITH l0 AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag AS t, l_quantity AS x0, l_discount AS x1, l_linestatus AS s, 0 AS node FROM lineitem),
{_cut_sql('l0', 0, 20)}, {_cut_sql('l1', 1, 20)}, n AS (SELECT node, t, count(*) AS n, sum(count(*)) OVER (PARTITION BY node) AS whole FROM l2 GROUP BY node, t),
p AS (SELECT node, t AS predicted, n / whole AS share, row_number() OVER (PARTITION BY node ORDER BY n DESC, t) AS place FROM n)"""


def _small_tree(t):
    return models.tree(t("lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_linestatus"], 2, 20)


@query(f"{_TREE} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, predicted, {r4('share')} AS confidence FROM l2 JOIN p ON p.node = l2.node WHERE place = 1")
def tree_two_levels(t):
    out = _small_tree(t).transform(t("lineitem"))
    return out.select(*LINE, F.col("`$R-l_returnflag`").alias("predicted"), F.col("`$RC-l_returnflag`").alias("confidence"))


@query(f"{_TREE}, a AS (SELECT f, gain FROM k0 UNION ALL SELECT f, gain FROM k1) SELECT ['l_quantity', 'l_discount', 'l_linestatus'][f + 1] AS field, {r4('sum(gain) / (SELECT sum(gain) FROM a)')} AS importance FROM a GROUP BY f")
def tree_importance(t):
    found = _small_tree(t).importance()
    return _r(t("region").sparkSession.createDataFrame(list(found.items()), "field string, importance double"), "importance")


@query(f"{_TREE} SELECT predicted, sum(n)::BIGINT AS n, {r4('min(share)')} AS least FROM (SELECT p.*, x.n FROM p JOIN (SELECT node, count(*) AS n FROM l2 GROUP BY node) x ON x.node = p.node WHERE place = 1) GROUP BY predicted")
def tree_rules(t):
    """The leaves' rules, summed by what they say."""
    leaves = _small_tree(t).rules(t("region").sparkSession).where("leaf")
    return _r(leaves.groupBy(F.col("prediction").alias("predicted")).agg(F.sum("n").alias("n"), F.min("confidence").alias("least")), "least")


_GROUPS = """(SELECT CASE WHEN l_quantity > 30 THEN 'many' WHEN l_quantity > 10 THEN 'some' ELSE 'few' END AS y, l_quantity AS v FROM lineitem)"""
_BINNED = f"""WITH r AS (SELECT * FROM {_GROUPS}), e AS (SELECT DISTINCT unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM r),
c AS (SELECT y, (SELECT count(*) FROM e WHERE e < v) AS code FROM r), m AS (SELECT code, y, count(*) AS n FROM c GROUP BY ALL),
k AS (SELECT code, string_agg(y, '+' ORDER BY y) AS kinds FROM m GROUP BY code),
g AS (SELECT kinds, CASE WHEN contains(kinds, '+') THEN code END AS own, y, sum(n) AS n FROM m JOIN k USING (code) GROUP BY ALL)"""


@query(f"""{_BINNED}, a AS (SELECT kinds, own, sum(n) AS a FROM g GROUP BY ALL), b AS (SELECT y, sum(n) AS b FROM g GROUP BY y), t AS (SELECT sum(n)::DOUBLE AS t FROM g)
SELECT {r4('(SELECT t FROM t) * (sum(n * n / (a * b)::DOUBLE) - 1)')} / 1000 AS chi2, (count(DISTINCT a.kinds || coalesce(a.own, 0)) - 1) * 2 AS df, (SELECT count(*) FROM a) AS groups
FROM g JOIN a ON a.kinds = g.kinds AND a.own IS NOT DISTINCT FROM g.own JOIN b ON b.y = g.y""")
def chaid_split(t):
    """A root split: ranges of one class merge, ranges that hold two stay apart."""
    rows = t("lineitem").select(F.when(F.col("l_quantity") > 30, "many").when(F.col("l_quantity") > 10, "some").otherwise("few").alias("y"), F.col("l_quantity").alias("v"))
    s = models.Chaid(rows, "y", ["v"], max_depth=1).nodes[0]["split"]
    row = (math.floor(s["chi2"] * 1e4 + 0.5) / 1e4 / 1000, s["df"], len(set(s["children"].values())))
    return t("region").sparkSession.createDataFrame([row], "chi2 double, df bigint, groups bigint")


@query(f"""SELECT term, {r4('value / 1000')} AS coefficient FROM (SELECT regr_slope(l_extendedprice, (l_quantity - m) / s) AS a, regr_intercept(l_extendedprice, (l_quantity - m) / s) AS b
FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)), LATERAL (SELECT 'l_quantity' AS term, a AS value UNION ALL SELECT '(Intercept)', b)""")
def linear_coefficients(t):
    found = models.linear(t("lineitem"), "l_extendedprice", ["l_quantity"]).coefficients(t("region").sparkSession)
    return found.select("term", round_to(F.col("coefficient") / 1000).alias("coefficient"))


_NAMED = "(SELECT *, 'cluster-' || (1 + (c_nationkey % 3)) AS cluster FROM customer)"


@query(f"""SELECT cluster, count(*) AS n, 'c_acctbal' AS field, ({r4('avg(c_acctbal / 1000)')})::VARCHAR AS value FROM {_NAMED} GROUP BY cluster
UNION ALL SELECT c.cluster, c.n, 'c_mktsegment', v.c_mktsegment FROM (SELECT cluster, count(*) AS n FROM {_NAMED} GROUP BY cluster) c
JOIN (SELECT cluster, c_mktsegment, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, c_mktsegment) AS k FROM {_NAMED} GROUP BY cluster, c_mktsegment) v ON v.cluster = c.cluster AND k = 1""")
def cluster_profiles(t):
    rows = t("customer").withColumn("cluster", F.concat(F.lit("cluster-"), 1 + F.col("c_nationkey") % 3)).withColumn("c_acctbal", F.col("c_acctbal") / 1000)
    return models.profiles(rows, ["c_acctbal", "c_mktsegment"], "cluster")


@query(f"""WITH m AS (SELECT vec_id, own, other, avg(d) AS d FROM {_PAIRS} GROUP BY ALL), s AS (SELECT vec_id, own, max(CASE WHEN other = own THEN d END) AS a, min(CASE WHEN other <> own THEN d END) AS b FROM m GROUP BY ALL),
x AS (SELECT 'cluster-' || own AS cluster, coalesce((b - a) / greatest(a, b), 0.0) AS v FROM s), y AS (SELECT cluster, v FROM x UNION ALL SELECT 'all', v FROM x)
SELECT cluster, count(*) AS n, floor(avg(v) * 1000 + 0.5) / 1000 AS silhouette, CASE WHEN avg(v) > 0.7 THEN 'strong' WHEN avg(v) > 0.5 THEN 'reasonable' WHEN avg(v) > 0.25 THEN 'weak' ELSE 'none' END AS structure FROM y GROUP BY cluster""")
def silhouette_by_cluster(t):
    """Means of the records whose id is divisible by 20, against all."""
    e = t("embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double"))).withColumn("c", F.concat(F.lit("cluster-"), "label"))
    found = models.silhouette(e, F.col("x"), "c", "vec_id", of=e.where("vec_id % 20 = 0"))
    return models.silhouette_summary(found).withColumn("silhouette", round_to(F.col("silhouette"), 3))


@query(f"""WITH z AS (SELECT c_custkey, (c_acctbal - m) / s AS x FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)),
d AS (SELECT c_custkey, least(abs(x + 1), abs(x - 1)) AS d, CASE WHEN abs(x + 1) <= abs(x - 1) THEN 1 ELSE 2 END AS k FROM z), g AS (SELECT k, avg(d) AS m FROM d GROUP BY k)
SELECT c_custkey, {r4('d / m')} AS idx, CASE WHEN d / m > 1.5 THEN 'anomaly' ELSE 'normal' END AS flag FROM d JOIN g ON d.k = g.k""")
def anomaly_by_index(t):
    out = models.anomaly(t("customer"), t("customer"), ["c_acctbal"], centres=[[-1.0], [1.0]], index=1.5)
    return out.select("c_custkey", round_to(F.col("`$OA-Anomaly`")).alias("idx"), F.col("`$O-Anomaly`").alias("flag"))


# -- whole flows ---------------------------------------------------------------------------

for _flow in flows.FLOWS:
    query()(_flow)


@query(f"{_rules_of(_BRAND_BASKETS, 0.01, 0.1)} {_SHOWN_RULES}")
def example_market_basket(t):
    """Brands bought in one order."""
    lines = record.merge(t("lineitem").select("l_orderkey", "l_partkey"), t("part").select("p_partkey", "p_brand"), "l_partkey", "p_partkey")
    return _shown_rules(models.apriori(models.baskets(lines, "l_orderkey", "p_brand"), 1, 10)[1])


@query(f"{_rules_of(_BASKETS, 0.1, 0.5)} {_SHOWN_RULES}")
def example_basket_flags(t):
    """The same baskets of priorities from one flag for each."""
    names = [r[0] for r in t("orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    flags = t("orders").groupBy("o_custkey").agg(*[F.max(F.when(F.col("o_orderpriority") == n, "T").otherwise("F")).alias(n) for n in names])
    return _shown_rules(models.apriori(models.flag_baskets(flags, names, "o_custkey"), 10, 50)[1])
