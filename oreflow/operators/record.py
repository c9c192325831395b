"""Record operators: select, sample, sort, distinct, merge, append, aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreflow.functions import rng
from oreflow.functions.expressions import Value, truth
from oreflow.functions.values import as_text, col, cols, is_number, known
from oreflow.operators.lineage import kept

COMPARISONS = ("=", "!=", ">", ">=", "<", "<=", "contains", "is missing", "is not missing")


def positions(df: DataFrame, keys: list[str], name: str = "__pos") -> DataFrame:
    """``df`` with each row's 0-based place in the order of ``keys``, without a single-task sort.

    Rows are dealt into ranges of all keys, of any type; ties are told apart
    by the other columns and then by where they lie, so neither a hot key nor
    repeated rows are one task.  The sorted ranges are kept, and their sizes,
    one number each, are the offsets of the places within them.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [col(c) for c, kind in df.dtypes if c not in keys and "map<" not in kind]
    order = [*cols(keys), F.col("__tie"), F.col("__at")]
    tied = df.select("*", F.xxhash64(*rest, F.lit(0)).alias("__tie"), F.monotonically_increasing_id().alias("__at"))
    dealt = tied.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The running id holds the partition's number above 33 bits, and below them the place in it.
    marked = kept(dealt.drop("__tie", "__at").withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    offsets, at = [], 0
    for r in sorted(marked.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        offsets.append((r["part"], at))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "__part bigint, __start bigint")
    numbered = marked.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.select(*[col(c) for c in df.columns], (F.col("__start") + place).alias(name))


#: Groups whose ranges are sent to every task (2 KB each), and how many edges a first look steps over.
FEW_GROUPS, STRIDE = 1000, 16


def quantiles(df: DataFrame, keys: list[str], field: str, shares: list[float], cuts: int = 256) -> DataFrame:
    """Exact interpolated quantiles of a number within groups of ``keys``: ``q0``, ``q1``... and no row for groups without values.

    Values are counted, then cut into ``cuts`` ranges by approximate
    quantiles; the ranges' totals say which of them hold the wanted ranks, and
    only those ranges are sorted.  No task holds a whole group.
    """
    value = known(df, field).cast("double")
    names = [f"k{i}" for i in range(len(keys))]
    base = df.where(value.isNotNull()).select(
        F.struct(F.lit(0).alias("one"), *[col(k).alias(n) for k, n in zip(keys, names, strict=True)]).alias("g"), value.alias("v"),
    )
    counts = kept(base.groupBy("g", "v").agg(F.count("*").alias("n")))  # read twice
    edges = F.approx_percentile("v", F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), F.lit(4 * cuts))
    groups = kept(counts.groupBy("g").agg(F.sum("n").alias("total"), edges.alias("edges")))
    if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        groups = F.broadcast(groups)  # so that no task gets all values of a group
    # Every STRIDE-th edge first, then those between two of them.
    below = lambda some: F.size(F.filter(some, lambda e: e < F.col("v")))
    step = below("coarse") * STRIDE
    coarse = F.filter("edges", lambda _, i: i % STRIDE == STRIDE - 1)
    placed = kept(counts.join(groups.withColumn("coarse", coarse), "g").select("g", "v", "n", "total", (step + below(F.slice("edges", step + 1, STRIDE))).alias("bin")))
    ranks = [(F.col("total") - 1) * s for s in shares]
    bins = placed.groupBy("g", "total", "bin").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("g").orderBy("bin")  # as many rows as cuts
    bins = bins.withColumn("before", F.sum("n").over(order) - F.col("n"))
    wanted = [w for r in ranks for w in (F.floor(r), F.ceil(r))]
    holds = F.lit(False)
    for w in wanted:
        holds = holds | ((F.col("before") <= w) & (w < F.col("before") + F.col("n")))
    few = bins.where(holds).select("g", "bin", "before")
    inside = Window.partitionBy("g", "bin").orderBy("v")
    rows = placed.join(few, ["g", "bin"]).withColumn("first", F.col("before") + F.sum("n").over(inside) - F.col("n"))
    at = lambda w: F.max(F.when((F.col("first") <= w) & (w < F.col("first") + F.col("n")), F.col("v")))
    found = rows.groupBy("g", "total").agg(*[at(w).alias(f"w{i}") for i, w in enumerate(wanted)])
    out = [(F.col(f"w{2 * i}") + (F.col(f"w{2 * i + 1}") - F.col(f"w{2 * i}")) * (r - F.floor(r))).alias(f"q{i}") for i, r in enumerate(ranks)]
    return found.select(*[F.col("g")[n].alias(k) for k, n in zip(keys, names, strict=True)], *out)


def quantile(df: DataFrame, field: str, *shares: float) -> list[float]:
    """Exact quantiles over all rows; empty without values."""
    row = quantiles(df, [], field, list(shares)).first()
    return list(row) if row else []


def condition(df: DataFrame, field: str, op: str, value: str = "") -> Column:
    """The two-valued test of a simple selection: a missing value passes ``is missing`` only."""
    if op not in COMPARISONS:
        raise ValueError(f"Unknown comparison: {op}")
    c = known(df, field)
    if op in ("is missing", "is not missing"):
        return c.isNull() if op == "is missing" else c.isNotNull()
    if op == "contains":
        return F.coalesce(F.lower(as_text(df, field)).contains(str(value).lower()), F.lit(False))
    if is_number(df, field):
        try:
            v: Column = F.lit(float(value) if str(value).strip() else 0.0)
        except ValueError:
            raise ValueError(f'"{value}" is not a number.') from None
    else:
        v = F.lit(str(value))
    test = {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
    return F.coalesce(test, F.lit(False))


def select(df: DataFrame, test: Value | Column | str, keep: bool = True) -> DataFrame:
    """Rows that pass ``test`` (a value of the expression language, a Column or a Spark SQL condition), or with ``keep=False`` all others, missing ones included."""
    test = truth(test) if isinstance(test, Value) else F.expr(test) if isinstance(test, str) else test
    passed = F.coalesce(test, F.lit(False))
    return df.where(passed if keep else ~passed)


def sample_first(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    return df.orderBy(*cols(keys)).limit(max(0, int(n)))


def sample_every(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    return positions(df, keys).where(F.col("__pos") % max(1, round(n)) == 0).drop("__pos")


def sample_random(df: DataFrame, percent: float, seed: int, keys: list[str]) -> DataFrame:
    """Each row by its own draw; the same rows at every run and partitioning."""
    return positions(df, keys).where(rng.uniform(seed, F.col("__pos")) * 100 < percent).drop("__pos")


def reservoir(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """A reservoir sample of ``n`` rows: the last row drawn for each slot stays, found by one grouped maximum."""
    p = positions(df, keys)
    slot = F.when(F.col("__pos") < n, F.col("__pos")).otherwise(F.floor(rng.uniform(seed, F.col("__pos") - n) * (F.col("__pos") + 1)))
    row = F.struct(*cols(df.columns))
    return p.withColumn("__slot", slot).where(F.col("__slot") < n).groupBy("__slot").agg(F.max_by(row, "__pos").alias("row")).select("row.*")


def sort(df: DataFrame, field: str, ascending: bool = True, keys: list[str] | None = None) -> DataFrame:
    """By one field, missing values last either way; ``keys`` keep the former order of ties."""
    c = known(df, field)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *cols(keys or []))


def distinct(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """The first row, in the order of ``keys``, of each combination of ``fields`` (all fields if none are given)."""
    if not fields:
        return df.distinct()
    fields = [f for f in fields if f in df.columns]
    if not fields:  # unknown ones tell no rows apart
        return df.orderBy(*cols(keys)).limit(1)
    # A grouped minimum combines on the map side, so a hot combination is no single task.
    order = F.struct(*cols(keys))
    whole = df.groupBy(*cols(fields)).agg(F.min_by(F.struct(*cols(df.columns)), order).alias("__row"))
    return whole.select("__row.*")


def placed(df: DataFrame, keys: list[str], name: str = "Place") -> DataFrame:
    """``df`` with a place that later operators carry along and order by: of any type that sorts, here the values of ``keys``.

    Where the keys leave ties, use :func:`positions`.  No sort is made until an
    operator that needs the order, given ``[name]`` as its keys.
    """
    return df.withColumn(name, F.struct(*cols(keys)))


def _renamed(left: DataFrame, right: DataFrame, right_key: str) -> dict[str, str]:
    """The names that the right fields but the key get in a join."""
    names: dict[str, str] = {}
    for c in right.columns:
        if c != right_key:
            new, k = c, 2
            while new in left.columns or new in names.values():
                new, k = f"{c}_{k}", k + 1
            names[c] = new
    return names


def merge(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", places: tuple[str, str] | None = None, place: str = "Place",
) -> DataFrame:
    """Join on keys compared as text; missing keys never match; the right key is dropped, colliding names get _2, _3...

    Keys of one type are compared as they are, which is the same and keeps
    bucketing and pushed filters; rows without a key are set apart, not shuffled.
    With ``places``, the fields of the two sides' places, the rows get a last
    field ``place``: in the order of the left rows, those of one in that of the
    right ones, and right rows without a match behind all others.
    """
    if places:
        # The sides' places stand for themselves until both are known.
        a, b = "__left_place", "__right_place"
        both = merge(left.withColumnRenamed(places[0], a), right.withColumnRenamed(places[1], b), left_key, right_key, how)
        return both.select(*[col(c) for c in both.columns if c not in (a, b)], F.struct(col(a).isNull().alias("alone"), col(a).alias("left"), col(b).alias("right")).alias(place))
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"Unknown join: {how}")
    names = _renamed(left, right, right_key)
    same = dict(left.dtypes)[left_key] == dict(right.dtypes)[right_key]
    form = known if same else as_text
    lk, rk = form(left, left_key), form(right, right_key)
    r = right.select(rk.alias("__rk"), col(right_key).alias("__raw"), *[col(c).alias(n) for c, n in names.items()])
    joined = left.where(lk.isNotNull()).withColumn("__lk", lk).join(r.where("__rk is not null"), F.col("__lk") == F.col("__rk"), how)
    key = col(left_key)
    if how in ("right", "full"):
        key = F.coalesce(key, F.col("__raw")) if same else F.coalesce(F.col("__lk"), F.col("__rk"))
    out = joined.select(*[key.alias(c) if c == left_key else col(c) for c in left.columns], *[col(n) for n in names.values()])
    if how in ("left", "full"):
        out = out.unionByName(
            left.where(lk.isNull()).withColumn(left_key, col(left_key).cast(out.schema[left_key].dataType)),
            allowMissingColumns=True,
        )
    if how in ("right", "full"):
        alone = r.where("__rk is null").withColumn(left_key, F.col("__raw").cast(out.schema[left_key].dataType)).drop("__rk", "__raw")
        out = out.unionByName(alone, allowMissingColumns=True)
    return out


#: Rows within which one task adds up weights.
RUN = 1 << 16


def _starts(df: DataFrame, keys: list[str], weight: Column) -> tuple[DataFrame, int]:
    """``df`` with ``__start``, the sum of the weights of the rows before each in the order of ``keys``, and the sum of all."""
    rows = positions(df.withColumn("__w", weight.cast("bigint")), keys).withColumn("__run", F.floor(F.col("__pos") / RUN))
    sums, total = [], 0
    for r in sorted(rows.groupBy("__run").agg(F.sum("__w").alias("w")).collect(), key=lambda r: r["__run"]):  # a number for RUN rows
        sums.append((r["__run"], total))
        total += r["w"]
    before = df.sparkSession.createDataFrame(sums, "__run bigint, __before bigint")
    within = Window.partitionBy("__run").orderBy("__pos")
    out = rows.join(F.broadcast(before), "__run").withColumn("__start", F.col("__before") + F.sum("__w").over(within) - F.col("__w"))
    return out.select(*[col(c) for c in df.columns], "__start"), total


def _sides(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame, bool]:
    """Both tables with the key ``__k`` by which :func:`merge` compares them, and whether they have it in one type."""
    same = dict(left.dtypes)[left_key] == dict(right.dtypes)[right_key]
    form = known if same else as_text
    return left.withColumn("__k", form(left, left_key)), right.withColumn("__k", form(right, right_key)), same


def merge_every(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int, how: str = "inner", places: tuple[str, str] = ("Place", "Place")) -> DataFrame:
    """The rows of ``sample_every(merge(..., places), n, [place])`` without their place; only these rows are made.

    The left rows in their order, each with the number of its matches, give
    the place at which its matches begin; a match's rank among the right rows
    of its key tells the rest.  So sampled pairs agree in key and in the rank's
    remainder, and the join looks for those alone.  Places are not missing.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"Unknown join: {how}")
    n = max(1, round(n))
    names = _renamed(left.drop(places[0]), right.drop(places[1]), right_key)
    fields = [c for c in left.columns if c != places[0]]
    lefts, rights, same = _sides(left, right, left_key, right_key)
    right_only = how in ("right", "full")
    keyed = F.col("__k") if right_only and not same else col(left_key)
    matches = rights.where("__k is not null").groupBy("__k").agg(F.count("*").alias("__m"))
    counted = lefts.join(matches, "__k", "left").withColumn("__m", F.coalesce("__m", F.lit(0)))
    given = F.col("__m") if how in ("inner", "right") else F.greatest("__m", F.lit(1))
    started, total = _starts(counted, [places[0]], given)
    started = started.select("__k", "__m", "__start", *[(keyed if c == left_key else col(c)).alias(c) for c in fields])
    ranked = positions(rights.where("__k is not null"), ["__k", places[1]])
    firsts = ranked.groupBy("__k").agg(F.min("__pos").alias("__first"))
    ranked = ranked.join(firsts, "__k").select(
        "__k", F.pmod(F.col("__pos") - F.col("__first"), F.lit(n)).alias("__r"), *[col(c).alias(new) for c, new in names.items()],
    )
    asked = started.where("__m > 0").withColumn("__r", F.pmod(-F.col("__start"), F.lit(n)))
    out = asked.join(ranked, ["__k", "__r"]).select(*cols(fields), *cols(names.values()))
    if how in ("left", "full"):
        out = out.unionByName(started.where((F.col("__m") == 0) & (F.col("__start") % n == 0)).select(*cols(fields)), allowMissingColumns=True)
    if right_only:
        raw = col(right_key) if same else F.coalesce(F.col("__k"), col(right_key).cast("string"))
        alone = rights.join(lefts.where("__k is not null").select("__k").distinct(), "__k", "left_anti")
        alone = positions(alone, [places[1]]).where((F.col("__pos") + total) % n == 0)
        out = out.unionByName(alone.select(raw.alias(left_key), *[col(c).alias(new) for c, new in names.items()]), allowMissingColumns=True)
    return out


def merge_aggregate(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, keys: list[str], how: str = "inner", places: tuple[str, str] = ("Place", "Place"), place: str = "Place",
) -> DataFrame:
    """``aggregate(merge(..., places), keys, [], [], place)`` for ``keys`` of the left fields: sizes and first places of groups, from the two sides' counts."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"Unknown join: {how}")
    right_only = how in ("right", "full")
    if not set(keys) <= set(left.columns) or right_only and left_key in keys:
        raise ValueError("Groups are of left fields that the join leaves as they are.")
    lefts, rights, _ = _sides(left, right, left_key, right_key)
    matches = rights.where("__k is not null").groupBy("__k").agg(F.count("*").alias("__m"), F.min(col(places[1])).alias("__b"))
    rows = lefts.join(matches, "__k", "left" if how in ("left", "full") else "inner")
    at = lambda alone, a, b: F.struct(F.lit(alone).alias("alone"), a.alias("left"), b.alias("right"))
    kinds = dict(left.dtypes)
    parts = [rows.groupBy(*cols(keys)).agg(F.sum(F.coalesce("__m", F.lit(1))).alias("Record_Count"), F.min(at(False, col(places[0]), F.col("__b"))).alias("__p"))]
    if right_only:
        alone = rights.join(lefts.where("__k is not null").select("__k").distinct(), "__k", "left_anti")
        found = alone.agg(F.count("*").alias("Record_Count"), F.min(at(True, F.lit(None).cast(kinds[places[0]]), col(places[1]))).alias("__p")).where(F.col("Record_Count") > 0)
        parts.append(found.select(*[F.lit(None).cast(kinds[k]).alias(k) for k in keys], "Record_Count", "__p"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = both.groupBy(*cols(keys)).agg(F.sum("Record_Count").alias("Record_Count"), F.min("__p").alias(place))
    return out.where("Record_Count is not null")


def append(frames: list[DataFrame], tag: str = "", labels: list[str] | None = None, places: list[str] | None = None, place: str = "Place") -> DataFrame:
    """All rows by field name; a field that is number here and text there becomes text; ``tag`` names the origin.

    With ``places``, the fields of the tables' places (of one type), the rows
    get a last field ``place``: table after table, each in its own order.
    """
    if places:
        own = [f.withColumn("__place", F.struct(F.lit(k).alias("table"), col(p).alias("at"))).drop(p) for k, (f, p) in enumerate(zip(frames, places, strict=True))]
        out = append(own, tag, labels)
        return out.select(*[col(c) for c in out.columns if c != "__place"], F.col("__place").alias(place))
    kinds: dict[str, set[bool]] = {}
    for f in frames:
        for c in f.columns:
            kinds.setdefault(c, set()).add(is_number(f, c))
    ready = []
    for k, f in enumerate(frames):
        own = [as_text(f, c).alias(c) if len(kinds[c]) > 1 else col(c) for c in f.columns]
        ready.append(f.select(*own, *([F.lit((labels or [str(i) for i in range(len(frames))])[k]).alias(tag)] if tag else [])))
    out = ready[0]
    for f in ready[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


AGGREGATES = {
    "Mean": lambda c: F.avg(c),
    "Sum": lambda c: F.sum(c.cast("double")),
    "Min": lambda c: F.min(c),
    "Max": lambda c: F.max(c),
    "SDev": lambda c: F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c)),
}


def aggregate(df: DataFrame, keys: list[str], values: list[str], funcs: list[str], place: str | None = None) -> DataFrame:
    """Groups of ``keys`` (NULL is a group) with each function of each value and ``Record_Count``; no rows give no groups.

    With ``place``, a field of places, each group has that of its first row.
    """
    out = [AGGREGATES[f](known(df, v).cast("double")).alias(f"{v}_{f}") for v in values for f in funcs] + [F.count("*").alias("Record_Count")]
    out += [F.min(col(place)).alias(place)] if place else []
    if keys:
        return df.groupBy(*cols(keys)).agg(*out)
    return df.groupBy(F.lit(1).alias("__all")).agg(*out).drop("__all")


def value_counts(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(as_text(df, field).alias("value")).agg(F.count("*").alias("n")).where("value is not null")


def mode(df: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """The commonest value; of equally common ones that which comes first in the order of ``keys``."""
    c = known(df, field)
    return df.where(c.isNotNull()).groupBy(c.alias("value")).agg(
        F.count("*").alias("n"), F.min(F.struct(*cols(keys))).alias("first"),
    ).orderBy(F.desc("n"), "first").limit(1).select("value", "n")
