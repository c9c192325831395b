"""N-gram Jaccard join: near duplicates by word shingles through prefix trees.

Two documents link when the Jaccard similarity of their sets of 5-word
shingles is at least 0.75 (100 * common >= 75 * union, exactly).  The result
is one row per document with its class: no pairs of copies are expanded.

1. Each text becomes a set of shingle hashes.  Equal sets are one class.  A
   fixed-size count sketch of all documents gives one global order of shingles.
2. Sets that link share one of the rarest |s| - ceil(0.75 |s|) + 1 shingles.
   A task emits those once per class, keyed by shingle; shingles that two
   classes share make a group.
3. A group is compared as a star: its smallest class against the others.  The
   others' sets, most frequent shingles first, are stored in a prefix tree;
   the centre's set walks it once, sharing partial overlaps, and leaves a
   subtree as soon as the remaining length can't reach the threshold.
4. Links give components.  Groups that still hold different components are
   compared to the end, by those of their classes that meet another component
   within the bounds on lengths and places: small ones by each such pair,
   crowded ones and those of large components as blocks of trees that blocks
   of the other classes walk together.  No pair that can link is left out.

Groups of a frequent shingle are salted, stars and groups of many members are
cut into blocks of bounded size, components are found by distributed star
contraction.

Null or empty text has an empty set and links with nothing; a null ``doc_id``
links with nothing (its component is null); repeated rows are copies; rows of
one ``doc_id`` with different texts are classes of their own; an empty table
gives no rows.  Columns beside the two used are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreflow.llm import common

N = 5
SKETCH_BITS = 22
#: A shingle whose sketch count is over this many times the mean count is dealt out over SALTS keys or one for each shuffle partition, from 1 on; salt 0 marks the others.
HEAVY, SALTS = 8, 32
#: Classes, and on the average shingles, of a block at most.
BLOCK, BLOCK_SHINGLES = 256, 200_000
#: Components of more classes, and groups of more small components' classes, than these are compared as blocks of trees, not pair by pair.
LARGE, CROWD = 16, 64
#: The most shingles of a set that can reach the threshold with this row's if their first common one is the row's: 7 * (n - place) >= 3 * (n + m).
REACH = "((4 * n - 7 * place) div 3)"
#: Shingles of a tree times the probes that walk it together at most.
WALKED = 1 << 25
#: Ids of documents up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(text: str, n: int = N) -> np.ndarray:
    """Distinct hashes of the n-word shingles (A-Z lower-cased, ASCII white space), in order of the hash."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64(shingles.tobytes(), seed=len(shingles)).intdigest() - (1 << 63)


def _bins(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def enough(common_size: int, a: int, b: int) -> bool:
    return 100 * common_size >= 75 * (a + b - common_size)


class PrefixTree:
    """Sets as sequences in one global order; runs without branches are one node."""

    __slots__ = ("children", "longest", "members", "run")

    def __init__(self, run: list[int]):
        self.run, self.children, self.members, self.longest = run, {}, [], 0

    def add(self, sequence: list[int], member: int) -> None:
        node, at, n = self, 0, len(sequence)
        while True:
            node.longest = max(node.longest, n)
            if at == n:
                node.members.append(member)
                return
            child = node.children.get(sequence[at])
            if child is None:
                leaf = PrefixTree(sequence[at:])
                leaf.longest, leaf.members = n, [member]
                node.children[sequence[at]] = leaf
                return
            run, k = child.run, 1
            while k < len(run) and at + k < n and run[k] == sequence[at + k]:
                k += 1
            if k < len(run):  # the run branches here
                rest = PrefixTree(run[k:])
                rest.children, rest.members, rest.longest = child.children, child.members, child.longest
                child.run, child.children, child.members = run[:k], {run[k]: rest}, []
            node, at = child, at + k

    def linked(self, probe: set[int]) -> list[int]:
        """Members that reach the threshold with ``probe``."""
        size, found = len(probe), []
        stack = [(self, 0, 0)]
        while stack:
            node, depth, same = stack.pop()
            same += len(probe.intersection(node.run))
            depth += len(node.run)
            # With m of d shingles in common, a set of length L has at most m + L - d.
            if 4 * node.longest < 3 * size + 7 * (depth - same):
                continue
            if node.members and enough(same, size, depth):
                found += node.members
            stack += [(c, depth, same) for c in node.children.values()]
        return found

    def linked_all(self, probes: list[np.ndarray], known: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of the probe, member) of all that reach the threshold; the probes walk the tree together. ``known``: the tree's shingles, in order."""
        at = 0
        while at < len(probes):
            # As many probes as have WALKED numbers, one at least.
            end = at + max(1, WALKED // (len(known) + 1))
            some = probes[at:end]
            sizes, of = np.array(list(map(len, some))), np.repeat(np.arange(len(some)), list(map(len, some)))
            shingles = np.concatenate(some)
            place = np.searchsorted(known, shingles)
            same = known[np.minimum(place, len(known) - 1)] == shingles
            has = np.zeros((len(known), len(some)), bool)
            has[place[same], of[same]] = True
            stack = [(self, 0, np.arange(len(some)), np.zeros(len(some), np.int64))]
            while stack:
                node, depth, live, common_size = stack.pop()
                if node.run:
                    depth += len(node.run)
                    rows = np.searchsorted(known, np.array(node.run, np.uint64))
                    common_size = common_size + np.count_nonzero(has[rows] if len(live) == len(some) else has[rows[:, None], live], axis=0)
                stay = 4 * node.longest >= 3 * sizes[live] + 7 * (depth - common_size)
                if not stay.any():
                    continue
                live, common_size = live[stay], common_size[stay]
                if node.members:
                    for i in live[100 * common_size >= 75 * (sizes[live] + depth - common_size)].tolist():
                        for x in node.members:
                            yield at + i, x
                stack += [(c, depth, live, common_size) for c in node.children.values()]
            at = end


def _sets(docs: DataFrame) -> DataFrame:
    """Per document: its size and class; per task one sketch row (packed, in ``counts``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        common.forget()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = list(map(shingle_set, b.column(1).to_pylist()))
                np.add.at(sketch, np.concatenate([_bins(s) for s in sets]), np.uint32(1))
                yield {"doc_id": b.column(0), "n": list(map(len, sets)), "cls": list(map(class_of, sets)), "counts": [None] * len(sets)}
        if sketch.any():
            yield {"doc_id": [None], "n": [None], "cls": [None], "counts": [_pack(sketch)]}

    return common.map_rows(docs, run, "doc_id bigint, n bigint, cls bigint, counts binary")


def _pack(sketch: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(sketch.astype("<u4").tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u4")


def _sketch(first: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: added up in tasks, 64 at a time, until a few are left, each of the same fixed size."""
    rows = first.where("counts is not null").select("counts")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for x in b.column(0):
                total += _unpack(x.as_py())
        yield {"counts": [_pack(total)]}

    while (n := rows.count()) > 8:
        rows = common.saved(common.map_rows(rows.coalesce(max(4, n // 64)), add, "counts binary"), "sketches")  # read where they lie: no shuffle
    return sum((_unpack(r["counts"]) for r in rows.collect()), np.zeros(1 << SKETCH_BITS, np.uint32))


def _prefixes(docs: DataFrame, sketch, salts: int) -> DataFrame:
    """(shingle, salt, class, n, place) of the rarest shingles, once per task and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts = sketch.value
        heavy = HEAVY * counts.mean() + 100
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                out: list[list[np.ndarray]] = [[] for _ in range(5)]
                b = whole.slice(at, 512)
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if i is None or not len(s := shingle_set(x)) or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)
                    weight = counts[_bins(s)]
                    first = np.lexsort((s, weight))[: prefix_length(len(s))]
                    for o, v in zip(
                        out,
                        (
                            s[first].view(np.int64), np.where(weight[first] > heavy, 1 + c % salts, 0), np.full(len(first), c),
                            np.full(len(first), len(s)), np.arange(len(first)),
                        ),
                        strict=True,
                    ):
                        o.append(v)
                yield {k: np.concatenate(v) if v else [] for k, v in zip(("tok", "salt", "cls", "n", "place"), out, strict=True)}

    return common.map_rows(docs, run, "tok bigint, salt int, cls bigint, n int, place int")


def _ordered_sets(docs: DataFrame, sketch) -> DataFrame:
    """(class, sequence): the whole set as int64 bytes, most frequent shingles first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts = sketch.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                own = {class_of(s): s for x in whole.slice(at, 512).column(0).to_pylist() if len(s := shingle_set(x))}
                yield {"cls": list(own), "sequence": [s[np.lexsort((s, counts[_bins(s)]))[::-1]].tobytes() for s in own.values()]}

    return common.map_rows(docs.select("text"), run, "cls bigint, sequence binary").dropDuplicates(["cls"])


def _possible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs whose lengths and common rare shingles leave the threshold in reach.

    Of the set whose prefix ends first in the global order, every common
    shingle outside both prefixes lies behind its prefix; so a pair has at
    most |prefixes in common| + max(n - prefix length) shingles in common.
    """
    side = lambda x: prefixes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("toks").alias(f"toks_{x}"))
    behind = lambda n: f"(int((3 * {n} + 3) / 4) - 1)"
    both = pairs.join(side("a"), "a").where("n_a is not null").join(side("b"), "b")
    near = "4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)"
    enough_common = f"7 * (size(array_intersect(toks_a, toks_b)) + greatest({behind('n_a')}, {behind('n_b')})) >= 3 * (n_a + n_b)"
    return common.cut_lineage(both.where(near).where(enough_common).select("a", "b", "n_b"))


def _sets_of(pairs: DataFrame, members: DataFrame, base: DataFrame, sketch) -> DataFrame:
    """The ordered sets of the classes in ``pairs``, each read from one document of the class."""
    return _sets_of_classes(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), members, base, sketch)


def _sets_of_classes(wanted: DataFrame, members: DataFrame, base: DataFrame, sketch) -> DataFrame:
    ids = common.cut_lineage(members.join(wanted, "cls", "left_semi").select("doc_id").distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return common.saved(_ordered_sets(base.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), sketch), "shingle-sets")


def _blocks(classes, shingles):
    """How many blocks so many classes and shingles make."""
    return F.ceil(F.greatest(classes / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: for each a, blocks of b's in a prefix tree that a's set walks."""
    spread = pairs.groupBy("a").agg(_blocks(F.count("*"), F.sum("n_b")).alias("blocks"))
    dealt = pairs.join(spread, "a").select("a", "b", F.pmod(F.hash("b"), "blocks").alias("block"))
    members = dealt.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "block", "b", "sequence")
    probes = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("cls", "a"), "a").select("a", "block", F.col("a").alias("b"), "sequence")

    def walk(key: tuple, t: pa.Table) -> pa.Table:
        a = key[0].as_py()
        tree, probe = PrefixTree([]), set()
        for b, s in zip(t.column("b").to_pylist(), t.column("sequence").to_pylist(), strict=True):
            sequence = np.frombuffer(s, "<u8").tolist()
            if a == b:
                probe = set(sequence)
            else:
                tree.add(sequence, b)
        found = tree.linked(probe)
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return members.unionByName(probes).groupBy("a", "block").applyInArrow(walk, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by alternating star contraction.

    A round is three shuffles of its edges and no join, as every plan, stage
    and broadcast takes memory of the driver, on small tables too.
    """
    least = F.min("v").over(Window.partitionBy("u"))
    edges = common.cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    total = None
    while True:
        # Large star: every larger neighbour moves to the least neighbour, or to the node itself.
        near = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        edges = near.withColumn("m", F.least(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours and the node itself move to the least of them; the edge to that one stands for the node.
        moved = edges.withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.cut_lineage(moved.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == total:
            break
        total = now
    return edges.select(
        F.col("u").alias("node"), F.col("v").alias("label"),
    ).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _compared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document ``doc_id, n, cls``; per class its smallest ``doc_id`` and number ``k``; and ``node, label``: the component of every class that has links."""
    spark = docs.sparkSession
    base = common.texts(docs, id_col, text_col)
    first = common.saved(_sets(base), "shingle-classes")
    sketch = spark.sparkContext.broadcast(_sketch(first))
    classes = first.where("counts is null").select("doc_id", "n", "cls")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One exchange serves the aggregation and the join; for that, the aggregation too reads every column.
    rows = _prefixes(base, sketch, max(SALTS, parts)).repartition(parts, "tok", "salt")
    centres = rows.groupBy("tok", "salt").agg(
        F.min("cls").alias("centre"), F.max("cls").alias("last"), F.min_by("n", "cls").alias("centre_n"), F.max("place").alias("_place"),
    ).where("_place >= 0").drop("_place")
    # Lengths that leave the threshold out of reach are told apart here, where both are known, not after the pairs are dealt.
    near = F.expr("4 * least(n, centre_n) >= 3 * greatest(n, centre_n)").alias("near")
    shared = common.saved(
        rows.join(centres.where("centre != last or salt != 0").drop("last"), ["tok", "salt"]).select("tok", "salt", "cls", "n", "place", "centre", near), "shared-shingles",
    )
    own = shared.where("cls != centre and near").select(F.col("centre").alias("a"), F.col("cls").alias("b"))
    # Only a salted shingle has several groups, and so several centres.
    tops = shared.where("salt != 0").select("tok", "centre").distinct()
    top = tops.groupBy("tok").agg(F.min("centre").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k")
    between = tops.join(top, "tok").where("a != centre").select("a", F.col("centre").alias("b"))
    prefixes = shared.groupBy("cls").agg(F.max("n").alias("n"), F.collect_set("tok").alias("toks"))  # dealt by the class alone, as its joins are
    pairs = _possible(own.union(between).distinct(), prefixes)

    # Counted before any join, so that the copies of one text never meet in one task.
    members = common.cut_lineage(classes.where("n > 0 and doc_id is not null").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("k"),
    ))
    label = components(_verify(pairs, _sets_of(pairs, members, base, sketch)))
    mixed = _mixed(shared, label, parts)
    if not mixed.isEmpty():
        big = common.cut_lineage(mixed.select("label", "cls", "n").distinct().groupBy("label").agg(
            F.count("*").alias("size"), F.sum("n").alias("shingles"),
        ).where(F.col("size") > LARGE))
        few = big.isEmpty()
        small = mixed if few else common.cut_lineage(mixed.join(_small(big.select("label")), "label", "left_anti"))
        groups = common.cut_lineage(small.groupBy("tok").agg(
            F.count("*").alias("k"), F.sum("n").alias("shingles"), F.min("label").alias("lo"), F.max("label").alias("hi"),
            F.bit_xor(F.xxhash64("cls")).alias("sum"),
        ).where("lo != hi"))
        rest = _possible(
            _remaining(small.join(groups.where(F.col("k") <= CROWD).select("tok"), "tok")).join(pairs, ["a", "b"], "left_anti"), prefixes,
        )
        more = _verify(rest, _sets_of(rest, members, base, sketch))
        walks = [] if few else [_large_blocks(mixed, big, parts)]
        # Shingles with the same classes, as those of one passage, are one crowd.
        crowds = common.cut_lineage(groups.where(F.col("k") > CROWD).groupBy("k", "shingles", "lo", "hi", "sum").agg(F.min("tok").alias("tok")))
        if not crowds.isEmpty():
            walks.append(_crowd_blocks(small, crowds))
        if walks:
            rows = common.cut_lineage(walks[0] if len(walks) == 1 else walks[0].unionByName(walks[1]))
            more = more.union(_walked(rows, _sets_of_classes(rows.select("cls").distinct(), members, base, sketch)))
        more = common.cut_lineage(more)
        if not more.isEmpty():
            # The components so far stand for the links that made them.
            label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    sketch.destroy()  # what is returned reads saved tables only
    return classes, members, label


def _firsts(per: DataFrame, label: DataFrame) -> DataFrame:
    """(class, first): of each class that isn't alone the smallest (doc_id, class) of its component."""
    marked = common.cut_lineage(per.join(
        label.withColumnRenamed("node", "cls"), "cls", "left",
    ).where("k > 1 or label is not null").withColumn("label", F.coalesce("label", "cls")))
    least = marked.groupBy("label").agg(F.min(F.struct("doc_id", "cls")).alias("first"))
    return common.cut_lineage(common.looked_up(marked.select("cls", "label"), least, "label").select("cls", "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    classes, per, label = _compared(docs, id_col, text_col)
    members = classes.where("n > 0 and doc_id is not null")
    linked = common.looked_up(members, _firsts(per, label), "cls").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"),
    )
    return linked.union(classes.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
    ))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, that of the smallest id (of several texts with that id: the smallest class).

    Rows without words and rows of a null id stay; of rows with the same id
    and the same shingles one stays, and rows with the same id and other
    texts are judged by their own texts.
    """
    classes, per, label = _compared(docs, id_col, text_col)
    members = classes.where("n > 0 and doc_id is not null")
    gone = common.looked_up(members, _firsts(per, label), "cls").where("first is not null and (doc_id != first.doc_id or cls != first.cls)").select("doc_id", "cls").distinct()
    gone = common.cut_lineage(gone)
    again = common.cut_lineage(members.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    to_id = lambda x: x.select(F.col("doc_id").alias(id_col)).distinct()
    if again.isEmpty():
        return docs.join(_small(to_id(gone)), id_col, "left_anti").select(*docs.columns)
    # Ids with several rows: only those need their class looked at again.
    name = common.free_name(docs, "cls")
    once = docs.join(_small(to_id(gone.unionByName(again.withColumn("cls", F.lit(0).cast("bigint"))))), id_col, "left_anti")
    rows = _with_class(docs.join(_small(to_id(again)), id_col, "left_semi").select(*docs.columns), text_col, name)
    lost = gone.join(again, "doc_id", "left_semi").select(F.col("doc_id").alias(id_col), F.col("cls").alias(name))
    kept = rows.where(F.col(name).isNotNull()).join(lost, [id_col, name], "left_anti").dropDuplicates([id_col, name])
    return once.select(*docs.columns).union(kept.select(*docs.columns)).union(rows.where(F.col(name).isNull()).select(*docs.columns))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _with_class(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with its class in the column ``name``; NULL where the text has no words."""
    from pyspark.sql.types import LongType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [class_of(s) if len(s := shingle_set(x or "")) else None for x in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, LongType()))


def _mixed(shared: DataFrame, label: DataFrame, parts: int) -> DataFrame:
    """The rows, with their component, that meet a row of another component within the bounds on lengths and places.

    At the first shingle that two sets share, in the global order, they have at
    most as many in common as the rest of either; so two that link are both kept there.
    """
    # As above, one exchange (and the join before it) serves the aggregation and the join, so the aggregation reads every column.
    marked = shared.select("tok", "cls", "n", "place").join(
        label.withColumnRenamed("node", "cls"), "cls", "left",
    ).withColumn("label", F.coalesce("label", "cls")).where(
        "tok is not null and n is not null and place is not null and label is not null",  # as the join asks of its left side: one exchange for both
    ).repartition(parts, "tok")
    # Of each length the two components whose rows reach the farthest: one of them is another than the row's own.
    far = marked.groupBy("tok", F.col("n").alias("m"), F.col("label").alias("other")).agg(
        F.max(F.expr(REACH)).alias("reach"), F.max("cls").alias("_cls"),
    ).where("_cls is not null").drop("_cls")
    order = Window.partitionBy("tok", "m").orderBy(F.desc("reach"), "other")
    far = far.withColumn("i", F.row_number().over(order)).where("i <= 2").select(F.col("tok").alias("t"), "m", "other", "reach")
    met = F.expr(f"tok = t and label != other and 4 * least(n, m) >= 3 * greatest(n, m) and m <= {REACH} and n <= reach")
    # A class with copies in several tasks came once from each.
    return common.cut_lineage(marked.join(far, met, "left_semi").distinct())


def _remaining(mixed: DataFrame) -> DataFrame:
    """All pairs of different components that the bounds on lengths and places allow."""
    x, y = mixed.alias("x"), mixed.alias("y")
    # y is the smaller (ties: by class); its place lies in the shorter prefix that suffices there.
    smaller = F.expr("(y.n < x.n or (y.n = x.n and y.cls < x.cls)) and x.label != y.label and 4 * y.n >= 3 * x.n and y.place < y.n - int(ceil(6 * y.n / 7.0D)) + 1")
    bound = F.expr("7 * least(x.n - x.place, y.n - y.place) >= 3 * (x.n + y.n)")
    return x.join(y, F.expr("x.tok = y.tok") & smaller & bound).select(
        F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"),
    ).distinct()


def _large_blocks(mixed: DataFrame, big: DataFrame, parts: int) -> DataFrame:
    """Rows of :func:`_walked`: the blocks of each large component, and of the other classes that share a group with it.

    A class is sent once to each block, however many shingles it shares with it.
    """
    at = mixed.select("tok", "label").repartition(parts, "tok").distinct()  # dealt once, as the join below needs it
    large = at.join(_small(big.select("label")), "label").withColumnRenamed("label", "big")
    met = large.join(at, "tok").where("label != big").select("big", "label").distinct()
    own = mixed.select("label", "cls", "n").distinct()
    probes = common.cut_lineage(met.join(own, "label"))
    sizes = probes.groupBy("big").agg(_blocks(F.count("*"), F.sum("n")).alias("probe_blocks"))
    sizes = sizes.join(big.select(F.col("label").alias("big"), _blocks(F.col("size"), F.col("shingles")).alias("tree_blocks")), "big")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    trees = own.withColumnRenamed("label", "big").join(sizes, "big").select(
        F.col("big").alias("g"), F.pmod(F.hash("cls"), "tree_blocks").alias("i"), each("probe_blocks").alias("j"), "cls",
        F.col("big").alias("label"), F.lit(False).alias("probe"),
    )
    asked = probes.join(sizes, "big").select(
        F.col("big").alias("g"), each("tree_blocks").alias("i"), F.pmod(F.hash("cls"), "probe_blocks").alias("j"), "cls", "label",
        F.lit(True).alias("probe"),
    )
    return trees.unionByName(asked)


def _crowd_blocks(small: DataFrame, crowds: DataFrame) -> DataFrame:
    """Rows of :func:`_walked`: each two blocks of the classes of a crowded group, one as a tree and one as probes."""
    rows = small.join(
        _small(crowds.select("tok", _blocks(F.col("k"), F.col("shingles")).alias("blocks"))), "tok",
    ).withColumn("own", F.pmod(F.hash("cls"), "blocks"))
    row = [F.col("tok").alias("g"), "i", "j", "cls", "label", "probe"]
    trees = rows.withColumn("i", F.col("own")).withColumn(
        "j", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)),
    ).withColumn("probe", F.lit(False))
    probes = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumn("j", F.col("own")).withColumn("probe", F.lit(True))
    return trees.select(*row).unionByName(probes.select(*row))


def _walked(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the probes of each (g, i, j) with its tree; one for each probe and other component."""

    def walk(t: pa.Table) -> pa.Table:
        tree, of, members, queries, a, b = PrefixTree([]), {}, [], [], [], []
        for cls, label, probe, raw in zip(*(t.column(c).to_pylist() for c in ("cls", "label", "probe", "sequence")), strict=True):
            sequence = np.frombuffer(raw, "<u8")
            if probe:
                queries.append((cls, label, sequence))
            else:
                tree.add(sequence.tolist(), cls)
                of[cls] = label
                members.append(sequence)
        if members and queries:
            found = {}
            for i, x in tree.linked_all([s for _, _, s in queries], np.unique(np.concatenate(members))):
                if of[x] != queries[i][1]:
                    found[i, of[x]] = x
            a, b = [queries[i][0] for i, _ in found], list(found.values())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.join(sets, "cls").select(
        "g", "i", "j", "cls", "label", "probe", "sequence",
    ).groupBy("g", "i", "j").applyInArrow(walk, "a bigint, b bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.dealt(common.table(spark, sf_dir, "documents")))


#: The same in DuckDB: sets as rows, links by counting common shingles of the first document of each class, components by reachability.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {N - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS c FROM s GROUP BY doc_id),
r AS (SELECT c, min(doc_id) AS r, min(n) AS n FROM c GROUP BY c),
t AS (SELECT r, n, s FROM r JOIN s ON s.doc_id = r.r),
k AS (SELECT a.r AS x, b.r AS y FROM t a JOIN t b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
reach AS (SELECT r AS x, r AS y FROM r UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
m AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT c.doc_id, c.n AS n_shingles, m.y AS component_id FROM c JOIN r ON c.c = r.c JOIN m ON m.x = r.r
UNION ALL SELECT doc_id, 0, doc_id FROM w WHERE len(w) = 0
"""
