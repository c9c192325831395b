"""CSV in and out.

Every split of a file is parsed in its right state: a quote opens or closes a
quoted stretch wherever it stands, so whether a split begins inside one is the
parity of the quotes before it.  One pass counts the quotes of each split, a
prefix sum gives the states, and a second pass parses; a record that goes on
in later splits is put together from its pieces, one group for each such
record.  Rows have places in file order (files by name), also without sorting.

A column is a number if every non-blank cell of the whole file is one; blank
cells are NULL; blank lines are no rows; headers are trimmed, blank ones become
Field<i>, repeated ones get _2, _3...  Missing cells are NULL, cells beyond the
header are dropped.  Lines end in a line feed, a carriage return or both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreflow.functions import rng
from oreflow.functions.values import as_text, col, cols, looks_numeric
from oreflow.operators.lineage import kept

DELIMITERS = (",", ";", "\t", "|")
#: Bytes in which the header is looked for first.
HEAD = 1 << 16


def header_names(raw: list[str | None]) -> list[str]:
    out: list[str] = []
    for i, x in enumerate(raw):
        name = (x or "").strip().removeprefix("﻿") or f"Field{i + 1}"
        base, k = name, 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def sniff(line: str) -> str:
    """The delimiter that splits the first line most; ties by the order of :data:`DELIMITERS`."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def cells(record: str, delimiter: str) -> list[list[str]]:
    """The rows of a text that ends outside quotes; mostly one, more where a lone carriage return ends a line."""
    if '"' not in record and "\r" not in record and "\n" not in record:
        return [record.split(delimiter)]
    rows: list[list[str]] = []
    row: list[str] = []
    own: list[str] = []
    # Between quotes all is text, but for nothing between two quotes inside quotes: that is a quote.
    parts = record.split('"')
    for k, part in enumerate(parts):
        if k % 2:
            own.append(part)
            continue
        if k and not part and k < len(parts) - 1:
            own.append('"')
            continue
        lines = part.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for i, line in enumerate(lines):
            if i:
                rows.append([*row, "".join(own)])
                row, own = [], []
            first, *rest = line.split(delimiter)
            own.append(first)
            for x in rest:
                row.append("".join(own))
                own = [x]
    if row or "".join(own) or not rows:
        rows.append([*row, "".join(own)])
    return rows


def _filled(rows: list[list[str]]) -> list[list[str]]:
    return [r for r in rows if len(r) > 1 or r[0].strip()]


class Piece:
    """Takes the lines of one split, given whether it begins inside quotes; gives its rows and what it shares with others."""

    def __init__(self, delimiter: str, end: str, first: bool, inside: bool):
        self.delimiter, self.end, self.header, self.odd = delimiter, end, first, inside
        self.head: str | None = None  # the end of a record that began before
        self.closed = False
        self.lines: list[str] = []
        self.fresh = not inside

    def add(self, line: str) -> list[list[str]]:
        """Rows that end with this line."""
        self.lines.append(line)
        if line.count('"') % 2:
            self.odd = not self.odd
        if self.odd:
            return []
        whole, self.lines = self.end.join(self.lines), []
        if not self.fresh:
            self.head, self.closed, self.fresh = whole, True, True
            return []
        if self.end == "\n" and whole.endswith("\r"):
            whole = whole[:-1]
        return self.body(_filled(cells(whole, self.delimiter)))

    def body(self, rows: list[list[str]]) -> list[list[str]]:
        if self.header and rows:
            self.header = False
            return rows[1:]
        return rows

    def rest(self) -> str | None:
        """The begin of a record that goes on in later splits (or the whole split, if it is all inside one)."""
        whole = self.end.join(self.lines) if self.lines else None
        if not self.fresh:
            self.head, self.closed = whole, False
            return None
        return whole


def _lines(spark: SparkSession, path: str, end: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep=end).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")


def _head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file of any store that Spark reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def _header(spark: SparkSession, file: str) -> tuple[list[str], str, str]:
    """The names, the delimiter and the line's end of the file."""
    size = HEAD
    while True:
        raw = _head(spark, file, size)
        text = raw.decode("utf-8", "replace").removeprefix("﻿")
        end = "\r" if "\r" in text.rstrip("\r") and "\n" not in text else "\n"
        delimiter = sniff(text.replace("\r", "\n").split("\n", 1)[0])
        piece = Piece(delimiter, end, False, False)
        lines = text.split(end)
        for line in lines if len(raw) < size else lines[:-1]:
            if rows := piece.add(line):
                return header_names(rows[0]), delimiter, end
        if len(raw) < size:
            raise ValueError("There is no header: the file has no filled line.")
        size *= 16


def _rows(spark: SparkSession, path: str, names: list[str], wanted: list[str], delimiter: str, end: str) -> DataFrame:
    """``__pos`` and the ``wanted`` cells as text of every row, in file order."""
    lines = _lines(spark, path, end)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    splits = kept(lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd")))  # a row for each split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = splits.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    at = [names.index(c) for c in wanted]
    columns = [f"c{i}" for i in range(len(at))]
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("raw", pa.string()), *[(c, pa.string()) for c in columns],
    ])
    kinds = "file string, block bigint, seq bigint, kind int, raw string" + "".join(f", {c} string" for c in columns)

    def told(file: str, block: int, seq: int, rows: list[list[str]], pieces: list[tuple[int, str]] = ()) -> pa.RecordBatch:
        """Rows (kind 0), heads that end (1) or don't (2), and tails (3; 4 where the split has no other row)."""
        n, m = len(rows), len(pieces)
        none = [None] * m
        return pa.RecordBatch.from_arrays([
            pa.array([file] * (n + m)), pa.array([block] * (n + m), pa.int64()), pa.array([*range(seq, seq + n), *[seq + n] * m], pa.int64()),
            pa.array([0] * n + [k for k, _ in pieces], pa.int32()), pa.array([None] * n + [x for _, x in pieces], pa.string()),
            *[pa.array([r[i] if i < len(r) else None for r in rows] + none, pa.string()) for i in at],
        ], schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece, seq = None, None, 0

        def finish() -> pa.RecordBatch:
            tail = piece.rest()
            pieces = [(1 if piece.closed else 2, piece.head)] if piece.head is not None else []
            return told(*key, seq, [], pieces + ([(4 if piece.header else 3, tail)] if tail is not None else []))

        for b in batches:
            found: list[list[str]] = []
            for file, block, inside, line in zip(*(b.column(c).to_pylist() for c in ("file", "block", "inside", "value")), strict=True):
                if key != (file, block):
                    if key is not None:
                        yield told(*key, seq, found)
                        seq += len(found)
                        yield finish()
                    key, piece, seq, found = (file, block), Piece(delimiter, end, block == 0, inside), 0, []
                    if block == 0:
                        line = line.removeprefix("﻿")
                found += piece.add(line)
            if key is not None and found:
                yield told(*key, seq, found)
                seq += len(found)
        if key is not None:
            yield finish()

    parsed = kept(lines.join(F.broadcast(states), ["file", "block"]).mapInArrow(parse, kinds))
    # A tail and the heads behind it, up to the one that ends, are one record.
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)  # some rows for each split
    pieces = parsed.where("kind > 0").select("file", "block", "seq", "kind", "raw", F.sum((F.col("kind") >= 3).cast("int")).over(order).alias("record"))
    whole = pieces.groupBy("file", "record").agg(
        F.min(F.struct("block", F.col("seq"), "kind")).alias("at"), F.array_sort(F.collect_list(F.struct("block", "kind", "raw"))).alias("parts"),
    ).where("at.kind >= 3").select("file", "at.block", "at.seq", "at.kind", F.array_join(F.transform("parts", lambda p: p["raw"]), end).alias("raw"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, seq, kind, raw in zip(*(b.column(c).to_pylist() for c in ("file", "block", "seq", "kind", "raw")), strict=True):
                # An open quote at the end of the file is closed there.
                raw = raw + '"' * (raw.count('"') % 2)
                rows = _filled(cells(raw.removesuffix("\r") if end == "\n" else raw, delimiter))
                yield told(file, block, seq, rows[1:] if kind == 4 else rows)

    rows = parsed.where("kind = 0").unionByName(kept(whole.mapInArrow(joined, kinds)))
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    placed = rows.join(F.broadcast(starts), ["file", "block"])
    return placed.select((F.col("start") + F.col("seq")).alias("__pos"), *[F.col(c).alias(w) for c, w in zip(columns, wanted, strict=True)])


def infer_types(df: DataFrame, among: list[str] | None = None) -> DataFrame:
    """All-text columns to numbers where every non-blank cell is one: a single aggregation decides for all."""
    own = df.columns if among is None else among
    filled = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    verdict = df.agg(*[F.coalesce(F.min(F.when(filled(c).isNotNull(), looks_numeric(col(c)).cast("int"))), F.lit(0)).alias(f"v{i}") for i, c in enumerate(own)]).first()
    typed = {c: filled(c).try_cast("double") if verdict[i] else F.when(filled(c).isNotNull(), col(c)) for i, c in enumerate(own)}
    return df.select(*[typed.get(c, col(c)).alias(c) for c in df.columns])


def _check_size(df: DataFrame, max_bytes: int) -> None:
    """An error if the rows, written as CSV, have more UTF-8 bytes than ``max_bytes``."""
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.octet_length(F.replace(c, F.lit('"'), F.lit('""'))) + 2).otherwise(F.octet_length(c))
    size_of = sum((F.coalesce(quoted(as_text(df, c)), F.lit(0)) for c in df.columns), F.lit(len(df.columns)))  # and a separator or line's end each
    size = len(",".join(df.columns).encode()) + (df.agg(F.sum(size_of)).first()[0] or 0)
    if size > max_bytes:
        raise ValueError(f"The rows to keep take {size} bytes as CSV, over the {max_bytes} allowed; take fewer rows or columns.")


def read_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int | None = None, mode: str = "first", seed: int = 1,
    max_bytes: int | None = None, place: str | None = None,
) -> DataFrame:
    """CSV with a header: a file, a folder or a pattern of them.

    ``max_rows`` are the first ones in file order or, with ``mode`` ``sample``,
    a reservoir over that order; ``place`` names a field for each row's 0-based
    place among all rows, by which later steps may order.
    """
    if mode not in ("first", "sample"):
        raise ValueError(f"Rows are taken by first or sample, not {mode}.")
    file = spark.read.text(path).select(F.min("_metadata.file_path")).first()[0]
    if file is None:
        raise ValueError("There is no header: the file has no filled line.")
    names, delimiter, end = _header(spark, file)
    wanted = list(columns or names)
    for c in wanted:
        if c not in names:
            raise ValueError(f"The header lacks {c}.")
    rows = _rows(spark, path, names, wanted, delimiter, end)
    if max_rows is not None:
        if mode == "first":
            rows = rows.where(F.col("__pos") < max_rows)
        else:
            # The last row drawn for a slot stays, as in one pass over the rows.
            p = F.col("__pos")
            slot = F.when(p < max_rows, p).otherwise(F.floor(rng.uniform(seed, p - max_rows) * (p + 1)))
            rows = rows.withColumn("__slot", slot).where(F.col("__slot") < max_rows)
            rows = rows.groupBy("__slot").agg(F.max_by(F.struct("__pos", *cols(wanted)), "__pos").alias("__row")).select("__row.*")
        rows = kept(rows)
    out = infer_types(rows, wanted)
    out = out.select(*cols(wanted), *([F.col("__pos").alias(place)] if place else []))
    if max_bytes is not None:
        _check_size(out.select(*cols(wanted)), max_bytes)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Numbers in their short form, missing values empty, quotes where needed; one folder of part files."""
    df.select(*[as_text(df, c).alias(c) for c in df.columns]).write.csv(path, header=True, nullValue="", emptyValue="", quote='"', escape='"')
