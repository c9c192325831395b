"""Helpers that the operators share: the shared folder, saved tables, text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in the word-based contracts.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine (tests), one of our own;
    on a cluster a missing folder is an error, as a local one is not shared.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``table``, which has one row for each key.

    Keys with over 100 rows and over a ten-thousandth of all rows, at most
    10,000 keys, are looked up in a broadcast table, so no hot key is one task;
    the others are shuffled.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("__k"))
    total, most = counts.agg(F.sum("__k"), F.max(F.when(F.col(key).isNotNull(), F.col("__k")))).first()
    least = max(100, (total or 0) // 10_000)
    if (most or 0) <= least:
        return rows.join(table, key, "left")
    heavy = cut_lineage(counts.where(F.col("__k") > least).join(table, key).drop("__k"))
    if heavy.isEmpty():
        return rows.join(table, key, "left")
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table, key, "left")
    return hot.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt out evenly where they lie in fewer partitions than half the cores, as in one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return df.repartition(cores) if 2 * parts < cores else df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text; a null text is the empty text."""
    # No alias without need: plans that differ by one don't share an exchange.
    own = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    return docs.select(own, F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that take batches and yield columns as a dict of lists or arrays."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, schema)


_kept: list[Callable[[], None]] = []


def keeps(clear: Callable[[], None]) -> None:
    """Tells how to empty what an operator keeps in a worker between tasks."""
    _kept.append(clear)


def forget() -> None:
    """Empties what the tasks of earlier stages left in this worker; for tasks that need the room and none of it."""
    for clear in _kept:
        clear()
    release()


def release() -> None:
    """Gives unused memory back at the end of a task, Arrow's and the C library's: Spark keeps its Python workers for the next stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        trim(0)
