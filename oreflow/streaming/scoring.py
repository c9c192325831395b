"""Row-wise operators run unchanged on a stream; fitted models score it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_folder(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``steps`` to each batch of ``stream`` and append to Parquet, each row once; stops when the input is used up."""
    for step in steps:
        stream = step(stream)
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
