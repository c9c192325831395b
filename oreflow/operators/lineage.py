"""Rows kept in the shared folder, so that later steps read the same rows in the same layout."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, in a folder of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and sc.master.split("[")[0] != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)
