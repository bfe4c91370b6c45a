"""The folder that driver and executors share: rows kept there survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of this machine only where all of Spark runs on it, as in tests."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestream-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def saved(rows: DataFrame) -> DataFrame:
    """The rows, kept in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
