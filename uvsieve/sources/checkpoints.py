"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that all executors share: ``spark.checkpoint.dir``, or where that is unset and the master is local, a temporary folder."""
    _ensure(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    _ensure(df.sparkSession)
    return df.checkpoint(eager=True)


def _ensure(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
