"""The shared checkpoint folder of the session: cuts in a lineage, and tables that a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a local session uses its warehouse; a cluster has to name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared one."""
    return f"{ensure_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage; lost executors cost no recomputation."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)
