"""Where intermediate results go: the shared checkpoint folder of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnpike.operators.store import ensure_folder

#: Rows that one checkpoint file should hold at least, where their number is known.
ROWS_A_FILE = 50_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one uses its warehouse."""
    return ensure_folder(spark)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage; lost executors cost no recomputation.

    ``rows`` is an upper bound of its rows where one is known: few rows then go to few files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if rows is not None:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(1, min(most, -(-rows // ROWS_A_FILE))))
    return df.checkpoint(eager=True)
