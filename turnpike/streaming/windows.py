"""Structured Streaming twins of the binned and sessionised operators. The batch operators stay the reference for results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def config_bins(stream: DataFrame, *, ts: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Active runways and counts by phase per airport and tumbling window; rows later than the watermark are dropped."""
    runways = F.array_join(F.sort_array(F.collect_set("runway")), "+")
    grouped = stream.withWatermark(ts, late).groupBy("airport", F.window(ts, width).alias("w"))
    agg = grouped.agg(
        F.when(runways == "", "?").otherwise(runways).alias("config"),
        F.count_if(F.col("phase") == "DEP").alias("n_dep"),
        F.count_if(F.col("phase") == "ARR").alias("n_arr"),
    )
    return agg.select("airport", F.col("w.start").alias("bin_start"), "config", "n_dep", "n_arr")


def rolling_counts(stream: DataFrame, *, ts: str = "ts", late: str = "10 minutes", width: str = "30 minutes", slide: str = "5 minutes") -> DataFrame:
    """Movements per airport in sliding windows, the streaming form of a rolling count on a grid."""
    agg = stream.withWatermark(ts, late).groupBy("airport", F.window(ts, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select("airport", F.col("w.end").alias("at"), "n")


def sessions(stream: DataFrame, *, ts: str = "ts", late: str = "10 minutes", gap: str = "20 minutes") -> DataFrame:
    """Runs of one track without a gap over ``gap``."""
    agg = stream.withWatermark(ts, late).groupBy("user_id", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n")
