"""Writers: partitioned and resumable Parquet, CSV, reports, manifests, conforming submissions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(frame: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table; with partition columns only the partitions that the frame holds."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def finished(spark: SparkSession, path: str, column: str) -> set[str]:
    """Values of a partition column that a table already has; none if there is no table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    return {n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")}


def run_missing(spark: SparkSession, path: str, column: str, keys: Iterable[str], make: Callable[[str], DataFrame]) -> list[str]:
    """Make and write the partitions that are not there yet; the commit protocol leaves no half of one behind."""
    done = finished(spark, path, column)
    todo = [k for k in keys if str(k) not in done]
    for key in todo:
        write_parquet(make(key).withColumn(column, F.lit(str(key))), path, partition_by=[column])
    return todo


def markdown(frame: DataFrame, most: int = 10_000) -> str:
    """A report table of an aggregated frame; one of more than ``most`` rows is no report and is refused."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; aggregate it first")
    lines = ["| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])


def manifest(frame: DataFrame, sources: Iterable[str], settings: dict) -> dict:
    """What a run was made of: digests of its sources and of its sorted feature names, and its settings."""
    code = hashlib.sha256("\0".join(sorted(sources)).encode()).hexdigest()
    names = hashlib.sha256(",".join(sorted(frame.columns)).encode()).hexdigest()
    return {"code": code, "features": names, "n_features": len(frame.columns), "settings": dict(sorted(settings.items()))}


def assert_comparable(base: dict, treatment: dict) -> None:
    """A comparison needs runs that differ in something."""
    if base == treatment:
        raise ValueError("the two runs are the same; there is nothing to compare")


def conform(template: DataFrame, predictions: DataFrame, *, id_col: str, value_col: str) -> DataFrame:
    """The template's ids with predictions, rounded half to even.

    Refused with the counts of ``check_submission`` if a prediction is missing, null, negative or repeated.
    """
    issues = {r["issue"]: r["n"] for r in check_submission(template, predictions, id_col=id_col, value_col=value_col).collect()}
    if wrong := {k: n for k, n in issues.items() if n and k != "extra"}:
        raise ValueError(f"predictions don't conform to the template: {wrong}")
    joined = template.select(id_col).join(predictions.select(id_col, value_col), id_col, "left")
    return joined.select(id_col, F.bround(value_col, 0).cast("int").alias(value_col))


def write_submission(template: DataFrame, predictions: DataFrame, path: str, *, id_col: str, value_col: str) -> None:
    """A checked submission as one table in the template's ids."""
    write_parquet(conform(template, predictions, id_col=id_col, value_col=value_col), path)


def reuse(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made and written only if it isn't there; a write that didn't finish doesn't count."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        write_parquet(make(), path)
    return spark.read.parquet(path)


def report(sections: dict[str, DataFrame], *, title: str, facts: dict[str, object] | None = None) -> str:
    """A report: a title, named facts, and a table per section."""
    lines = [f"# {title}", ""] + [f"* {k}: {v}" for k, v in (facts or {}).items()]
    for name, frame in sections.items():
        lines += ["", f"## {name}", "", markdown(frame)]
    return "\n".join(lines) + "\n"


def check_submission(template: DataFrame, predictions: DataFrame, *, id_col: str, value_col: str) -> DataFrame:
    """Counts that have to be zero, as rows ``(issue, n)``: missing, extra, null, negative and repeated predictions."""
    p = predictions.select(id_col, value_col)
    own = template.select(id_col)
    count = F.count(F.lit(1))

    def named(frame: DataFrame, issue: str, n=count) -> DataFrame:
        return frame.agg(n.cast("bigint").alias("n")).select(F.lit(issue).alias("issue"), "n")

    return (
        named(own.join(p, id_col, "left_anti"), "missing")
        .unionByName(named(p.join(own, id_col, "left_anti"), "extra"))
        .unionByName(named(p, "null", F.count_if(F.col(value_col).isNull())))
        .unionByName(named(p, "negative", F.count_if(F.col(value_col) < 0)))
        .unionByName(named(p, "repeated", count - F.count_distinct(id_col)))
    )
