"""Fitted tables: priors, smoothed and out-of-fold encodings, category codes. All stay DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnpike.operators.evaluate import quantiles


# The quantile and the plausible seconds of an unimpeded taxi.
PRIOR_QUANTILE, TAXI_LEAST, TAXI_MOST = 0.2, 60, 5400


def group_prior(rows: DataFrame, keys: Sequence[str], value: str, *, low: float, high: float, q: float = PRIOR_QUANTILE) -> DataFrame:
    """Nearest ``q`` quantile (``prior``), ``median`` and count ``n`` of the values in [low, high] for each key."""
    kept = rows.where(F.col(value).between(low, high))
    found = quantiles(kept, value, [q, 0.5], by=keys, method=["nearest", "linear"])
    return found.select(*keys, F.col("q")[0].alias("prior"), F.col("q")[1].alias("median"), "n")


#: Levels of priors, finest first: name, keys, whether the median and the count are kept.
PRIOR_LEVELS = (
    ("stand", ("airport", "stand"), True, True),
    ("sg_rwy", ("airport", "stand_group", "runway"), False, True),
    ("rwy", ("airport", "runway"), True, False),
    ("airport", ("airport",), True, False),
)


def fit_priors(labelled: DataFrame) -> dict[str, DataFrame]:
    """Unimpeded and median taxi times of labelled departures (``airport, stand, stand_group, runway, taxi``) at four levels.

    Fit on training rows only. All levels stay DataFrames.
    """
    found = {}
    for name, keys, has_median, has_count in PRIOR_LEVELS:
        prior = group_prior(labelled, keys, "taxi", low=TAXI_LEAST, high=TAXI_MOST)
        more = [F.col("median").alias(f"med_{name}")] * has_median + [F.col("n").alias(f"n_{name}")] * has_count
        found[name] = prior.select(*keys, F.col("prior").alias(f"unimp_{name}"), *more)
    return found


def apply_priors(rows: DataFrame, priors: dict[str, DataFrame]) -> DataFrame:
    """Rows with ``unimpeded_taxi`` and ``median_taxi_prior`` of the finest level that knows their keys, and the counts behind (0 where unknown)."""
    out = rows
    for name, keys, _, _ in PRIOR_LEVELS:
        out = out.join(priors[name], list(keys), "left")
    levels = [name for name, *_ in PRIOR_LEVELS]
    medians = [name for name, _, has, _ in PRIOR_LEVELS if has]
    counts = [f"n_{name}" for name, *_, has in PRIOR_LEVELS if has]
    chosen = {"unimpeded_taxi": F.coalesce(*[f"unimp_{n}" for n in levels]), "median_taxi_prior": F.coalesce(*[f"med_{n}" for n in medians])}
    return out.select(*[F.col(c) for c in rows.columns], *[c.alias(n) for n, c in chosen.items()], *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def smoothed(rows: DataFrame, *, group: Sequence[str], parent: Sequence[str], target: Column, weight: float = 30.0) -> DataFrame:
    """``(n * own mean + weight * parent mean) / (n + weight)`` for each group within its parent."""
    frame = rows.withColumn("_y", target).where(F.col("_y").isNotNull())
    parents = frame.groupBy(*parent).agg(F.avg("_y").alias("_m"))
    groups = frame.groupBy(*dict.fromkeys([*parent, *group])).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_s"))
    joined = groups.join(parents, list(parent))
    return joined.select(*dict.fromkeys([*parent, *group]), "n", ((F.col("_s") + weight * F.col("_m")) / (F.col("n") + weight)).alias("enc"))


def apply_smoothed(rows: DataFrame, table: DataFrame, parents: DataFrame, *, keys: Sequence[str], parent: Sequence[str]) -> DataFrame:
    """The group's encoding, else the parent's mean with n = 0."""
    joined = rows.join(table.select(*keys, "n", "enc"), list(keys), "left").join(parents.select(*parent, "mean"), list(parent), "left")
    return joined.withColumn("enc", F.coalesce("enc", "mean")).withColumn("n", F.coalesce("n", F.lit(0))).drop("mean")


def out_of_fold(rows: DataFrame, *, group: Sequence[str], parent: Sequence[str], fold: str, target: Column, weight: float = 30.0) -> DataFrame:
    """Encodings of each group for each fold, from the other folds only: totals less the fold's own sums.

    One pass of partial sums, whatever the number of folds. A group seen in no other fold gets the parent's mean over
    the other folds with n = 0, null where that is unknown too.
    """
    keys = list(dict.fromkeys([*parent, *group]))
    frame = rows.withColumn("_y", target).where(F.col("_y").isNotNull())
    own = frame.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"))
    totals = own.withColumn("_tn", F.sum("_n").over(Window.partitionBy(*keys))).withColumn("_ts", F.sum("_s").over(Window.partitionBy(*keys)))
    by_parent = own.groupBy(*parent, fold).agg(F.sum("_n").alias("_pn"), F.sum("_s").alias("_ps"))
    every = Window.partitionBy(*parent)
    by_parent = by_parent.withColumn("_on", F.sum("_pn").over(every) - F.col("_pn")).withColumn("_os", F.sum("_ps").over(every) - F.col("_ps"))
    by_parent = by_parent.select(*parent, fold, F.try_divide("_os", "_on").alias("parent_mean"))
    joined = totals.join(by_parent, [*parent, fold])
    n = F.col("_tn") - F.col("_n")
    return joined.select(*keys, fold, n.alias("n"), ((F.col("_ts") - F.col("_s") + weight * F.col("parent_mean")) / (n + weight)).alias("enc"))


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """Sorted vocabulary of a column, numbered from 0. A vocabulary is small beside its rows and is made by a distinct first."""
    words = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return words.withColumn("code", (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint"))


def encode(rows: DataFrame, vocabulary: DataFrame, column: str, out: str) -> DataFrame:
    """Codes of a column by a vocabulary; -1 for null and unseen values."""
    side = vocabulary.select(F.col(column).alias("_w"), F.col("code").alias("_c"))
    return rows.join(side, F.col(column) == F.col("_w"), "left").withColumn(out, F.coalesce("_c", F.lit(-1))).drop("_w", "_c")


def feature_columns(frame: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Columns that may be features: not excluded, no clocks or dates."""
    return [f.name for f in frame.schema if f.name not in excluded and not f.dataType.typeName().startswith(("timestamp", "date"))]


def model_matrix(frame: DataFrame, excluded: Sequence[str], vocabularies: dict[str, DataFrame]) -> DataFrame:
    """Feature columns alone: booleans as 0 and 1, texts as codes of their vocabulary (-1 unknown), clocks and excluded columns left out."""
    out = frame
    for name, vocabulary in vocabularies.items():
        out = encode(out, vocabulary, name, name)
    kinds = dict(out.dtypes)
    return out.select(*[F.col(c).cast("tinyint").alias(c) if kinds[c] == "boolean" else F.col(c) for c in feature_columns(out, excluded) if kinds[c] != "string"])


def assert_no_leak(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> None:
    """Training and test rows must not share a key."""
    if not train.join(test, list(keys), "left_semi").isEmpty():
        raise ValueError("training and test rows overlap")
