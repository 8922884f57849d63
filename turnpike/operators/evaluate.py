"""Error metrics, slices, deciles, variance decomposition, paired cluster bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnpike.functions.exprs import hash_draw
from turnpike.operators.store import cut


def metrics(error: Column) -> list[Column]:
    """RMSE, MAE, bias and count of an error: aggregates."""
    return [F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"), F.count(error).alias("n")]


def slices(rows: DataFrame, key: str, error: Column) -> DataFrame:
    """Metrics by slice and each slice's share of the total squared error."""
    agg = rows.groupBy(key).agg(*metrics(error), F.sum(error * error).alias("sse"))
    return agg.withColumn("share", F.col("sse") / F.sum("sse").over(Window.partitionBy()))


def positions(rows: DataFrame, order: Sequence[str | Column], *, chunk: Column, chunks_order: str = "chunk") -> DataFrame:
    """0-based global position ``pos`` and total ``total`` without one task for all rows.

    ``chunk`` is a coarse, monotone function of the leading order column; rows are numbered inside chunks and shifted
    by the running count of the chunks before, of which there are few.
    """
    frame = rows.withColumn("chunk", chunk)
    counts = frame.groupBy("chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(chunks_order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("chunk").alias("_c"), before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("chunk").orderBy(*order)) - 1
    joined = frame.withColumn("_in", inside).join(shifts, F.col("chunk").eqNullSafe(F.col("_c")))
    return joined.withColumn("pos", F.col("_before") + F.col("_in")).drop("_c", "_before", "_in", "chunk")


#: Accuracy of the rough quantiles that bracket an exact one; groups of fewer rows are ordered whole.
ACCURACY = 10_000
#: Groups up to which their brackets are broadcast.
BROADCAST_GROUPS = 10_000


def quantiles(rows: DataFrame, value: str, qs: Sequence[float], *, by: Sequence[str] = (), method: str | Sequence[str] = "linear", accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles of the non-nulls by group: ``by``, ``n`` and an array ``q`` in the order of ``qs``.

    ``linear`` interpolates between the neighbours of q * (n - 1), ``nearest`` takes the element at its rounding; one method
    for all or one for each. Rough
    quantiles, aggregated in bounded memory, bracket each exact one; values below a bracket are only counted and those
    inside, some thousandths of a group, are ordered by distinct value. So no buffer holds a group's values. Rough
    quantiles depend on the order in which partial ones arrive, so they are computed once, into the shared folder, and a
    bracket that turns out to miss its quantile is opened. A group without values gives no row.
    """
    frame = rows.where(F.col(value).isNotNull()).select(F.struct(*by, F.lit(0).alias("_one")).alias("_key"), F.col(value).cast("double").alias("_v"))
    reach = 3.0 / accuracy
    ends = [F.lit(min(1.0, max(0.0, q + side))) for q in qs for side in (-reach, reach)]
    rough = frame.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*ends), accuracy).alias("_e"))
    infinite = [F.lit(float("-inf")), F.lit(float("inf"))]
    bracket = lambda i, side: F.when(F.col("n") > accuracy, F.col("_e")[2 * i + side]).otherwise(infinite[side])
    # Computed again, the brackets that values are counted below could differ from those that they are ordered in.
    rough = cut(rough.select("_key", "n", *[bracket(i, side).alias(f"_{'lh'[side]}{i}") for i in range(len(qs)) for side in (0, 1)]))
    small = F.broadcast if rough.count() <= BROADCAST_GROUPS else (lambda x: x)
    methods = [method] * len(qs) if isinstance(method, str) else list(method)
    places = []
    for q, m in zip(qs, methods, strict=True):
        exactly = F.lit(float(q)) * (F.col("n") - 1)
        places.append(F.round(exactly) if m == "nearest" else exactly)
    sides = [F.count_if(F.col("_v") < F.col(f"_l{i}")).alias(f"_below{i}") for i in range(len(qs))]
    sides += [F.count_if(F.col("_v") <= F.col(f"_h{i}")).alias(f"_upto{i}") for i in range(len(qs))]
    counted = rough.join(frame.join(small(rough.drop("n")), "_key").groupBy("_key").agg(*sides).withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k"))
    # A bracket that its quantile lies outside of is opened on that side.
    missed = [(F.col(f"_below{i}") > F.floor(places[i]), F.col(f"_upto{i}") <= F.ceil(places[i])) for i in range(len(qs))]
    spans = [
        F.struct(
            F.when(low, infinite[0]).otherwise(F.col(f"_l{i}")).alias("l"), F.when(high, infinite[1]).otherwise(F.col(f"_h{i}")).alias("h"),
            F.when(low, F.lit(0)).otherwise(F.col(f"_below{i}")).alias("below"), places[i].alias("p"),
        )
        for i, (low, high) in enumerate(missed)
    ]
    brackets = cut(counted.select("_key", "n", *[x.alias(f"_s{i}") for i, x in enumerate(spans)]))
    hits = F.array(*[F.when(F.col("_v").between(F.col(f"_s{i}.l"), F.col(f"_s{i}.h")), F.lit(i)) for i in range(len(qs))])
    inside = frame.join(small(brackets.drop("n")), "_key").withColumn("_i", F.explode(F.array_compact(hits))).groupBy("_key", "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_key", "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.withColumn("_upto", upto).join(small(brackets), "_key").withColumn("_s", F.array(*[F.col(f"_s{i}") for i in range(len(qs))])[F.col("_i")])
    placed = placed.select("_key", "n", "_i", "_v", (F.col("_upto") + F.col("_s.below")).alias("_upto"), F.col("_s.p").alias("_p"))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    found = placed.groupBy("_key", "n", "_i", "_p").agg(at(F.floor("_p")).alias("_a"), at(F.ceil("_p")).alias("_b"))
    exact = found.withColumn("_q", F.col("_a") + (F.col("_p") - F.floor("_p")) * (F.col("_b") - F.col("_a")))
    out = exact.groupBy("_key", "n").agg(F.array(*[F.max(F.when(F.col("_i") == i, F.col("_q"))) for i in range(len(qs))]).alias("q"))
    return out.select(*[F.col(f"_key.{c}").alias(c) for c in by], "n", "q")


def cluster_bootstrap(clusters: DataFrame, *, base: str, treatment: str, n: str, draws: int = 3000) -> DataFrame:
    """Paired bootstrap over clusters of the RMSE difference: point, 2.5 % and 97.5 % bounds, share of draws that are worse.

    ``clusters`` has one row per cluster with summed squared errors of both models and a count. Each draw takes as many
    clusters as there are, with replacement, by digests of draw and place, so a rerun gives the same draws. The places
    of all draws are a range that every task takes a part of; clusters (an airport's days) are few beside the rows, and
    their number is read first.
    """
    total = clusters.agg(F.count(F.lit(1)).alias("k"), (F.sqrt(F.sum(treatment) / F.sum(n)) - F.sqrt(F.sum(base) / F.sum(n))).alias("point"))
    k = total.first()["k"]
    # Numbers by clusters, not rows: a window over the table of clusters.
    numbered = clusters.withColumn("number", F.row_number().over(Window.orderBy("cluster")) - 1)
    spots = clusters.sparkSession.range(draws * k).select(F.floor(F.col("id") / F.lit(max(1, k))).alias("draw"), F.pmod("id", F.lit(max(1, k))).alias("spot"))
    spots = spots.select("draw", hash_draw(F.col("draw"), F.col("spot"), modulus=F.lit(max(1, k))).alias("number"))
    sums = spots.join(numbered, "number").groupBy("draw").agg(F.sum(base).alias("b"), F.sum(treatment).alias("t"), F.sum(n).alias("m"))
    deltas = sums.select((F.sqrt(F.col("t") / F.col("m")) - F.sqrt(F.col("b") / F.col("m"))).alias("delta"))
    spread = deltas.agg(
        F.percentile("delta", 0.025).alias("low"),
        F.percentile("delta", 0.975).alias("high"),
        F.avg((F.col("delta") > 0).cast("double")).alias("p_worse"),
    )
    return total.select("point", F.lit(1).alias("_one")).join(spread.withColumn("_one", F.lit(1)), "_one").drop("_one")


def adoption(rows: DataFrame, *, cluster: Sequence[str], base: str, treatment: str, truth: str, month: str, trimmed: Column, draws: int = 3000, sure: float = 0.05, guard: float = 0.9) -> DataFrame:
    """Whether a treatment is adopted: over the trimmed rows its pooled RMSE falls, surely, and it falls in every month; over all rows it isn't surely worse.

    One row: ``delta`` and ``p_worse`` of the trimmed rows, ``worst_month``, the largest difference of a month,
    ``p_worse_full`` of all rows, and ``adopt``.
    """
    errors = rows.select(
        F.concat_ws("|", *cluster).alias("cluster"), F.col(month).alias("_month"), trimmed.alias("_kept"),
        F.pow(F.col(base) - F.col(truth), F.lit(2)).alias("_b"), F.pow(F.col(treatment) - F.col(truth), F.lit(2)).alias("_t"),
    )
    sums = [F.sum("_b").alias("b"), F.sum("_t").alias("t"), F.count(F.lit(1)).alias("n")]
    kept = errors.where(F.coalesce("_kept", F.lit(False)))
    months = kept.groupBy("_month").agg(*sums).agg(F.max(F.sqrt(F.col("t") / F.col("n")) - F.sqrt(F.col("b") / F.col("n"))).alias("worst_month"))

    def drawn(frame: DataFrame, suffix: str) -> DataFrame:
        found = cluster_bootstrap(frame.groupBy("cluster").agg(*sums), base="b", treatment="t", n="n", draws=draws)
        return found.select(F.col("point").alias(f"delta{suffix}"), F.col("p_worse").alias(f"p_worse{suffix}"))

    one = [f.withColumn("_one", F.lit(1)) for f in (drawn(kept, ""), months, drawn(errors, "_full"))]
    joined = one[0].join(one[1], "_one").join(one[2], "_one")
    adopt = (F.col("delta") < 0) & (F.col("p_worse") < sure) & (F.col("worst_month") < 0) & (F.col("p_worse_full") < guard)
    return joined.select("delta", "p_worse", "worst_month", "p_worse_full", F.coalesce(adopt, F.lit(False)).alias("adopt"))


def variance_parts(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Between and within variance of a grouping, the between part corrected for the noise of the means, and its share."""
    g = rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n >= 2")
    t = g.agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n")).alias("m2"),
        (F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("within"),
        F.count(F.lit(1)).alias("groups"),
    )
    between = F.col("m2") - F.col("mean") * F.col("mean")
    noise = F.col("within") * F.col("groups") / F.col("n")
    return t.select("groups", "within", between.alias("between"), F.greatest(between - noise, F.lit(0.0)).alias("between_corrected"), (between / (between + F.col("within"))).alias("share"))
