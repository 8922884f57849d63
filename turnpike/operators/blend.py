"""Least-squares weights, lags, fixed effects, stacking and the reconstruction of predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnpike.functions.exprs import clip
from turnpike.operators.evaluate import quantiles
from turnpike.operators.store import cut

EPSILON = 1e-9


def _ratio(residual: Column, delta: Column) -> Column:
    return F.sum(residual * delta) / F.greatest(F.sum(delta * delta), F.lit(EPSILON))


def ls_weight(residual: Column, delta: Column) -> Column:
    """Weight w in [0, 1] that minimises the squares of residual - w * delta: an aggregate."""
    return clip(_ratio(residual, delta), 0.0, 1.0)


def _with_one(frame: DataFrame) -> DataFrame:
    # One row, so that its broadcast has a bound; without it all rows would meet under one key.
    return F.broadcast(frame.withColumn("_one", F.lit(1)))


def lag_with_fallback(rows: DataFrame, group: str, value: str, least: int) -> DataFrame:
    """Median per group, the pooled median where a group has fewer than ``least`` rows."""
    pooled = quantiles(rows, value, [0.5]).select(F.col("q")[0].alias("pooled"))
    by = quantiles(rows, value, [0.5], by=[group]).withColumn("_one", F.lit(1)).join(_with_one(pooled), "_one")
    return by.select(group, "n", F.when(F.col("n") >= least, F.col("q")[0]).otherwise(F.col("pooled")).alias("lag"))


def fixed_effects(rows: DataFrame, group: str, x: str, y: str, *, least: int = 1) -> DataFrame:
    """Intercept per group and the common slope of y on x, by the within transform; y winsorised at its 1 % and 99 %.

    Groups of fewer than ``least`` rows share one intercept, that of the row whose group is null.
    """
    bounds = quantiles(rows, y, [0.01, 0.99]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    frame = rows.withColumn("_one", F.lit(1)).join(_with_one(bounds), "_one").withColumn("_y", clip(y, F.col("lo"), F.col("hi"))).withColumn("_x", F.col(x))
    sums = {"n": F.lit(1), "sx": F.col("_x"), "sy": F.col("_y"), "sxy": F.col("_x") * F.col("_y"), "sxx": F.col("_x") * F.col("_x")}
    g = frame.groupBy(group).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    g = g.groupBy(F.when(F.col("n") >= least, F.col(group)).alias(group)).agg(*[F.sum(n).alias(n) for n in sums])
    g = g.withColumn("mx", F.col("sx") / F.col("n")).withColumn("my", F.col("sy") / F.col("n"))
    every = Window.partitionBy()
    slope = F.try_divide(F.sum(F.col("sxy") - F.col("n") * F.col("mx") * F.col("my")).over(every), F.sum(F.col("sxx") - F.col("n") * F.col("mx") * F.col("mx")).over(every))
    slope = F.coalesce(slope, F.lit(0.0))
    return g.select(group, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


# Tiers of a pushback that a blend uses, the least rows of a lag and of a cell, and what makes a detection good.
BLEND_TIERS = ("appear", "dwell")
LAG_ROWS, CELL_ROWS = 100, 200
GOOD_METRES, GOOD_KNOTS, GOOD_GAP = 70.0, 5.0, 40.0
# Metres from the stand up to which a partial track counts, and where near ends.
PARTIAL_METRES, NEAR_METRES = 1000.0, 500.0
#: Airports that blends leave alone.
EXCLUDED = ("LIRF",)


def eligible(excluded: Sequence[str] = EXCLUDED) -> Column:
    """Rows with a tier that a blend uses, outside the excluded airports."""
    return F.coalesce(F.col("tier").isin(*BLEND_TIERS), F.lit(False)) & ~F.col("airport").isin(*excluded)


def detection_quality() -> Column:
    """``good`` or ``poor``, by the pushback point's distance and, for ``appear``, its speed, else the gap to the next point."""
    steady = F.when(F.col("tier") == "appear", F.col("pb_speed") <= GOOD_KNOTS).otherwise(F.col("pb_gap_s") <= GOOD_GAP)
    return F.when(F.coalesce((F.col("pb_dist_m") <= GOOD_METRES) & steady, F.lit(False)), "good").otherwise("poor")


@dataclass
class PushbackBlend:
    """Fitted tables, kept in the shared checkpoint folder: median lag by airport and pooled, weight by tier and, for large cells, by airport and tier; multipliers by tier and quality."""

    lags: DataFrame
    pooled: DataFrame
    tiers: DataFrame
    cells: DataFrame
    excluded: Sequence[str] = EXCLUDED
    quality: DataFrame | None = None

    @classmethod
    def fit(cls, rows: DataFrame, *, excluded: Sequence[str] = EXCLUDED, lag_rows: int = LAG_ROWS, cell_rows: int = CELL_ROWS) -> PushbackBlend:
        """Fit on ``rows(airport, tier, pred, taxi, track_taxi)``; only eligible rows count."""
        f = rows.where(eligible(excluded)).withColumn("_late", F.col("track_taxi") - F.col("taxi"))
        lags = cut(lag_with_fallback(f, "airport", "_late", lag_rows).select("airport", "lag"))
        pooled = cut(quantiles(f, "_late", [0.5]).select(F.col("q")[0].alias("pooled")))
        out = cls(lags, pooled, lags, lags, excluded)
        r, delta = F.col("taxi") - F.col("pred"), F.col("_c") - F.col("pred")
        corrected = out._corrected(f)
        out.tiers = cut(corrected.groupBy("tier").agg(ls_weight(r, delta).alias("_wt")))
        out.cells = cut(corrected.groupBy("airport", "tier").agg(ls_weight(r, delta).alias("_wc"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= cell_rows).drop("_n"))
        return out

    def shifted(self, seconds: dict[str, float]) -> PushbackBlend:
        """The blend with some airports' lags moved by seconds."""
        by = F.create_map(*[F.lit(x) for pair in seconds.items() for x in pair])
        return replace(self, lags=self.lags.withColumn("lag", F.col("lag") + F.coalesce(F.try_element_at(by, F.col("airport")), F.lit(0.0))))

    def _corrected(self, rows: DataFrame) -> DataFrame:
        joined = rows.withColumn("_one", F.lit(1)).join(_with_one(self.pooled), "_one", "left").join(self.lags, "airport", "left")
        return joined.withColumn("_c", F.col("track_taxi") - F.coalesce("lag", "pooled")).drop("_one", "pooled", "lag")

    def _weighted(self, rows: DataFrame) -> DataFrame:
        joined = self._corrected(rows).join(self.tiers, "tier", "left").join(self.cells, ["airport", "tier"], "left")
        return joined.withColumn("_w", F.coalesce("_wc", "_wt", F.lit(0.0))).drop("_wc", "_wt")

    def fit_quality(self, rows: DataFrame) -> PushbackBlend:
        """The blend with multipliers, not below 0, by tier and quality of the detection, given the weights."""
        u = F.col("_w") * (F.col("_c") - F.col("pred"))
        f = self._weighted(rows.where(eligible(self.excluded))).withColumn("_q", detection_quality())
        table = f.groupBy("tier", "_q").agg(F.greatest(_ratio(F.col("taxi") - F.col("pred"), u), F.lit(0.0)).alias("_m"))
        return replace(self, quality=cut(table))

    def apply(self, rows: DataFrame, out: str = "blend") -> DataFrame:
        """``rows`` with their prediction, moved towards the track's lag-corrected taxi where eligible."""
        f = self._weighted(rows)
        if self.quality is not None:
            f = f.withColumn("_q", detection_quality()).join(self.quality, ["tier", "_q"], "left").withColumn("_w", clip(F.col("_w") * F.coalesce("_m", F.lit(1.0)), 0.0, 1.0))
        moved = F.when(eligible(self.excluded), F.col("pred") + F.col("_w") * (F.col("_c") - F.col("pred"))).otherwise(F.col("pred"))
        return f.withColumn("_out", moved).select(*rows.columns, F.col("_out").alias(out))


def partial_mask(excluded: Sequence[str] = EXCLUDED) -> Column:
    """Matched tracks without a tier that a blend uses, first seen near their stand, outside the excluded airports."""
    unseen = ~F.coalesce(F.col("tier").isin(*BLEND_TIERS), F.lit(False))
    return F.coalesce(F.col("matched"), F.lit(False)) & unseen & F.coalesce(F.col("first_own_m") < PARTIAL_METRES, F.lit(False)) & ~F.col("airport").isin(*excluded)


@dataclass
class PartialTracks:
    """Fitted tables, kept in the shared checkpoint folder: intercepts by airport and pooled with the common slope, and the weights near the stand and far from it."""

    effects: DataFrame
    weights: DataFrame
    excluded: Sequence[str] = EXCLUDED

    @classmethod
    def fit(cls, rows: DataFrame, *, excluded: Sequence[str] = EXCLUDED, least: int = LAG_ROWS) -> PartialTracks:
        """Fit on ``rows(airport, matched, tier, first_own_m, seen_s, base, taxi)``; ``seen_s`` is the time from the first point to take-off."""
        f = rows.where(partial_mask(excluded)).withColumn("_unseen", F.col("taxi") - F.col("seen_s")).withColumn("_km", F.col("first_own_m") / 1000.0)
        out = cls(cut(fixed_effects(f, "airport", "_km", "_unseen", least=least)), f, excluded)
        near = F.when(F.col("first_own_m") < NEAR_METRES, "near").otherwise("far").alias("_zone")
        estimated = out._estimated(f)
        out.weights = cut(estimated.groupBy(near).agg(ls_weight(F.col("taxi") - F.col("base"), F.col("_est") - F.col("base")).alias("_w")))
        return out

    def _estimated(self, rows: DataFrame) -> DataFrame:
        own = self.effects.where("airport is not null").select(F.col("airport").alias("_a"), F.col("intercept").alias("_own"))
        # No small airport, no shared intercept: it is 0 then.
        shared = self.effects.agg(F.max("slope").alias("_slope"), F.coalesce(F.max(F.when(F.col("airport").isNull(), F.col("intercept"))), F.lit(0.0)).alias("_shared"))
        f = rows.withColumn("_one", F.lit(1)).join(_with_one(shared), "_one", "left").join(own, F.col("airport") == F.col("_a"), "left")
        estimate = F.col("seen_s") + F.coalesce("_own", "_shared") + F.col("_slope") * F.col("first_own_m") / 1000.0
        return f.withColumn("_est", estimate).drop("_one", "_a", "_own", "_shared", "_slope")

    def apply(self, rows: DataFrame, out: str = "partial") -> DataFrame:
        """``rows`` with their base prediction, moved towards the estimate of their track where the mask holds."""
        zone = F.when(F.col("first_own_m") < NEAR_METRES, "near").otherwise("far")
        f = self._estimated(rows).withColumn("_zone", zone).join(self.weights, "_zone", "left")
        moved = F.when(partial_mask(self.excluded), F.col("base") + F.coalesce("_w", F.lit(0.0)) * (F.col("_est") - F.col("base"))).otherwise(F.col("base"))
        return f.withColumn("_out", moved).select(*rows.columns, F.col("_out").alias(out))


def nnls_pair(a: Column, b: Column, y: Column) -> tuple[Column, Column]:
    """Non-negative weights of two predictors without intercept, in closed form over Gram sums: aggregates."""
    aa, ab, bb, ay, by = F.sum(a * a), F.sum(a * b), F.sum(b * b), F.sum(a * y), F.sum(b * y)
    det = aa * bb - ab * ab
    wa, wb = F.try_divide(bb * ay - ab * by, det), F.try_divide(aa * by - ab * ay, det)
    only_a, only_b = F.greatest(ay / aa, F.lit(0.0)), F.greatest(by / bb, F.lit(0.0))
    # On the border the better single predictor stays: it has the larger explained sum.
    a_alone = only_a * ay >= only_b * by
    inner = F.coalesce((wa >= 0) & (wb >= 0), F.lit(False))
    return F.when(inner, wa).when(a_alone, only_a).otherwise(0.0), F.when(inner, wb).when(a_alone, 0.0).otherwise(only_b)


def nnls(rows: DataFrame, predictors: list[str], y: str) -> dict[str, float]:
    """Non-negative weights of any number of predictors: Gram sums from Spark, coordinate descent on the k x k matrix."""
    pairs = {(i, j): F.sum(F.col(predictors[i]) * F.col(predictors[j])) for i in range(len(predictors)) for j in range(i + 1)}
    sums = rows.agg(*[c.alias(f"g{i}_{j}") for (i, j), c in pairs.items()], *[F.sum(F.col(p) * F.col(y)).alias(f"y{i}") for i, p in enumerate(predictors)]).first()
    gram = [[float(sums[f"g{max(i, j)}_{min(i, j)}"] or 0.0) for j in range(len(predictors))] for i in range(len(predictors))]
    w = [0.0] * len(predictors)
    for _ in range(20_000):
        moved = 0.0
        for i in range(len(w)):
            if gram[i][i] > 0:
                new = max(0.0, (float(sums[f"y{i}"] or 0.0) - sum(gram[i][j] * w[j] for j in range(len(w)) if j != i)) / gram[i][i])
                moved, w[i] = max(moved, abs(new - w[i])), new
        if moved < 1e-13:
            break
    return dict(zip(predictors, w, strict=True))


def reconstruct(p: Column, offset: Column, prior: Column, model: Column, ceiling: float | Column, most: float = 140_000.0) -> Column:
    """``p * clip(offset) + (1 - p) * (prior or clip(model))``; a missing prior is tested before anything is filled."""
    return p * clip(offset, 0.0, most) + (1 - p) * F.coalesce(prior, clip(model, 0.0, ceiling))


def blend(prediction: Column, estimate: Column, weight: Column, eligible: Column) -> Column:
    """Move an eligible prediction towards an estimate by a weight; others stay."""
    moved = prediction + weight * (estimate - prediction)
    return F.when(F.coalesce(eligible & estimate.isNotNull() & weight.isNotNull(), F.lit(False)), moved).otherwise(prediction)


def seed_mean(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """Mean of a value over runs with different seeds, for keys that all runs have."""
    named = [f.select(key, F.col(value).alias(f"_v{i}")) for i, f in enumerate(frames)]
    joined = reduce(lambda a, b: a.join(b, key), named)
    return joined.select(key, (sum(F.col(f"_v{i}") for i in range(len(frames))) / len(frames)).alias(value))
