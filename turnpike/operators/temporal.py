"""Ordered and windowed operators over event time in integer microseconds or seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnpike.functions.exprs import MICROS

#: Seconds of a time block of a key, and the block of rows without a time.
BLOCK, NO_TIME = 86_400, -(1 << 40)


def _block_of(time: str, block: int) -> Column:
    return F.coalesce(F.floor(F.col(time) / (block * MICROS)), F.lit(NO_TIME))


Windows = dict[str, tuple[int, int] | tuple[int, int, Column]]


def rolling_counts(rows: DataFrame, *, by: Sequence[str], time: str, windows: Windows, counted: Column | None = None, block: int = BLOCK, keep: Column | None = None, keyed: bool = False) -> DataFrame:
    """Add counts of (``counted``) rows of the key with time in (t + start, t + end] for each named window.

    A window may name the rows that it counts as a third element. A key is cut into blocks of ``block`` seconds, and
    rows near a border are repeated in the next block, so a key with a third of all rows spreads over as many tasks as
    it has blocks. All windows share one exchange and sort. Rows with a null time count nothing and aren't counted; only
    the rows of ``keep`` come back. ``keyed`` leaves ``_key`` and ``_block``, by which the result is partitioned.
    """
    back, ahead = max(0, *(-w[0] for w in windows.values())), max(0, *(w[1] for w in windows.values()))
    size, own = block * MICROS, _block_of(time, block)
    blocks = F.sequence(F.floor((F.col(time) - ahead * MICROS) / size), F.floor((F.col(time) + back * MICROS) / size))
    spread = rows.withColumn("_key", F.struct(*by)).withColumn("_own", own).withColumn("_block", F.explode(F.coalesce(blocks, F.array(F.lit(NO_TIME)))))

    def count(start: int, end: int, which: Column | None = None) -> Column:
        which = counted if which is None else which
        frame = Window.partitionBy("_key", "_block").orderBy(time).rangeBetween(start * MICROS + 1, end * MICROS)
        return F.when(F.col(time).isNotNull(), F.count(F.lit(1) if which is None else F.when(which, 1)).over(frame)).otherwise(F.lit(0)).cast("bigint")

    out = spread.withColumns({name: count(*w) for name, w in windows.items()})
    kept = F.col("_block") == F.col("_own")
    return out.where(kept if keep is None else kept & keep).drop("_own", *([] if keyed else ["_block", "_key"]))


def around_count(rows: DataFrame, *, by: Sequence[str], time: str, counted: Column, back: int, ahead: int, name: str) -> DataFrame:
    """Add the number of ``counted`` rows with time in (t - back, t + ahead] of each row."""
    return rolling_counts(rows, by=by, time=time, windows={name: (-back, ahead)}, counted=counted)


def saturation(rows: DataFrame, *, by: Sequence[str], time: str, tie: str, limit: int = 120, block: int = BLOCK, source: DataFrame | None = None) -> DataFrame:
    """Add ``prev_gap``, whole seconds since the row before of the key, and ``sat_run``, the place in a run of gaps under ``limit``.

    The first row of a key has no gap and starts a run. Rows are numbered inside time blocks; the last time of the
    blocks before and the length of the run that reaches a block come in from one row per key and block, so no task
    holds a whole key. Null keys are a key like any other, null times come first. ``source`` has the same rows where
    ``rows`` are costly: key, time and tie are all that the borders need. Rows that ``rolling_counts`` left keyed stay
    where they are.
    """
    place = {"_key": F.struct(*by), "_block": _block_of(time, block)}
    frame = rows if "_key" in rows.columns else rows.withColumns(place)
    narrow = (rows if source is None else source).withColumns(place).select("_key", "_block", F.col(time).alias("_time"), F.col(tie).alias("_tie"))
    in_key = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = narrow.groupBy("_key", "_block").agg(F.max("_time").alias("_end"))
    ends = ends.select("_key", "_block", F.last("_end", ignorenulls=True).over(in_key).alias("_before"))

    def numbered(some: DataFrame, t: str, i: str) -> DataFrame:
        inside = Window.partitionBy("_key", "_block").orderBy(F.col(t).asc_nulls_first(), i)
        gap = ((F.col(t) - F.coalesce(F.lag(t).over(inside), F.col("_before"))) / MICROS).cast("bigint")
        out = some.join(ends, ["_key", "_block"]).withColumn("prev_gap", gap).withColumn("_place", F.row_number().over(inside))
        starts = F.when(F.coalesce(F.col("prev_gap"), F.lit(9999)) >= limit, F.col("_place"))
        return out.withColumn("_start", F.max(starts).over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    tails = numbered(narrow, "_time", "_tie").groupBy("_key", "_block").agg(F.count(F.lit(1)).alias("_n"), F.max("_start").alias("_last"))
    # Rows of the key before the block less those before its latest start: the length of the run that goes on.
    tails = tails.withColumn("_past", F.coalesce(F.sum("_n").over(in_key), F.lit(0)))
    began = F.max(F.when(F.col("_last").isNotNull(), F.col("_past") + F.col("_last") - 1)).over(in_key)
    tails = tails.select("_key", "_block", (F.col("_past") - began).alias("_carried"))
    out = numbered(frame, time, tie).join(tails, ["_key", "_block"])
    run = F.when(F.col("_start").isNotNull(), F.col("_place") - F.col("_start")).otherwise(F.col("_carried") + F.col("_place") - 1)
    return out.withColumn("sat_run", run.cast("bigint")).drop("_key", "_block", "_before", "_place", "_start", "_carried")


def previous_gap(rows: DataFrame, *, by: Sequence[str], time: str, tie: str, block: int = BLOCK) -> DataFrame:
    """Add ``prev_gap`` alone; see ``saturation``."""
    return saturation(rows, by=by, time=time, tie=tie, block=block).drop("sat_run")


def runs(rows: DataFrame, *, by: Sequence[str], order: Sequence[str], breaks: Column, run: str = "run") -> DataFrame:
    """Number the runs of each key: a row with ``breaks`` true or unknown starts one.

    A key is one task's; it is for keys whose rows are bounded, like the bins of an airport or the points of an aircraft.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.coalesce(breaks, F.lit(True)).cast("int")
    return rows.withColumn("_flag", flag).withColumn(run, F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_flag")


#: Counts of departures around a take-off: by airport and by its runway, in seconds.
AIRPORT_WINDOWS: Windows = {"n_dep_30m_prev": (-1800, 0), "n_dep_60m_prev": (-3600, 0), "n_dep_15m_next": (0, 900)}
RUNWAY_WINDOWS: Windows = {"n_deprwy_30m_prev": (-1800, 0), "n_deprwy_15m_next": (0, 900)}


def congestion(m: DataFrame) -> DataFrame:
    """The departures, all columns, with counts around their take-off, the gap to the one before on the runway and their place in a saturated run.

    Rows are carried through two exchanges, by airport and by runway, each with its time block; nothing is joined on the movement.
    """
    dep = F.col("phase") == "DEP"
    windows: Windows = {name: (*w, dep) for name, w in AIRPORT_WINDOWS.items()} | {"n_arr_60m_around": (-1800, 1800, ~dep)}
    a = rolling_counts(m, by=["airport"], time="t_us", windows=windows, keep=dep)
    r = rolling_counts(a, by=["airport", "runway"], time="t_us", windows=RUNWAY_WINDOWS, keyed=True)
    r = r.withColumns({c: F.when(F.col("runway").isNotNull(), F.col(c)) for c in RUNWAY_WINDOWS})
    out = saturation(r, by=["airport", "runway"], time="t_us", tie="mvt_id", source=m.where(dep))
    return out.withColumn("dep_pressure", F.col("n_dep_30m_prev") / 30.0)


def config_bins(m: DataFrame, seconds: int = 300) -> DataFrame:
    """Per airport and five-minute bin the set of active runways by phase as text and their number, and movements by phase.

    A phase without movements is ``?`` and 0. An unknown runway counts as one but is not named.
    """
    bins = m.withColumn("bin", F.floor(F.col("t_us") / (seconds * MICROS)))
    columns = []
    for phase, name in (("DEP", "dep"), ("ARR", "arr")):
        own = F.col("phase") == phase
        n, runways = F.count_if(own), F.collect_set(F.when(own, F.col("runway")))
        columns += [
            F.when(n > 0, F.array_join(F.sort_array(runways), "+")).otherwise("?").alias(f"{name}_rwy_config"),
            (F.size(runways) + F.max(own & F.col("runway").isNull()).cast("int")).cast("bigint").alias(f"n_active_{name}_rwy"),
            n.alias(f"n_{name}"),
        ]
    return bins.groupBy("airport", "bin").agg(*columns)


def change_segments(bins: DataFrame, seconds: int = 300, gap_hours: int = 24) -> DataFrame:
    """Minutes since the departure configuration of an airport last changed; a gap over ``gap_hours`` also starts a segment.

    An airport is one task's: it has a row per bin, at most 105,120 a year, whatever its movements.
    """
    w = Window.partitionBy("airport").orderBy("bin")
    frame = bins.withColumn("_before", F.lag("dep_rwy_config").over(w)).withColumn("_bin_before", F.lag("bin").over(w))
    changed = (F.col("dep_rwy_config") != F.col("_before")) | ((F.col("bin") - F.col("_bin_before")) * seconds > gap_hours * 3600)
    frame = runs(frame, by=["airport"], order=["bin"], breaks=changed, run="segment")
    start = F.min("bin").over(Window.partitionBy("airport", "segment"))
    return frame.withColumn("mins_since_cfg_change", (F.col("bin") - start) * seconds / 60.0).drop("_before", "_bin_before")


def queue(m: DataFrame, *, anchor: str, start: str, end: str, by: Sequence[str], prefix: str, recent: int | None = None, block: int = 86_400) -> DataFrame:
    """For each row the countable rows of its key under way at its anchor: started strictly before and not yet ended.

    A sweep: ends, anchors and starts are sorted together and running sums count what is open, so the cost is a sort
    and not a join of all pairs. Running sums are taken inside blocks of ``block`` seconds and shifted by the totals
    of the key's earlier blocks, so no task holds a whole key. Countable rows have end > start. Ends at an anchor are
    over, starts at it haven't begun. ``recent`` adds the starts in [anchor - recent, anchor) seconds: the starts
    before the anchor less those before its lower end. A null anchor or key gives nulls, and nobody ahead no mean wait.
    """
    none = F.lit(0).cast("bigint")

    def mark(t: Column, kind: int, step: int, weight: Column, begun: int, ask: str | None) -> Column:
        return F.struct(t.alias("t"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), weight.alias("weight"), F.lit(begun).alias("begun"), F.lit(ask).cast("string").alias("ask"))

    stays = F.coalesce(F.col(end) > F.col(start), F.lit(False))
    marks = [F.when(stays, mark(F.col(end), 0, -1, -F.col(start), 0, None)), F.when(stays, mark(F.col(start), 2, 1, F.col(start), 1, None))]
    asked = F.col(anchor).isNotNull()
    marks.append(F.when(asked, mark(F.col(anchor), 1, 0, none, 0, "now")))
    if recent is not None:
        marks.append(F.when(asked, mark(F.col(anchor) - recent * MICROS, 1, 0, none, 0, "then")))
    events = m.select(*by, "mvt_id", F.explode(F.array(*marks)).alias("e")).where(F.col("e").isNotNull()).select(*by, "mvt_id", "e.*").withColumn("block", F.floor(F.col("t") / (block * MICROS)))
    sums = {"open": "step", "starts": "weight", "begun_before": "begun"}
    totals = events.groupBy(*by, "block").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("block").alias("_block"), *[F.coalesce(F.sum(n).over(earlier), none).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*by, "block").orderBy("t", "kind", "mvt_id").rowsBetween(Window.unboundedPreceding, 0)
    asks = events.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).where("ask is not null")
    same = F.col("block") == F.col("_block")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    asks = asks.join(carried, same).select("mvt_id", *by, "ask", "t", *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
    n, t = F.col("open"), F.col("t")
    wait = F.when(n > 0, F.least(F.greatest((n * t - F.col("starts")) / MICROS / n, F.lit(0.0)), F.lit(3600.0)))
    known = F.col(by[0]).isNotNull()
    for k in by[1:]:
        known = known & F.col(k).isNotNull()
    now = known & (F.col("ask") == "now")
    columns = [F.max(F.when(now, n)).cast("bigint").alias(f"{prefix}_ahead"), F.max(F.when(now, wait)).alias(f"{prefix}_wait")]
    if recent is not None:
        before = F.when(F.col("ask") == "now", F.col("begun_before")).otherwise(-F.col("begun_before"))
        columns.append(F.sum(F.when(known, before)).cast("bigint").alias(f"{prefix}_recent"))
    return m.select("mvt_id").join(asks.groupBy("mvt_id").agg(*columns), "mvt_id", "left")


# Speeds in knots, times in seconds and distances in metres that tell a departure on the ground.
SURFACE_SPEED, STILL_SPEED = 40.0, 1.0
RUN_GAP, TAKEOFF_LOOKAHEAD, MATCH_REACH = 1200, 120, 180
STAND_RADIUS = 100.0


def _on_surface(speed: str, limit: float = SURFACE_SPEED) -> Column:
    """Slower than the limit; an unknown speed isn't."""
    return F.coalesce((F.col(speed) < limit) & ~F.isnan(speed), F.lit(False))


def run_points(points: DataFrame, *, by: Sequence[str], time: str, speed: str, gap: float = RUN_GAP, takeoff: float = TAKEOFF_LOOKAHEAD) -> DataFrame:
    """The slow points of each track with the number of their ``run``, ``next_t``, the time of the run's next point, and ``takes_off``.

    A run ends at a fast point or a gap over ``gap`` seconds; ``takes_off`` is true on its last point if the next point
    of the track is fast and comes within ``takeoff`` seconds. ``by`` and time are unique. A track is an aircraft's
    points of a day, a row a second at most, and is one task's.
    """
    w = Window.partitionBy(*by).orderBy(time)
    frame = points.withColumn("_ground", _on_surface(speed))
    broke = ~F.lag("_ground").over(w) | (F.col(time) - F.lag(time).over(w) > gap)
    frame = frame.withColumn("_gone", F.coalesce(~F.lead("_ground").over(w) & (F.lead(time).over(w) - F.col(time) <= takeoff), F.lit(False)))
    frame = frame.withColumn("_break", F.coalesce(broke, F.lit(True)))
    frame = frame.withColumn("run", F.sum(F.col("_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "run").orderBy(time)
    rows = frame.where("_ground").withColumn("next_t", F.lead(time).over(inside))
    return rows.withColumn("takes_off", F.col("_gone") & F.col("next_t").isNull()).drop("_ground", "_break", "_gone")


def surface_runs(points: DataFrame, *, by: Sequence[str], time: str, speed: str, gap: float = RUN_GAP, takeoff: float = TAKEOFF_LOOKAHEAD) -> DataFrame:
    """One row per slow-speed run of a track; a run is a departure if the next point of the track is fast and soon."""
    rows = run_points(points, by=by, time=time, speed=speed, gap=gap, takeoff=takeoff)
    return rows.groupBy(*by, "run").agg(
        F.count(F.lit(1)).alias("n_points"), F.min(time).alias("first_t"), F.max(time).alias("last_t"), F.max("takes_off").alias("takes_off"), F.min_by(speed, time).alias("first_speed")
    )


def pushback(points: DataFrame, *, by: Sequence[str], time: str, speed: str, distance: str, radius: float = STAND_RADIUS, still: float = STILL_SPEED) -> DataFrame:
    """Tier and time of the pushback of each group of run points, whose ``distance`` is that to the own stand.

    At the stand is nearer than ``radius``. ``dwell``: the last still point there; the pushback is the time of the point
    after it (its own if it is the last). Else ``appear``: the run's first point is there. Else ``pass``: the first point
    there. No point there: tier and time are null (censored). The quality of a tier is its point's distance, speed and
    the time to the next point. ``by`` names one run; points carry ``next_t`` as ``run_points`` gives it.
    """
    t, at = F.col(time), F.coalesce(F.col(distance) < radius, F.lit(False))
    stands = at & (F.col(speed) <= still)
    point = F.struct(t.alias("t"), F.col("next_t").alias("next_t"), F.col(distance).alias("d"), F.col(speed).alias("v"))
    g = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"), F.min(time).alias("first_t"), F.max(time).alias("last_t"), F.min_by(speed, time).alias("first_speed"),
        F.min_by(distance, time).alias("first_own_m"), F.min(distance).alias("min_own_m"),
        F.max_by(point, F.when(stands, t)).alias("_dwell"), F.min_by(point, F.when(at, t)).alias("_seen"),
    )
    tier = F.when(F.col("_dwell").isNotNull(), "dwell").when(F.col("_seen.t") == F.col("first_t"), "appear").when(F.col("_seen").isNotNull(), "pass")
    chosen = g.withColumn("tier", tier).withColumn("_c", F.coalesce("_dwell", "_seen"))
    when = F.when(F.col("tier") == "dwell", F.coalesce("_c.next_t", "_c.t")).otherwise(F.col("_c.t"))
    quality = [(F.col("_c.next_t") - F.col("_c.t")).alias("pb_gap_s"), F.col("_c.d").alias("pb_dist_m"), F.col("_c.v").alias("pb_speed")]
    return chosen.select(*by, "n_points", "first_t", "last_t", "first_speed", "first_own_m", "min_own_m", "tier", when.alias("pushback_t"), *quality)


def last_dwell(points: DataFrame, *, by: Sequence[str], time: str, speed: str, still: float = 2.0, least: int = 180) -> DataFrame:
    """End of the last stand-still of at least ``least`` seconds of each track; null if there is none."""
    w = Window.partitionBy(*by).orderBy(time)
    frame = points.withColumn("_s", _on_surface(speed, still))
    frame = runs(frame, by=by, order=[time], breaks=F.col("_s") != F.lag("_s").over(w), run="_run")
    spans = frame.groupBy(*by, "_run").agg(F.first("_s").alias("_s"), F.min(time).alias("a"), F.max(time).alias("b"))
    return spans.groupBy(*by).agg(F.max(F.when(F.col("_s") & (F.col("b") - F.col("a") >= least), F.col("b"))).alias("dwell_end"))
