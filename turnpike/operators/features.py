"""Feature families of movements and their assembly. Each family is a function from the movements to (mvt_id, columns)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnpike.functions.exprs import MICROS, clip, extract_or, guarded_ratio, iso_weekday, planar_metres, secs_between, stand_key, variant_base
from turnpike.operators import joins, temporal
from turnpike.operators.encode import apply_priors

# Seconds of a nominal taxi, and the shortest and longest plausible time on the ground.
NOMINAL_TAXI, GROUND_LEAST, GROUND_MOST = 720, 600, 57_600
# Parts of present-weather groups by what they mean.
SNOW, FREEZING, STORM = ("SN", "SG", "PL", "GS", "GR"), ("FZ",), ("TS",)
OBSCURED = ("FG", "BR", "HZ", "FU", "VA", "DU", "SA")
#: Ceiling, in feet, that stands for none.
NO_CEILING = 99_999.0


def blind(m: DataFrame) -> DataFrame:
    """Departures without what only the outcome tells: block time and taxi time."""
    dep = F.col("phase") == "DEP"
    return m.withColumns({c: F.when(~dep, F.col(c)) for c in ("block_us", "taxi")})


def flight_category(ceiling: Column, visibility: Column) -> Column:
    """LIFR, IFR, MVFR or VFR by ceiling in feet and visibility in miles; an unknown value doesn't lower the category."""

    def under(feet: float, miles: float) -> Column:
        return F.coalesce(visibility < miles, F.lit(False)) | F.coalesce(ceiling < feet, F.lit(False))

    return F.when(under(500, 1), "LIFR").when(under(1000, 3), "IFR").when(under(3000, 5), "MVFR").otherwise("VFR")


def weather_hours(observations: DataFrame) -> DataFrame:
    """Observations as ``weather_csv`` gives them -> the last one of each station and hour, with what follows from it.

    The ceiling is the lowest broken, overcast or obscured layer of three; degrees are Celsius; flags of present
    weather are false where it is unknown. ``hour`` is the hour's start.
    """
    celsius = lambda c: (F.col(c) - 32) / 1.8
    layers = [F.when(F.col(f"skyc{i}").isin("BKN", "OVC", "VV"), F.col(f"skyl{i}")) for i in (1, 2, 3)]
    has = lambda parts: F.coalesce(reduce(lambda a, b: a | b, [F.col("wxcodes").contains(p) for p in parts]), F.lit(False))
    o = observations.select(
        "station", "valid", F.date_trunc("hour", "valid").alias("hour"), F.col("vsby").alias("vis_mi"), F.least(*layers).alias("ceiling_ft"), celsius("tmpf").alias("temp_c"),
        celsius("dwpf").alias("dewpoint_c"), F.col("drct").alias("wind_dir"), F.col("sknt").alias("wind_kt"), F.col("gust").alias("gust_kt"), F.col("p01i").alias("precip_1h_in"),
        has(SNOW).alias("wx_snow"), has(FREEZING).alias("wx_freezing"), has(STORM).alias("wx_tstorm"), has(OBSCURED).alias("wx_obscuration"),
    )
    wet = (F.coalesce("precip_1h_in", F.lit(0.0)) > 0) | F.col("wx_snow") | F.col("wx_freezing")
    o = o.withColumns({
        "temp_dewpoint_spread_c": F.col("temp_c") - F.col("dewpoint_c"), "below_freezing": F.col("temp_c") < 0, "flight_category": flight_category(F.col("ceiling_ft"), F.col("vis_mi")),
    }).withColumn("deicing_risk", F.col("below_freezing") & wet)
    columns = [c for c in o.columns if c not in ("station", "hour")]
    last = o.groupBy("station", "hour").agg(F.max(F.struct(*columns)).alias("r"))
    return last.select("station", "hour", *[F.col(f"r.{c}").alias(c) for c in columns if c != "valid"])


def with_calendar(dep: DataFrame) -> DataFrame:
    """Hour, ISO weekday, month, day of year, weekend, minute of day, and cyclical day and minute of the take-off."""
    dow, minute = iso_weekday("ts"), F.hour("ts") * 60 + F.minute("ts")
    day = F.dayofyear("ts") * (2 * 3.141592653589793 / 366)
    turn = minute * (2 * 3.141592653589793 / 1440)
    return dep.withColumns({
        "hour": F.hour("ts"), "dow": dow.cast("int"), "month": F.month("ts"), "doy": F.dayofyear("ts"), "is_weekend": (dow >= 6).cast("int"), "minute_of_day": minute,
        "doy_sin": F.sin(day), "doy_cos": F.cos(day), "minute_sin": F.sin(turn), "minute_cos": F.cos(turn),
    })


def with_config(dep: DataFrame, m: DataFrame) -> DataFrame:
    """Runway configuration of the five minutes of the take-off, and minutes since the airport's departures changed theirs."""
    columns = ["dep_rwy_config", "arr_rwy_config", "n_active_dep_rwy", "n_active_arr_rwy", "mins_since_cfg_change"]
    bins = temporal.change_segments(temporal.config_bins(m)).select("airport", F.col("bin").alias("_bin"), *columns)
    return dep.withColumn("_bin", F.floor(F.col("t_us") / (300 * MICROS))).join(bins, ["airport", "_bin"], "left").drop("_bin")


#: What a linked arrival gives to its departure.
_ARRIVAL = ("mvt_id", "block_us", "sched_us", "actype", "wake")


def with_links(dep: DataFrame, m: DataFrame) -> DataFrame:
    """Departures with the arrival before their estimated off-block on their stand (own type first, else any) and the bounds that follow.

    The estimate is the take-off less a nominal taxi. ``U_sec`` and ``L_sec`` bound the taxi: since the stand's arrival
    before, and since the arrival after (0 where none came before the take-off). Confidence: ``none`` without an
    arrival, ``high`` for one of the type with a plausible time on the ground and a successor, ``med`` for one of type or
    time, else ``low``. A departure without stand or take-off has no link and no values at all.
    """
    known = F.col("stand").isNotNull() & F.col("t_us").isNotNull()
    arr = m.where("phase = 'ARR'").where(F.col("stand").isNotNull() & F.col("block_us").isNotNull()).select(*_ARRIVAL, "airport", "stand")
    frame = dep.withColumn("_est", F.col("t_us") - NOMINAL_TAXI * MICROS)
    lookups = {"_any": ("backward", None), "_next": ("forward", None), "_typed": ("backward", "actype")}
    asked = m.where("phase = 'DEP'").withColumn("_est", F.col("t_us") - NOMINAL_TAXI * MICROS)
    found = joins.asof_many(frame, arr, by=["airport", "stand"], left_time="_est", right_time="block_us", right_id="mvt_id", columns=_ARRIVAL, lookups=lookups, source=asked)
    found = found.withColumn("_in", F.coalesce("_typed", "_any"))
    since, after, ground = secs_between("t_us", "_in.block_us"), secs_between("t_us", "_next.block_us"), secs_between("_est", "_in.block_us")
    typed, plausible, followed = F.col("_typed").isNotNull(), F.coalesce(ground.between(GROUND_LEAST, GROUND_MOST), F.lit(False)), F.col("_next").isNotNull()
    confidence = F.when(F.col("_in").isNull(), "none").when(typed & plausible & followed, "high").when(typed | plausible, "med").otherwise("low")
    of_known = lambda c: F.when(known, c)
    low = F.greatest(F.coalesce(after, F.lit(0)), F.lit(0))
    return found.withColumns({
        "inbound_mvt_id": F.col("_in.mvt_id"), "A_own_us": F.col("_in.block_us"), "A_next_us": F.col("_next.block_us"), "L_sec": of_known(low), "U_sec": since, "interval_sec": since - low,
        "ground_time_sec": ground, "type_match": of_known(typed), "has_next": of_known(followed), "bound_binding": after > 0, "link_confidence": of_known(confidence),
    }).drop("_any", "_next", "_typed", "_est")


def stand_links(m: DataFrame) -> DataFrame:
    """Links and bounds of the departures that have a stand and a take-off, a row each."""
    dep = m.where("phase = 'DEP'").where(F.col("stand").isNotNull() & F.col("t_us").isNotNull())
    return with_links(dep.select("mvt_id", "airport", "stand", "actype", "t_us"), m).drop("_in", "t_us", "actype")


def with_rotation(dep: DataFrame, m: DataFrame) -> DataFrame:
    """Links, and the differences between the clocks of a departure and of the arrival that its stand links it to."""
    f = with_links(dep, m)
    return f.withColumns({
        "sched_to_takeoff": secs_between("t_us", "sched_us"), "eobt_delay": secs_between("eobt_us", "sched_us"), "iobt_delay": secs_between("iobt_us", "sched_us"),
        "lobt_delay": secs_between("lobt_us", "sched_us"), "inbound_arr_delay": secs_between("_in.block_us", "_in.sched_us"), "sched_ground": secs_between("sched_us", "_in.sched_us"),
        "actual_ground": F.col("ground_time_sec"), "aobt3_taxi": secs_between("t_us", "aobt_us"), "aobt3_vs_eobt": secs_between("aobt_us", "eobt_us"),
        "wake_match": F.col("wake") == F.col("_in.wake"), "inbound_actype": F.col("_in.actype"),
    }).drop("_in", "A_own_us", "A_next_us", "interval_sec", "ground_time_sec")


#: Columns of the rotation family.
ROTATION = (
    "inbound_mvt_id", "link_confidence", "type_match", "has_next", "bound_binding", "L_sec", "U_sec", "sched_to_takeoff", "eobt_delay", "iobt_delay", "lobt_delay",
    "inbound_arr_delay", "sched_ground", "actual_ground", "aobt3_taxi", "aobt3_vs_eobt", "wake_match", "inbound_actype",
)


def rotation(m: DataFrame) -> DataFrame:
    """The rotation family alone, a row per departure."""
    return with_rotation(m.where("phase = 'DEP'"), m).select("mvt_id", *ROTATION)


def stand_positions(stands: DataFrame) -> DataFrame:
    """``stands(airport, stand_name, lat, lon)`` -> mean position by ``(airport, key)``; a variant's base is a key too where no stand has it."""
    named = stands.withColumn("key", stand_key("stand_name")).withColumn("base", variant_base("key"))
    mean = [F.avg("lat").alias("lat"), F.avg("lon").alias("lon")]
    both = named.groupBy("airport", "key").agg(*mean).withColumn("prio", F.lit(0)).unionByName(named.groupBy("airport", F.col("base").alias("key")).agg(*mean).withColumn("prio", F.lit(1)))
    first = both.groupBy("airport", "key").agg(F.min_by(F.struct("lat", "lon"), "prio").alias("p"))
    return first.select("airport", "key", "p.lat", "p.lon")


def with_stand_position(m: DataFrame, positions: DataFrame) -> DataFrame:
    """``stand_lat`` and ``stand_lon`` of each movement's stand, by its key, else by the base of its variant."""
    keyed = m.withColumn("_key", stand_key("stand")).withColumn("_base", variant_base("_key"))

    def side(name: str) -> DataFrame:
        return positions.select(F.col("airport"), F.col("key").alias(name), F.struct("lat", "lon").alias(f"_p{name}"))

    joined = keyed.join(side("_key"), ["airport", "_key"], "left").join(side("_base"), ["airport", "_base"], "left")
    place = F.coalesce("_p_key", "_p_base")
    return joined.withColumn("stand_lat", place["lat"]).withColumn("stand_lon", place["lon"]).drop("_key", "_base", "_p_key", "_p_base")


GEOMETRY = ("stand_e_m", "stand_n_m", "rwy_e_m", "rwy_n_m", "dist_stand_rwy_m")


def with_geometry(dep: DataFrame, stands: DataFrame, runways: DataFrame) -> DataFrame:
    """Metres east and north of the airport's mean stand for a departure's stand and runway end, and between the two.

    ``stands(airport, stand_name, lat, lon)`` and ``runways(airport, runway, lat, lon)``; null where one is unknown.
    """
    origin = stands.groupBy("airport").agg(F.avg("lat").alias("_lat0"), F.avg("lon").alias("_lon0"))
    ends = runways.select("airport", "runway", F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"))
    f = with_stand_position(dep, stand_positions(stands)).join(origin, "airport", "left").join(ends, ["airport", "runway"], "left")
    (se, sn), (re, rn) = planar_metres("stand_lat", "stand_lon", "_lat0", "_lon0"), planar_metres("_rlat", "_rlon", "_lat0", "_lon0")
    metres = dict(zip(GEOMETRY, (se, sn, re, rn, F.hypot(se - re, sn - rn)), strict=True))
    return f.withColumns({c: x.cast("float") for c, x in metres.items()}).drop("_lat0", "_lon0", "_rlat", "_rlon", "stand_lat", "stand_lon")


def realised_queue(m: DataFrame) -> DataFrame:
    """Departures ahead at a departure's own actual off-block: pushed back strictly before and not yet airborne, at the airport and
    on its runway, those that pushed back in the 15 minutes before, and how long those ahead had waited. Whole seconds."""
    whole = lambda c: F.floor(F.col(c) / MICROS) * MICROS
    dep = m.where("phase = 'DEP'").select("mvt_id", "airport", "runway", whole("aobt_us").alias("a"), whole("t_us").alias("t"))
    how = {"anchor": "a", "start": "a", "end": "t"}
    by_airport = temporal.queue(dep, **how, by=["airport"], prefix="q", recent=900)
    by_runway = temporal.queue(dep, **how, by=["airport", "runway"], prefix="r").select("mvt_id", F.col("r_ahead").alias("q_ahead_rwy"))
    return by_airport.join(by_runway, "mvt_id").withColumnsRenamed({"q_wait": "q_ahead_mean_wait", "q_recent": "q_push_15m"})


def atfm_days(slots: DataFrame, delays: DataFrame, traffic: DataFrame) -> DataFrame:
    """Daily traffic-flow figures by ``(apt, date)``: three published tables, full-outer joined; a table's absence leaves nulls.

    ``slots(apt, flt_date, dep, reg, in_slot, late)``, ``delays(apt, flt_date, arr, dly, dly_w, dly_s)``,
    ``traffic(apt, flt_date, dep, arr, tot)``; dates are texts of which the first ten characters count.
    """
    day = F.expr("try_to_date(substring(flt_date, 1, 10), 'yyyy-MM-dd')").alias("date")
    a = slots.select("apt", day, guarded_ratio("reg", "dep").alias("reg_share"), guarded_ratio("in_slot", "reg").alias("in_slot_share"), guarded_ratio("late", "reg").alias("late_share"))
    b = delays.select("apt", day, guarded_ratio("dly", "arr").alias("dly_min_per_flight"), guarded_ratio("dly_w", "dly").alias("dly_weather_share"), guarded_ratio("dly_s", "dly").alias("dly_staffing_share"))
    c = traffic.select("apt", day, F.col("dep").alias("traffic_dep"), F.col("arr").alias("traffic_arr"), F.col("tot").alias("traffic_tot"))
    return a.join(b, ["apt", "date"], "full").join(c, ["apt", "date"], "full")


def with_atfm(dep: DataFrame, days: DataFrame, panel: DataFrame) -> DataFrame:
    """The day's figures of the departure's own airport and of its destination, and whether the ``panel(apt)`` has the destination."""
    columns = [c for c in days.columns if c not in ("apt", "date")]
    out = dep.withColumn("date", F.to_date("ts"))
    for prefix, key in (("dep", "airport"), ("des", "ades")):
        side = days.select(F.col("apt").alias(f"_{prefix}"), "date", *[F.col(c).alias(f"{prefix}_atfm_{c}") for c in columns])
        out = out.withColumn(f"_{prefix}", F.col(key)).join(side, [f"_{prefix}", "date"], "left").drop(f"_{prefix}")
    named = panel.select(F.col("apt").alias("ades"), F.lit(1).alias("_in")).distinct()
    return out.join(named, "ades", "left").withColumn("ades_in_panel", F.coalesce("_in", F.lit(0))).drop("_in", "date")


def with_weather(dep: DataFrame, hours: DataFrame) -> DataFrame:
    """The weather of the take-off's hour at the airport; ``has_ceiling`` tells no ceiling, or no report, from one."""
    columns = [c for c in hours.columns if c not in ("station", "hour")]
    side = hours.select(F.col("station").alias("airport"), F.col("hour").cast("timestamp").alias("_hour"), *columns)
    joined = dep.withColumn("_hour", F.date_trunc("hour", "ts")).join(side, ["airport", "_hour"], "left").drop("_hour")
    return joined.withColumn("has_ceiling", F.col("ceiling_ft").isNotNull().cast("int")).withColumn("ceiling_ft", F.coalesce("ceiling_ft", F.lit(NO_CEILING)))


def with_stand_group(dep: DataFrame) -> DataFrame:
    """Letters that a stand's name begins with; ``_`` where there are none."""
    return dep.withColumn("stand_group", extract_or("stand", r"^([A-Za-z]+)", "_"))


def build_features(
    m: DataFrame,
    *,
    priors: dict[str, DataFrame] | None = None,
    atfm: tuple[DataFrame, DataFrame] | None = None,
    queue: bool = False,
    weather: DataFrame | None = None,
    geometry: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per departure with all families: calendar, congestion, runway configuration and rotation, and on demand the others.

    Blind: a departure's own off-block and taxi time are hidden first, so the result doesn't depend on the split. Rows
    are carried from family to family through one exchange per key (airport, runway, stand); only the queue, whose
    sweep has rows of its own, is joined on the movement. ``atfm`` is days and panel, ``geometry`` stands and runways;
    ``weather`` is hours and ``priors`` what ``fit_priors`` gives. Those are dimensions and join by their keys.
    """
    seen = blind(m)
    out = with_stand_group(with_calendar(temporal.congestion(seen))).withColumn("sched_takeoff_offset", secs_between("t_us", "sched_us"))
    out = with_rotation(with_config(out, seen), seen)
    if queue:
        out = out.join(realised_queue(seen), "mvt_id", "left")
    if atfm is not None:
        out = with_atfm(out, *atfm)
    if geometry is not None:
        out = with_geometry(out, *geometry)
    if weather is not None:
        out = with_weather(out.withColumnRenamed("hour", "_h"), weather).withColumnRenamed("_h", "hour")
    return out if priors is None else apply_priors(out, priors)


#: Months whose rows are held out, and the feature frames of an export.
EXPORT = ("train", "labels", "holdout_gap", "ranking")


def export_frames(train: DataFrame, ranking: DataFrame, holdout: Sequence[str], **families) -> dict[str, DataFrame]:
    """The four frames that models read: features of all training months, their labels, features of the held-out months on their own
    (with the gap between them that the ranking has), and features of the ranking."""
    ym = F.date_format("ts", "yyyy-MM")
    labels = train.where("phase = 'DEP'").select("mvt_id", "airport", "runway", "stand", F.col("taxi").cast("bigint").alias("taxi"), secs_between("block_us", "sched_us").alias("d"), ym.alias("ym"))
    frames = (build_features(train, **families), labels, build_features(train.where(ym.isin(*holdout)), **families), build_features(ranking, **families))
    return dict(zip(EXPORT, frames, strict=True))


def clip_to_bounds(value: Column, low: Column, high: Column) -> Column:
    """A value moved into known bounds; an unknown bound doesn't bind."""
    return clip(value, low, high)
