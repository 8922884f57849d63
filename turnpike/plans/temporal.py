"""Windowed, sessionised and sweep-line queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnpike.functions.exprs import n_rows, planar_metres
from turnpike.operators import features, tracks
from turnpike.operators import temporal as T
from turnpike.plans.registry import MOV, query
from turnpike.sources.tables import movements, table


def _count(keys: str, lo: int, hi: int) -> str:
    return f"count(*) over (partition by {keys} order by t_us range between {abs(lo)} {'preceding' if lo < 0 else 'following'} and {abs(hi)} {'preceding' if hi < 0 else 'following'})"


_ROLL = f"""roll as (select *, {_count('airport', -1799999999, 0)} as n_dep_30m_prev, {_count('airport', -3599999999, 0)} as n_dep_60m_prev, {_count('airport', 1, 900000000)} as n_dep_15m_next,
       case when runway is not null then {_count('airport, runway', -1799999999, 0)} end as n_deprwy_30m_prev, case when runway is not null then {_count('airport, runway', 1, 900000000)} end as n_deprwy_15m_next,
       trunc((t_us - lag(t_us) over (partition by airport, runway order by t_us, mvt_id)) / 1e6)::bigint as prev_gap
       from (select *, sum((phase = 'ARR')::int) over (partition by airport order by t_us range between 1799999999 preceding and 1800000000 following)::bigint as n_arr_60m_around from m) where phase = 'DEP'),
   runs as (select *, sum((coalesce(prev_gap, 9999) >= 120)::int) over (partition by airport, runway order by t_us, mvt_id rows unbounded preceding) as run from roll),
   congestion as (select * exclude (run), (row_number() over (partition by airport, runway, run order by t_us, mvt_id) - 1)::bigint as sat_run, n_dep_30m_prev / 30.0 as dep_pressure from runs)"""
CONGESTION = ["n_dep_30m_prev", "n_dep_60m_prev", "n_dep_15m_next", "n_deprwy_30m_prev", "n_deprwy_15m_next", "n_arr_60m_around", "prev_gap", "sat_run"]


@query(f"with {MOV}, {_ROLL} select mvt_id, {', '.join(CONGESTION)}, round(dep_pressure, 6)::double as pressure from congestion")
def rolling_counts(s, d):
    return T.congestion(movements(s, d)).select("mvt_id", *CONGESTION, F.round("dep_pressure", 6).alias("pressure"))


@query(f"with {MOV}, a as (select *, sum((phase = 'ARR')::int) over (partition by airport order by t_us range between 1799999999 preceding and 1800000000 following)::bigint as n from m) select mvt_id, n from a where phase = 'DEP'")
def arrivals_around(s, d):
    m = T.around_count(movements(s, d), by=["airport"], time="t_us", counted=F.col("phase") == "ARR", back=1800, ahead=1800, name="n")
    return m.where("phase = 'DEP'").select("mvt_id", "n")


@query(f"with {MOV}, {_ROLL} select mvt_id, prev_gap as gap from congestion")
def prev_gap(s, d):
    dep = movements(s, d).where("phase = 'DEP'").select("mvt_id", "airport", "runway", "t_us")
    return T.previous_gap(dep, by=["airport", "runway"], time="t_us", tie="mvt_id").select("mvt_id", F.col("prev_gap").alias("gap"))


# Of a fortieth of the gaps as they are, few are under two minutes; runs show where time is cut to a fortieth.
@query(f"""with {MOV}, x as (select mvt_id, airport, runway, t_us // 40 as t_us from m where phase = 'DEP'), g as (select *, trunc((t_us - lag(t_us) over (partition by airport, runway order by t_us, mvt_id)) / 1e6)::bigint as gap from x),
       r as (select *, sum((coalesce(gap, 9999) >= 120)::int) over (partition by airport, runway order by t_us, mvt_id rows unbounded preceding) as run from g)
       select mvt_id, gap, row_number() over (partition by airport, runway, run order by t_us, mvt_id) - 1 as run_place from r""")
def saturation_run(s, d):
    dep = movements(s, d).where("phase = 'DEP'").select("mvt_id", "airport", "runway", F.floor(F.col("t_us") / 40).alias("t_us"))
    runs = T.saturation(dep, by=["airport", "runway"], time="t_us", tie="mvt_id", block=600)
    return runs.select("mvt_id", F.col("prev_gap").alias("gap"), F.col("sat_run").alias("run_place"))


def _config(phase: str, name: str) -> str:
    own = f"filter (where phase = '{phase}')"
    named = f"coalesce(string_agg(distinct runway, '+' order by runway) filter (where phase = '{phase}' and runway is not null), '')"
    return f"""case when count(*) {own} > 0 then {named} else '?' end as {name}_rwy_config,
       (count(distinct runway) {own} + coalesce(max((runway is null)::int) {own}, 0))::bigint as n_active_{name}_rwy, count(*) {own} as n_{name}"""


_BINS = f"bins as (select airport, t_us // 300000000 as bin, {_config('DEP', 'dep')}, {_config('ARR', 'arr')} from m group by all)"
_SEG = """c as (select *, lag(dep_rwy_config) over w as before, lag(bin) over w as bin_before from bins window w as (partition by airport order by bin)),
       g as (select *, sum(coalesce((dep_rwy_config <> before or (bin - bin_before) * 300 > 86400), true)::int) over (partition by airport order by bin rows unbounded preceding) as segment from c),
       seg as (select *, (bin - min(bin) over (partition by airport, segment)) * 300 / 60.0::double as mins_since_cfg_change from g)"""


@query(f"with {MOV}, {_BINS} select * from bins")
def runway_config_bins(s, d):
    return T.config_bins(movements(s, d))


@query(f"with {MOV}, {_BINS}, {_SEG} select airport, bin, mins_since_cfg_change as mins from seg")
def mins_since_change(s, d):
    return T.change_segments(T.config_bins(movements(s, d))).select("airport", "bin", F.col("mins_since_cfg_change").alias("mins"))


QUEUE_SQL = """dep as (select mvt_id, airport, runway, aobt_us // 1000000 as a, t_us // 1000000 as t from m where phase = 'DEP'),
       j as (select x.mvt_id, count(b.mvt_id) as n, sum(x.a - b.a) as waited from dep x left join dep b on x.airport = b.airport and b.t > b.a and b.a < x.a and b.t > x.a group by 1),
       k as (select x.mvt_id, count(b.mvt_id) as n from dep x left join dep b on x.airport = b.airport and x.runway = b.runway and b.t > b.a and b.a < x.a and b.t > x.a group by 1),
       l as (select x.mvt_id, count(b.mvt_id) as n from dep x left join dep b on x.airport = b.airport and b.t > b.a and b.a >= x.a - 900 and b.a < x.a group by 1),
       queue as (select mvt_id, case when a is not null then j.n end as q_ahead, case when a is not null then l.n end as q_push_15m, case when a is not null and runway is not null then k.n end as q_ahead_rwy,
              case when a is not null and j.n > 0 then least(3600, greatest(0, waited::double / j.n)) end as q_ahead_mean_wait from dep join j using (mvt_id) join k using (mvt_id) join l using (mvt_id))"""
QUEUE = ["q_ahead", "q_push_15m", "q_ahead_rwy"]


@query(f"with {MOV}, {QUEUE_SQL} select mvt_id, {', '.join(QUEUE)}, round(q_ahead_mean_wait, 3)::double as q_ahead_mean_wait from queue")
def realised_queue(s, d):
    return features.realised_queue(movements(s, d)).select("mvt_id", *QUEUE, F.round("q_ahead_mean_wait", 3).alias("q_ahead_mean_wait"))


@query(f"with {MOV} select airport, runway, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by airport), 8) as share from m where runway is not null group by airport, runway")
def share_over(s, d):
    c = movements(s, d).where("runway is not null").groupBy("airport", "runway").agg(n_rows().alias("n"))
    return c.select("airport", "runway", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("airport")), 8).alias("share"))


def _track(s, d):
    e = table(s, d, "events")
    return e.select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("t"), "value").groupBy("user_id", "t").agg(F.max("value").alias("speed"))


#: Events as points of aircraft: a minute stands for a second, so that runs have several points; positions lie about one stand.
_POINTS = """points as (select 'A' || (hex % 10) as airport, hex, t, date '2024-01-01' as day, e.event_id % 13 * 4.0::double as gs, 47.4::double + e.event_id % 5 * 0.0004::double as lat, 8.5::double + e.event_id % 7 * 0.0004::double as lon
       from (select user_id as hex, epoch_us(ts) // 60000000 as t, max(event_id) as event_id from events group by all) e)"""
_RUNS = f"""{_POINTS}, f as (select *, gs < 40 as ground, lag(gs < 40) over w as before, t - lag(t) over w as gap, coalesce(not (lead(gs < 40) over w) and lead(t) over w - t <= 720, false) as gone from points window w as (partition by hex order by t)),
       r as (select *, sum(coalesce(not before or gap > 1440, true)::int) over (partition by hex order by t rows unbounded preceding) as run from f),
       rp as (select *, lead(t) over (partition by hex, run order by t) as next_t from r where ground), own as (select *, sqrt(pow((lon - 8.5) * 111320.0 * cos(radians(47.4)), 2) + pow((lat - 47.4) * 110540.0, 2)) as own_m from rp),
       runs as (select hex, run, count(*) as n_points, min(t) as first_t, max(t) as last_t, bool_or(gone and next_t is null) as takes_off from rp group by hex, run)"""
#: The pushback of a group of run points, after its rule: the last still point at the stand, else the first point there.
_PUSH = """min(t) as first_t, max(t) filter (where own_m < 100 and gs <= 1) as still_t, min(t) filter (where own_m < 100) as seen_t, min(own_m) as min_own_m"""


def _points(s, d):
    e = table(s, d, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000))
    p = e.groupBy(F.col("user_id").alias("hex"), "t").agg(F.max("event_id").alias("i"))
    return p.select(
        F.concat(F.lit("A"), (F.col("hex") % 10).cast("string")).alias("airport"), "hex", "t", F.lit("2024-01-01").cast("date").alias("day"), (F.col("i") % 13 * 4.0).alias("gs"),
        (F.lit(47.4) + F.col("i") % 5 * 0.0004).alias("lat"), (F.lit(8.5) + F.col("i") % 7 * 0.0004).alias("lon"),
    )


@query(f"with {_RUNS} select hex, n_points, first_t, last_t, takes_off from runs")
def surface_runs(s, d):
    return T.surface_runs(_points(s, d), by=["hex"], time="t", speed="gs", gap=1440, takeoff=720).select("hex", "n_points", "first_t", "last_t", "takes_off")


@query(f"""with {_RUNS}, g as (select hex, run, {_PUSH} from own join runs using (hex, run) where takes_off group by hex, run),
       k as (select *, case when still_t is not null then 'dwell' when seen_t = g.first_t then 'appear' when seen_t is not null then 'pass' end as tier, coalesce(still_t, seen_t) as k_t from g)
       select k.hex, k.first_t, k.tier, case when k.tier = 'dwell' then coalesce(p.next_t, p.t) else p.t end as pushback_t, p.next_t - p.t as pb_gap_s, p.gs as pb_speed, round(p.own_m, 6) as pb_dist_m, round(k.min_own_m, 6) as min_own_m
       from k left join own p on p.hex = k.hex and p.run = k.run and p.t = k.k_t""")
def pushback_tier(s, d):
    rows = T.run_points(_points(s, d), by=["hex"], time="t", speed="gs", gap=1440, takeoff=720)
    east, north = planar_metres("lat", "lon", F.lit(47.4), F.lit(8.5))
    rows = rows.withColumn("own_m", F.hypot(east, north)).withColumn("gone", F.max("takes_off").over(Window.partitionBy("hex", "run"))).where("gone")
    found = T.pushback(rows, by=["hex", "run"], time="t", speed="gs", distance="own_m")
    return found.select("hex", "first_t", "tier", "pushback_t", "pb_gap_s", "pb_speed", F.round("pb_dist_m", 6).alias("pb_dist_m"), F.round("min_own_m", 6).alias("min_own_m"))


#: Departures of the same clock as the points, from stands of which every third has no position.
_STANDS = """stands as (select distinct 'A' || (user_id % 10) as airport, 'STAND-' || printf('%03d', user_id) as stand_name, 47.4::double as lat, 8.5::double as lon from events where user_id % 3 <> 0)"""


@query(f"""with recursive {MOV}, {_RUNS}, {_STANDS}, pos as (select distinct airport, lat, lon from stands),
       dep as (select m.mvt_id, m.airport, m.t_us / 60000000.0::double as mvt_t, case when m.stand is not null and m.user_id % 3 <> 0 then 47.4::double end as s_lat from m where m.phase = 'DEP'),
       ends as (select 'A' || (hex % 10) as airport, hex, run, last_t from runs where takes_off and 'A' || (hex % 10) in (select airport from pos)),
       near as (select d.mvt_id, e.airport, e.hex, e.run, abs(e.last_t - d.mvt_t) as off, p.t, p.next_t, p.gs, case when d.s_lat is not null then p.own_m end as own_m
                from dep d join ends e on e.airport = d.airport and e.last_t >= d.mvt_t - 180 and e.last_t < d.mvt_t + 180 join own p on p.hex = e.hex and p.run = e.run),
       cand as (select mvt_id, airport, hex, run, off, {_PUSH} from near group by mvt_id, airport, hex, run, off),
       ranked as (select *, row_number() over (partition by airport order by not coalesce(min_own_m < 100, false), off, mvt_id, hex, run) as i from cand),
       greedy as (select airport, 0::bigint as i, []::bigint[] as ms, []::varchar[] as rs, null::bigint as mvt_id, null::bigint as hex, null::bigint as run from (select distinct airport from ranked)
                  union all
                  select g.airport, r.i, case when ok then list_append(ms, r.mvt_id) else ms end, case when ok then list_append(rs, r.hex || '/' || r.run) else rs end,
                         case when ok then r.mvt_id end, case when ok then r.hex end, case when ok then r.run::bigint end
                  from greedy g join ranked r on r.airport = g.airport and r.i = g.i + 1, lateral (select not list_contains(ms, r.mvt_id) and not list_contains(rs, r.hex || '/' || r.run) as ok) o),
       taken as (select c.*, case when still_t is not null then 'dwell' when seen_t = first_t then 'appear' when seen_t is not null then 'pass' end as tier from greedy g join cand c on c.mvt_id = g.mvt_id and c.hex = g.hex and c.run = g.run)
       select d.mvt_id, d.airport, x.mvt_id is not null as matched, x.tier, case when x.tier = 'dwell' then coalesce(p.next_t, p.t) else p.t end as pushback_t, round(x.min_own_m, 6) as min_own_m, p.next_t - p.t as pb_gap_s, p.gs as pb_speed
       from dep d left join taken x on x.mvt_id = d.mvt_id left join own p on p.hex = x.hex and p.run = x.run and p.t = coalesce(x.still_t, x.seen_t)""")
def pushback_detect(s, d):
    """Pushbacks of all departures from the points of their airport, matched one to one."""
    m = movements(s, d).withColumn("t_us", F.col("t_us") / 60)
    stands = table(s, d, "events").where("user_id % 3 <> 0").select(
        F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("airport"), F.format_string("STAND-%03d", "user_id").alias("stand_name"), F.lit(47.4).alias("lat"), F.lit(8.5).alias("lon")
    )
    m = m.withColumn("stand", F.when(F.col("stand").isNotNull(), F.format_string("%d", "user_id")))
    points = _points(s, d).withColumnRenamed("t", "ts")
    found = tracks.detect_pushbacks(m, points, stands.distinct(), gap=1440, takeoff=720)
    return found.select("mvt_id", "airport", "matched", "tier", "pushback_t", F.round("min_own_m", 6).alias("min_own_m"), "pb_gap_s", "pb_speed")


@query("""with track as (select user_id, epoch_us(ts) // 60000000 as t, max(value) as speed from events group by all), f as (select *, speed < 20 as st, lag(speed < 20) over (partition by user_id order by t) as b from track),
       r as (select *, sum(coalesce(st <> b, true)::int) over (partition by user_id order by t rows unbounded preceding) as run from f), sp as (select user_id, run, first(st) as st, min(t) as a, max(t) as z from r group by all)
       select user_id, max(z) filter (where st and z - a >= 180) as dwell_end from sp group by user_id""")
def last_dwell(s, d):
    return T.last_dwell(_track(s, d), by=["user_id"], time="t", speed="speed", still=20.0)


@query(f"""with {MOV}, p as (select (day(ts) % 2)::int as half, airport, avg(taxi) as lag from m group by all)
       select m.mvt_id, round(p.lag, 6) as lag from m join p on p.airport = m.airport and p.half = 1 - (day(m.ts) % 2)""")
def cross_fit(s, d):
    m = movements(s, d).withColumn("half", F.dayofmonth("ts") % 2)
    # Parameters of one half score the other.
    fitted = m.groupBy("half", "airport").agg(F.avg("taxi").alias("lag")).withColumn("half", 1 - F.col("half"))
    return m.join(fitted, ["half", "airport"]).select("mvt_id", F.round("lag", 6).alias("lag"))


@query(f"""with {MOV}, days as (select ts::date as day, sum(pow(taxi - 900, 2) - pow(taxi - 950, 2)) as gain, count(*) as n from m group by 1), r as (select *, row_number() over (order by gain desc, day) as r from days)
       select count(*) as days, round(sum(gain) / sum(n), 6) as gain from r where r > 3""")
def drop_best_days(s, d):
    gain = F.pow(F.col("taxi") - 900, F.lit(2)) - F.pow(F.col("taxi") - 950, F.lit(2))
    days = movements(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.sum(gain).alias("gain"), n_rows().alias("n"))
    r = days.withColumn("r", F.row_number().over(Window.orderBy(F.desc("gain"), "day"))).where("r > 3")
    return r.agg(n_rows().alias("days"), F.round(F.sum("gain") / F.sum("n"), 6).alias("gain"))
