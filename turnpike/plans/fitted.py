"""Priors, encodings, feature assembly, blends and model stages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnpike.functions import exprs as X
from turnpike.functions.exprs import n_rows
from turnpike.operators import blend as B
from turnpike.operators import encode as C
from turnpike.operators import features
from turnpike.operators import joins as J
from turnpike.operators import store
from turnpike.plans.joined import LINK_SQL
from turnpike.plans.registry import MOV, query
from turnpike.plans.relational import WEATHER, WX, observations
from turnpike.plans.temporal import _BINS, _ROLL, _SEG, CONGESTION, QUEUE, QUEUE_SQL
from turnpike.sources.tables import movements, table

PRIOR_LEVELS = (["l_suppkey", "l_returnflag"], ["l_returnflag", "l_linestatus"], ["l_returnflag"])


@query("select l_returnflag, l_linestatus, list_sort(list(l_quantity))[round((count(*) - 1) * 0.2::double)::bigint + 1] as prior, round(median(l_quantity), 6) as median, count(*) as n from lineitem where l_quantity between 2 and 48 group by all")
def fit_priors(s, d):
    p = C.group_prior(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", low=2, high=48)
    return p.select("l_returnflag", "l_linestatus", "prior", F.round("median", 6).alias("median"), "n")


@query("""with t as (select * from lineitem where l_orderkey % 4 <> 0 and l_quantity between 2 and 48 and l_suppkey % 5 <> 0),
       a as (select l_suppkey, l_returnflag, list_sort(list(l_quantity))[round((count(*) - 1) * 0.2::double)::bigint + 1] as p from t group by all),
       b as (select l_returnflag, list_sort(list(l_quantity))[round((count(*) - 1) * 0.2::double)::bigint + 1] as p from t group by all)
       select l_orderkey, l_linenumber, coalesce(a.p, b.p) as prior from lineitem left join a using (l_suppkey, l_returnflag) left join b using (l_returnflag) where l_orderkey % 4 = 0""")
def apply_priors(s, d):
    line = table(s, d, "lineitem")
    train = line.where("l_orderkey % 4 <> 0 and l_suppkey % 5 <> 0")
    levels = [(k, C.group_prior(train, k, "l_quantity", low=2, high=48).select(*k, "prior")) for k in (PRIOR_LEVELS[0], PRIOR_LEVELS[2])]
    test = line.where("l_orderkey % 4 = 0").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return J.backoff(test, levels, "prior").select("l_orderkey", "l_linenumber", "prior")


_ENC = """o as (select *, o_custkey % 20 as grp, strftime(o_orderdate, '%Y-%m') as ym, (o_orderstatus = 'F')::int as y from orders)"""


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 20).alias("grp"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice")


@query(f"""with {_ENC}, p as (select o_orderpriority, avg(y) as m from o group by all), g as (select o_orderpriority, grp, count(*) as n, sum(y) as s from o group by all)
       select o_orderpriority, grp, n, round((s + 30 * m) / (n + 30), 8)::double as enc from g join p using (o_orderpriority)""")
def smoothed_encoding(s, d):
    e = C.smoothed(_orders(s, d), group=["grp"], parent=["o_orderpriority"], target=F.col("y"))
    return e.select("o_orderpriority", "grp", "n", F.round("enc", 8).alias("enc"))


@query(f"""with {_ENC}, t as (select * from o where o_orderkey % 3 <> 0 and grp <> 7), p as (select o_orderpriority, avg(y) as m from t group by all), g as (select o_orderpriority, grp, count(*) as n, sum(y) as s from t group by all)
       select o_orderkey, coalesce(g.n, 0) as n, round(coalesce((s + 30 * p.m) / (g.n + 30), p.m), 8)::double as enc from o left join g using (o_orderpriority, grp) left join p using (o_orderpriority) where o_orderkey % 3 = 0""")
def apply_encoding(s, d):
    o = _orders(s, d)
    train = o.where("o_orderkey % 3 <> 0 and grp <> 7")
    enc = C.smoothed(train, group=["grp"], parent=["o_orderpriority"], target=F.col("y"))
    parents = train.groupBy("o_orderpriority").agg(F.avg("y").alias("mean"))
    out = C.apply_smoothed(o.where("o_orderkey % 3 = 0").select("o_orderkey", "grp", "o_orderpriority"), enc, parents, keys=["o_orderpriority", "grp"], parent=["o_orderpriority"])
    return out.select("o_orderkey", F.col("n").cast("bigint").alias("n"), F.round("enc", 8).alias("enc"))


def _oof(where: str = "true") -> str:
    return f"""with {_ENC}, own as (select o_orderpriority, grp, ym, count(*) as n, sum(y) as s from o where {where} group by all),
       par as (select o_orderpriority, ym, sum(n) as n, sum(s) as s from own group by all), po as (select o_orderpriority, ym, (sum(s) over (partition by o_orderpriority) - s) / nullif(sum(n) over (partition by o_orderpriority) - n, 0) as m from par),
       t as (select *, sum(n) over (partition by o_orderpriority, grp) - n as rn, sum(s) over (partition by o_orderpriority, grp) - s as rs from own)
       select o_orderpriority, grp, ym, rn::bigint as n, round((rs + 30 * m) / (rn + 30), 8)::double as enc from t join po using (o_orderpriority, ym)"""


@query(_oof())
def oof_encoding(s, d):
    e = C.out_of_fold(_orders(s, d), group=["grp"], parent=["o_orderpriority"], fold="ym", target=F.col("y"))
    return e.select("o_orderpriority", "grp", "ym", "n", F.round("enc", 8).alias("enc"))


@query(_oof("o_totalprice > 2500"))
def conditional_oof_rate(s, d):
    o = _orders(s, d).where("o_totalprice > 2500")
    e = C.out_of_fold(o, group=["grp"], parent=["o_orderpriority"], fold="ym", target=F.col("y"))
    return e.select("o_orderpriority", "grp", "ym", "n", F.round("enc", 8).alias("enc"))


@query("""with v as (select p_type, row_number() over (order by p_type) - 1 as code from (select distinct p_type from part where p_partkey % 2 = 0)) select p_partkey, coalesce(code, -1) as code from part left join v using (p_type)""")
def category_codes(s, d):
    p = table(s, d, "part")
    return C.encode(p.select("p_partkey", "p_type"), C.category_codes(p.where("p_partkey % 2 = 0"), "p_type"), "p_type", "code").select("p_partkey", "code")


@query("""select event_id, round(sin(dayofyear(ts) * (2 * 3.141592653589793 / 366)), 8) as doy_sin, round(cos((hour(ts) * 60 + minute(ts)) * (2 * 3.141592653589793 / 1440)), 8) as minute_cos from events""")
def cyclical_calendar(s, d):
    c = features.with_calendar(movements(s, d))
    return c.select(F.col("mvt_id").alias("event_id"), F.round("doy_sin", 8).alias("doy_sin"), F.round("minute_cos", 8).alias("minute_cos"))


_SECS = lambda x, y: f"trunc(({x} - {y}) / 1e6)::bigint"
_ROT = f"""rot as (select d.mvt_id, l.inbound_mvt_id, l.link_confidence, l.type_match, l.has_next, l.bound_binding, l."L_sec", l."U_sec", {_SECS('d.t_us', 'd.sched_us')} as sched_to_takeoff, {_SECS('d.eobt_us', 'd.sched_us')} as eobt_delay,
       {_SECS('d.iobt_us', 'd.sched_us')} as iobt_delay, {_SECS('d.lobt_us', 'd.sched_us')} as lobt_delay, {_SECS('a.block_us', 'a.sched_us')} as inbound_arr_delay, {_SECS('d.sched_us', 'a.sched_us')} as sched_ground, l.ground_time_sec as actual_ground,
       {_SECS('d.t_us', 'd.aobt_us')} as aobt3_taxi, {_SECS('d.aobt_us', 'd.eobt_us')} as aobt3_vs_eobt, d.wake = a.wake as wake_match, a.actype as inbound_actype
       from m d left join links l on l.mvt_id = d.mvt_id left join m a on a.mvt_id = l.inbound_mvt_id where d.phase = 'DEP')"""


@query(f"with {MOV}, {LINK_SQL}, {_ROT} select * from rot")
def rotation_schedule(s, d):
    return features.rotation(movements(s, d))


@query("select o_custkey, round(case when count(*) filter (where o_orderstatus = 'O') > 0 then sum(o_totalprice) / count(*) filter (where o_orderstatus = 'O') end, 4) as ratio from orders group by 1")
def guarded_ratios(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return g.select("o_custkey", F.round(X.guarded_ratio("a", "b"), 4).alias("ratio"))


@query("""select event_id, round(sqrt(pow((lon - 8.5) * cos(radians(47.4)) * 111320.0, 2) + pow((lat - 47.4) * 110540.0, 2)), 4) as metres from (select event_id, 47.4 + value / 1000 as lat, 8.5 + (user_id % 100) / 1000.0 as lon from events)""")
def planar_distance(s, d):
    e = table(s, d, "events").select("event_id", (F.lit(47.4) + F.col("value") / 1000).alias("lat"), (F.lit(8.5) + (F.col("user_id") % 100) / 1000.0).alias("lon"))
    east, north = X.planar_metres("lat", "lon", F.lit(47.4), F.lit(8.5))
    return e.select("event_id", F.round(F.hypot(east, north), 4).alias("metres"))


#: Stands of which some have no position, variants of others, and a key twice; runway ends at two of three places.
_PLACES = """st as (select distinct 'A' || (user_id % 10) as airport, case when user_id % 4 = 0 then 'Stand S' || user_id || 'L' else 'S ' || printf('%04d', user_id) end as stand_name, 47.0::double + (user_id % 17) / 1000.0::double as lat, 8.0::double + (user_id % 23) / 1000.0::double as lon from events where user_id % 6 <> 0
       union all select distinct 'A' || (user_id % 10), 'gate S' || user_id || 'R', 47.01::double + (user_id % 5) / 1000.0::double, 8.01::double from events where user_id % 4 = 0 and user_id % 6 <> 0),
       rw as (select 'A' || a as airport, 'R' || r as runway, 47.02::double + a / 1000.0::double as lat, 8.02::double + r / 100.0::double as lon from range(10) x(a), range(2) y(r)),
       sk as (select *, regexp_replace(regexp_replace(regexp_replace(upper(stand_name), '^(GATE|STAND|RAMP|PARKING|APRON|POS)\\s*', ''), '[\\s_\\-]', '', 'g'), '(^|[A-Z])0+(\\d)', '\\1\\2', 'g') as key from st),
       pos as (select airport, key, arg_min(lat, prio) as lat, arg_min(lon, prio) as lon from (select airport, key, avg(lat) as lat, avg(lon) as lon, 0 as prio from sk group by 1, 2 union all
               select airport, regexp_replace(key, '(\\d)[LRABC]$', '\\1'), avg(lat), avg(lon), 1 from sk group by 1, 2) group by 1, 2),
       origin as (select airport, avg(lat) as lat0, avg(lon) as lon0 from st group by 1),
       geo0 as (select d.mvt_id, (p.lon - lon0) * 111320.0 * cos(radians(lat0)) as stand_e_m, (p.lat - lat0) * 110540.0 as stand_n_m, (r.lon - lon0) * 111320.0 * cos(radians(lat0)) as rwy_e_m, (r.lat - lat0) * 110540.0 as rwy_n_m
                from m d left join pos p on p.airport = d.airport and p.key = d.stand left join origin o on o.airport = d.airport left join rw r on r.airport = d.airport and r.runway = d.runway where d.phase = 'DEP'),
       geo as (select *, sqrt(pow(stand_e_m - rwy_e_m, 2) + pow(stand_n_m - rwy_n_m, 2)) as dist_stand_rwy_m from geo0)"""


def _places(s, d):
    u = table(s, d, "events").select("user_id").distinct().where("user_id % 6 <> 0")
    k = F.col("user_id")
    airport, variant = F.concat(F.lit("A"), (k % 10).cast("string")).alias("airport"), k % 4 == 0
    name = F.when(variant, F.format_string("Stand S%dL", k)).otherwise(F.format_string("S %04d", k))
    left = u.select(airport, name.alias("stand_name"), (F.lit(47.0) + (k % 17) / 1000.0).alias("lat"), (F.lit(8.0) + (k % 23) / 1000.0).alias("lon"))
    right = u.where(variant).select(airport, F.format_string("gate S%dR", k).alias("stand_name"), (F.lit(47.01) + (k % 5) / 1000.0).alias("lat"), F.lit(8.01).alias("lon"))
    a, r = F.col("id") % 10, F.floor(F.col("id") / 10)
    runways = s.range(20).select(F.concat(F.lit("A"), a.cast("string")).alias("airport"), F.concat(F.lit("R"), r.cast("string")).alias("runway"), (F.lit(47.02) + a / 1000.0).alias("lat"), (F.lit(8.02) + r / 100.0).alias("lon"))
    return left.unionByName(right), runways


def _metres(columns):
    return [F.round(F.col(c).cast("double"), 1).alias(c) for c in columns]


@query(f"with {MOV}, {_PLACES} select mvt_id, {', '.join(f'round({c}::real::double, 1) as {c}' for c in features.GEOMETRY)} from geo")
def stand_geometry(s, d):
    dep = movements(s, d).where("phase = 'DEP'").select("mvt_id", "airport", "stand", "runway")
    return features.with_geometry(dep, *_places(s, d)).select("mvt_id", *_metres(features.GEOMETRY))


#: Days of traffic figures made of the movements; each of the three tables lacks some airports.
_ATFM = """day as (select airport as apt, ts::date as date, count(*) filter (where phase = 'DEP') as dep, count(*) filter (where phase = 'DEP' and user_id % 3 = 0) as reg, count(*) filter (where phase = 'DEP' and user_id % 6 = 0) as ins,
              count(*) filter (where phase = 'DEP' and user_id % 9 = 0) as late, count(*) filter (where phase = 'ARR') as arr, coalesce(sum(mvt_id % 7) filter (where phase = 'ARR'), 0)::bigint as dly, coalesce(sum(mvt_id % 3) filter (where phase = 'ARR'), 0)::bigint as dw,
              coalesce(sum(mvt_id % 2) filter (where phase = 'ARR'), 0)::bigint as ds from m group by all),
       sa as (select apt, date, case when dep > 0 then reg / dep end as reg_share, case when reg > 0 then ins / reg end as in_slot_share, case when reg > 0 then late / reg end as late_share from day where apt <> 'A1'),
       ad as (select apt, date, case when arr > 0 then dly / arr end as dly_min_per_flight, case when dly > 0 then dw / dly end as dly_weather_share, case when dly > 0 then ds / dly end as dly_staffing_share from day where apt <> 'A2'),
       tr as (select apt, date, dep as traffic_dep, arr as traffic_arr, dep + arr as traffic_tot from day where apt <> 'A3'),
       atfm as (select * from sa full join ad using (apt, date) full join tr using (apt, date))"""
ATFM = ["reg_share", "in_slot_share", "late_share", "dly_min_per_flight", "dly_weather_share", "dly_staffing_share", "traffic_dep", "traffic_arr", "traffic_tot"]


def _atfm(s, d):
    dep, arr, u, i = F.col("phase") == "DEP", F.col("phase") == "ARR", F.col("user_id"), F.col("mvt_id")
    of = lambda x: F.coalesce(F.sum(F.when(arr, x)), F.lit(0))
    day = movements(s, d).groupBy(F.col("airport").alias("apt"), F.to_date("ts").alias("date")).agg(
        F.count_if(dep).alias("dep"), F.count_if(dep & (u % 3 == 0)).alias("reg"), F.count_if(dep & (u % 6 == 0)).alias("in_slot"), F.count_if(dep & (u % 9 == 0)).alias("late"),
        F.count_if(arr).alias("arr"), of(i % 7).alias("dly"), of(i % 3).alias("dly_w"), of(i % 2).alias("dly_s"),
    )
    day = day.withColumn("tot", F.col("dep") + F.col("arr")).withColumn("flt_date", F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z")))
    traffic = day.where("apt <> 'A3'")
    return features.atfm_days(day.where("apt <> 'A1'"), day.where("apt <> 'A2'"), traffic), traffic.select("apt")


@query(f"with {MOV}, {_ATFM} select apt, date, {', '.join(f'round({c}, 9) as {c}' if 'traffic' not in c else c for c in ATFM)} from atfm")
def atfm_daily(s, d):
    return _atfm(s, d)[0].select("apt", "date", *[F.round(c, 9).alias(c) if "traffic" not in c else c for c in ATFM])


@query("""with k as (select upper(p_name) as full_key, regexp_replace(upper(p_brand), '[0-9]$', '') as base, p_retailprice as x from part), a as (select full_key as key, avg(x) as x, 1 as prio from k group by 1 union all select base, avg(x), 2 from k group by 1)
       select key, round(arg_min(x, prio), 6) as x from a group by key""")
def position_priority(s, d):
    k = table(s, d, "part").select(F.upper("p_name").alias("full_key"), F.regexp_replace(F.upper("p_brand"), "[0-9]$", "").alias("base"), F.col("p_retailprice").alias("x"))
    exact = k.groupBy(F.col("full_key").alias("key")).agg(F.avg("x").alias("x")).withColumn("prio", F.lit(1))
    both = exact.unionByName(k.groupBy(F.col("base").alias("key")).agg(F.avg("x").alias("x")).withColumn("prio", F.lit(2)))
    return both.groupBy("key").agg(F.round(F.min_by("x", "prio"), 6).alias("x"))


_BLIND = MOV.replace("m as (", "raw as (", 1) + ", m as (select * replace (case when phase = 'DEP' then null else block_us end as block_us, case when phase = 'DEP' then null else taxi end as taxi) from raw)"
_CORE = ["mvt_id", "airport", "runway", "stand", "stand_group", "actype", "sched_takeoff_offset", "hour", "dow", "month", "doy", "is_weekend", "minute_of_day", *CONGESTION, "dep_rwy_config", "arr_rwy_config", "n_active_dep_rwy", "n_active_arr_rwy", "mins_since_cfg_change", *features.ROTATION]
_ALL = f"""{_BLIND}, {LINK_SQL}, {_ROT}, {_ROLL}, {_BINS}, {_SEG},
       core as (select k.* exclude (t_us, ts), {_SECS('k.t_us', 'k.sched_us')} as sched_takeoff_offset, coalesce(nullif(regexp_extract(k.stand, '^([A-Za-z]+)', 1), ''), '_') as stand_group, hour(k.ts)::int as hour, isodow(k.ts)::int as dow, month(k.ts)::int as month, dayofyear(k.ts)::int as doy,
              (isodow(k.ts) >= 6)::int as is_weekend, (hour(k.ts) * 60 + minute(k.ts))::int as minute_of_day, r.* exclude (mvt_id), g.* exclude (airport, bin), k.t_us, k.ts
              from congestion k join rot r using (mvt_id) join seg g on g.airport = k.airport and g.bin = k.t_us // 300000000)"""


@query(f"with {_ALL} select {', '.join(_CORE)} from core".replace("L_sec", '"L_sec"').replace('""L_sec""', '"L_sec"').replace("U_sec", '"U_sec"').replace('""U_sec""', '"U_sec"'))
def build_features(s, d):
    """The flagship: calendar, congestion, runway configuration and rotation of the departures, blind, in one plan."""
    return features.build_features(movements(s, d)).select(*_CORE)


_PRIORS = """lab as (select *, coalesce(nullif(regexp_extract(stand, '^([A-Za-z]+)', 1), ''), '_') as stand_group from raw where phase = 'DEP' and taxi between 60 and 5400 and mvt_id % 3 <> 0),
       ps as (select airport, stand, list_sort(list(taxi))[round((count(*) - 1) * 0.2::double)::bigint + 1] as u, median(taxi) as md, count(*) as n from lab group by 1, 2),
       pg as (select airport, stand_group, runway, list_sort(list(taxi))[round((count(*) - 1) * 0.2::double)::bigint + 1] as u, count(*) as n from lab group by 1, 2, 3),
       pr as (select airport, runway, list_sort(list(taxi))[round((count(*) - 1) * 0.2::double)::bigint + 1] as u, median(taxi) as md from lab group by 1, 2),
       pa as (select airport, list_sort(list(taxi))[round((count(*) - 1) * 0.2::double)::bigint + 1] as u, median(taxi) as md from lab group by 1)"""
_FAMILIES = ["ades_in_panel", *[f"{p}_atfm_{c}" for p in ("dep", "des") for c in ("reg_share", "dly_weather_share", "traffic_tot")], *QUEUE, "has_ceiling", *WEATHER, "unimpeded_taxi", "median_taxi_prior", "n_stand", "n_sg_rwy"]


def _shown(name: str) -> str:
    return {"ceiling_ft": "coalesce(ceiling_ft, 99999.0) as ceiling_ft", "has_ceiling": "(ceiling_ft is not null)::int as has_ceiling"}.get(name, f"round({name}, 6)::double as {name}" if name in _INEXACT else name)


_INEXACT = {"temp_c", "dewpoint_c", "temp_dewpoint_spread_c", "unimpeded_taxi", "median_taxi_prior", "q_ahead_mean_wait"} | {f"{p}_atfm_{c}" for p in ("dep", "des") for c in ATFM if "traffic" not in c}


@query(f"""with {_ALL}, {WX}, {_ATFM}, {QUEUE_SQL.replace("dep as (", "qdep as (").replace("from dep ", "from qdep ").replace("join dep ", "join qdep ")}, {_PLACES}, {_PRIORS}
       select c.mvt_id, c.stand_group, c.sched_takeoff_offset, {', '.join(f'round({g}::real::double, 1) as {g}' for g in features.GEOMETRY)}, {', '.join(_shown(f) for f in _FAMILIES)}
       from (select core.*, (p.apt is not null)::int as ades_in_panel, a.reg_share as dep_atfm_reg_share, a.dly_weather_share as dep_atfm_dly_weather_share, a.traffic_tot as dep_atfm_traffic_tot, b.reg_share as des_atfm_reg_share, b.dly_weather_share as des_atfm_dly_weather_share,
             b.traffic_tot as des_atfm_traffic_tot, coalesce(ps.u, pg.u, pr.u, pa.u) as unimpeded_taxi, coalesce(ps.md, pr.md, pa.md) as median_taxi_prior, coalesce(ps.n, 0) as n_stand, coalesce(pg.n, 0) as n_sg_rwy
             from core left join atfm a on a.apt = core.airport and a.date = core.ts::date left join atfm b on b.apt = core.ades and b.date = core.ts::date left join (select distinct apt from tr) p on p.apt = core.ades
             left join ps on ps.airport = core.airport and ps.stand = core.stand left join pg on pg.airport = core.airport and pg.stand_group = core.stand_group and pg.runway = core.runway
             left join pr on pr.airport = core.airport and pr.runway = core.runway left join pa on pa.airport = core.airport) c
       join queue q using (mvt_id) join geo using (mvt_id) left join hours h on h.station = c.airport and h.hour = date_trunc('hour', c.ts)""")
def feature_families(s, d):
    """All families at once: traffic flow, realised queue, geometry, weather and priors beside the core."""
    m = movements(s, d)
    labelled = features.with_stand_group(m.where("phase = 'DEP' and mvt_id % 3 <> 0"))
    out = features.build_features(m, priors=C.fit_priors(labelled), atfm=_atfm(s, d), queue=True, weather=features.weather_hours(observations(s, d)), geometry=_places(s, d))
    return out.select("mvt_id", "stand_group", "sched_takeoff_offset", *_metres(features.GEOMETRY), *[F.round(c, 6).alias(c) if c in _INEXACT else c for c in _FAMILIES])


@query(f"""with {MOV}, x as (select *, strftime(ts, '%Y-%m-%d') as ym from m)
       select 'train' as frame, count(*) as n, count(distinct mvt_id) as ids from x where phase = 'DEP' union all select 'labels', count(*), count(distinct mvt_id) from x where phase = 'DEP'
       union all select 'holdout_gap', count(*), count(distinct mvt_id) from x where phase = 'DEP' and strftime(ts, '%Y-%m') = '2024-01' union all select 'ranking', count(*), count(distinct mvt_id) from x where phase = 'DEP' and mvt_id % 2 = 0""")
def export_frames(s, d):
    """The four frames of an export, by their rows."""
    m = movements(s, d)
    frames = features.export_frames(m, m.where("mvt_id % 2 = 0"), ["2024-01"])
    parts = [f.agg(F.lit(name).alias("frame"), n_rows().alias("n"), F.count_distinct("mvt_id").alias("ids")) for name, f in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_BLEND = f"""{MOV}, x as (select mvt_id, airport, taxi, least(1.0, user_id / 150.0) as p, ((t_us - sched_us) / 1e6)::double as off, case when user_id % 5 <> 0 then (taxi * 0.9 + 50)::double end as prior, (700 + value)::double as model from m where phase = 'DEP')"""


def _parts(s, d):
    dep = movements(s, d).where("phase = 'DEP'")
    return dep.select(
        "mvt_id", "airport", "taxi", F.least(F.lit(1.0), F.col("user_id") / 150.0).alias("p"), ((F.col("t_us") - F.col("sched_us")) / 1_000_000).alias("off"),
        F.when(F.col("user_id") % 5 != 0, F.col("taxi") * 0.9 + 50).alias("prior"), (700 + F.col("value")).alias("model"),
    )


@query(f"with {_BLEND} select mvt_id, round(p * greatest(0, least(140000, off)) + (1 - p) * coalesce(prior, greatest(0, least(750, model))), 4)::double as taxi from x")
def reconstruct_blend(s, d):
    r = B.reconstruct(F.col("p"), F.col("off"), F.col("prior"), F.col("model"), 750.0)
    return _parts(s, d).select("mvt_id", F.round(r, 4).alias("taxi"))


@query(f"with {_BLEND} select mvt_id, round(case when airport in ('A1', 'A4') then off - model else model end, 4)::double as taxi from x")
def mixed_target_select(s, d):
    return _parts(s, d).select("mvt_id", F.round(F.when(F.col("airport").isin("A1", "A4"), F.col("off") - F.col("model")).otherwise(F.col("model")), 4).alias("taxi"))


@query(f"with {_BLEND} select mvt_id, round(greatest(0, case when off <= 1200 then off + (model - 750) else off end), 4)::double as taxi from x")
def corrector_apply(s, d):
    from turnpike.operators.models import corrected

    return _parts(s, d).select("mvt_id", F.round(corrected(F.col("off"), F.col("model") - 750, most=1200.0), 4).alias("taxi"))


#: Departures with what a surface track says of them: tiers, quality, a late pushback and partial tracks; A3 is excluded.
_TRACKED = f"""{MOV}, x as (select mvt_id, airport, taxi, (700 + value)::double as pred, case mvt_id % 4 when 0 then 'appear' when 1 then 'dwell' when 2 then 'pass' end as tier, case when mvt_id % 4 < 3 then taxi * 0.8::double + user_id % 90 + case when airport = 'A2' then 60 else 20 end end as track_taxi,
       (mvt_id % 90)::double as pb_dist_m, (mvt_id % 8)::double as pb_speed, (mvt_id % 60)::double as pb_gap_s, mvt_id % 5 <> 0 as matched, case when mvt_id % 6 <> 0 then (mvt_id % 1200)::double end as first_own_m, taxi * 0.7::double as seen_s from m where phase = 'DEP'),
       el as (select *, coalesce(tier in ('appear', 'dwell'), false) and airport <> 'A3' as e from x), f as (select *, track_taxi - taxi as late from el where e), pooled as (select median(late) as pooled from f),
       lags as (select airport, case when count(*) >= 60 then median(late) else (select pooled from pooled) end as lag from f group by airport),
       cor as (select el.*, track_taxi - coalesce(lag, pooled) as c from el left join lags using (airport), pooled),
       wt as (select tier, greatest(0, least(1, sum((taxi - pred) * (c - pred)) / greatest(sum(pow(c - pred, 2)), 1e-9))) as w from cor where e group by tier),
       wc as (select airport, tier, greatest(0, least(1, sum((taxi - pred) * (c - pred)) / greatest(sum(pow(c - pred, 2)), 1e-9))) as w from cor where e group by airport, tier having count(*) >= 75),
       wd as (select cor.*, coalesce(wc.w, wt.w, 0) as w, case when coalesce(pb_dist_m <= 70 and case when tier = 'appear' then pb_speed <= 5 else pb_gap_s <= 40 end, false) then 'good' else 'poor' end as ql from cor left join wt using (tier) left join wc using (airport, tier)),
       q as (select tier, ql, greatest(0, sum((taxi - pred) * w * (c - pred)) / greatest(sum(pow(w * (c - pred), 2)), 1e-9)) as mult from wd where e group by tier, ql),
       bl as (select wd.*, case when e then pred + wd.w * (c - pred) else pred end as blend, case when e then pred + greatest(0, least(1, wd.w * coalesce(mult, 1))) * (c - pred) else pred end as blendq from wd left join q using (tier, ql))"""


def _tracked(s, d):
    i, taxi = F.col("mvt_id"), F.col("taxi")
    tier = F.when(i % 4 == 0, "appear").when(i % 4 == 1, "dwell").when(i % 4 == 2, "pass")
    late = F.when(F.col("airport") == "A2", 60).otherwise(20)
    return movements(s, d).where("phase = 'DEP'").select(
        "mvt_id", "airport", "taxi", (700 + F.col("value")).alias("pred"), tier.alias("tier"), F.when(i % 4 < 3, taxi * 0.8 + F.col("user_id") % 90 + late).alias("track_taxi"),
        (i % 90).cast("double").alias("pb_dist_m"), (i % 8).cast("double").alias("pb_speed"), (i % 60).cast("double").alias("pb_gap_s"), (i % 5 != 0).alias("matched"),
        F.when(i % 6 != 0, (i % 1200).cast("double")).alias("first_own_m"), (taxi * 0.7).alias("seen_s"),
    )


_BLEND_HOW = {"excluded": ("A3",), "lag_rows": 60, "cell_rows": 75}


@query(f"with {_TRACKED} select mvt_id, round(blend, 4)::double as taxi from bl")
def pushback_blend(s, d):
    x = _tracked(s, d)
    return B.PushbackBlend.fit(x, **_BLEND_HOW).apply(x).select("mvt_id", F.round("blend", 4).alias("taxi"))


@query(f"with {_TRACKED} select mvt_id, ql as quality, round(blendq, 4)::double as taxi from bl")
def quality_blend(s, d):
    x = _tracked(s, d)
    fitted = B.PushbackBlend.fit(x, **_BLEND_HOW).fit_quality(x)
    return fitted.apply(x).select("mvt_id", B.detection_quality().alias("quality"), F.round("blend", 4).alias("taxi"))


_PARTIAL = """pm as (select *, blend as base, matched and not coalesce(tier in ('appear', 'dwell'), false) and coalesce(first_own_m < 1000, false) and airport <> 'A3' as k, first_own_m / 1000 as km, taxi - seen_s as unseen from bl),
       bo as (select quantile_cont(unseen, 0.01) as lo, quantile_cont(unseen, 0.99) as hi from pm where k), py as (select pm.*, greatest(lo, least(hi, unseen)) as y from pm, bo where k),
       gr as (select airport, count(*) >= 40 as big from py group by 1), pg as (select py.*, case when big then airport end as g from py join gr using (airport)),
       gm as (select g, count(*) as n, avg(km) as mx, avg(y) as my, sum(km * y) as sxy, sum(km * km) as sxx from pg group by g), sl as (select sum(sxy - n * mx * my) / sum(sxx - n * mx * mx) as slope from gm),
       it as (select g, my - slope * mx as a from gm, sl), sh as (select coalesce(max(a) filter (where g is null), 0) as shared from it),
       es as (select pm.*, seen_s + coalesce(it.a, shared) + slope * km as est from pm left join it on it.g = pm.airport, sl, sh),
       pw as (select first_own_m < 500 as near, greatest(0, least(1, sum((taxi - base) * (est - base)) / greatest(sum(pow(est - base, 2)), 1e-9))) as w from es where k group by 1)"""


@query(f"with {_TRACKED}, {_PARTIAL} select mvt_id, k as used, round(case when k then base + pw.w * (est - base) else base end, 4)::double as taxi from es left join pw on pw.near = (first_own_m < 500)")
def partial_track_blend(s, d):
    x = _tracked(s, d)
    x = B.PushbackBlend.fit(x, **_BLEND_HOW).apply(x, "base")
    out = B.PartialTracks.fit(x, excluded=("A3",), least=40).apply(x)
    return out.select("mvt_id", B.partial_mask(("A3",)).alias("used"), F.round("partial", 4).alias("taxi"))


@query(f"with {_BLEND} select round(sqrt(avg(pow(case when abs(off - taxi) < 30 then 0 else model - taxi end, 2))), 6) as routed, round(sqrt(avg(pow(model - taxi, 2))), 6) as plain from x")
def oracle_routing(s, d):
    e = F.col("model") - F.col("taxi")
    hit = F.when(F.abs(F.col("off") - F.col("taxi")) < 30, 0.0).otherwise(e)
    sq = lambda c: F.round(F.sqrt(F.avg(F.pow(c, F.lit(2)))), 6)
    return _parts(s, d).agg(sq(hit).alias("routed"), sq(e).alias("plain"))


#: Holdout and ranking of a staged stack: two engines' predictions beside the tracks; even movements are the ranking.
_STAGED = _TRACKED.replace("x as (select mvt_id, airport, taxi, (700 + value)::double as pred,", """x0 as (select *, (700 + value)::double as a, (300 + taxi * 0.5::double + user_id) as b from m where phase = 'DEP'),
       gs as (select sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, sum(a*taxi) ay, sum(b*taxi) b_y from x0 where mvt_id % 2 = 1), ws as (select (bb*ay - ab*b_y) / (aa*bb - ab*ab) as wa, (aa*b_y - ab*ay) / (aa*bb - ab*ab) as wb, ay / aa as oa, b_y / bb as ob, aa, bb, ay, b_y from gs),
       sw as (select case when wa >= 0 and wb >= 0 then wa when ay * oa >= b_y * ob then oa else 0 end as sa, case when wa >= 0 and wb >= 0 then wb when ay * oa >= b_y * ob then 0 else ob end as sb from ws),
       x as (select mvt_id, airport, taxi, a * sa + b * sb as pred,""").replace("as seen_s from m where phase = 'DEP')", "as seen_s, mvt_id % 2 = 1 as ho from x0, sw)")
_STAGED = _STAGED.replace("from el where e)", "from el where e and ho)").replace("from cor where e group", "from cor where e and ho group").replace("from wd where e group", "from wd where e and ho group")


def _partial_sql(p: str, base: str) -> str:
    names = ("pm", "bo", "py", "gr", "pg", "gm", "sl", "it", "sh", "es", "pw")
    sql = _PARTIAL.replace("blend as base", f"{base} as base")
    for n in names:
        sql = re.sub(rf"\b{n}\b", f"{p}{n}", sql)
    return sql.replace(f"from {p}pm, {p}bo where k)", f"from {p}pm, {p}bo where k and ho)").replace(f"from {p}pm where k)", f"from {p}pm where k and ho)").replace(f"from {p}es where k group", f"from {p}es where k and ho group")


_CLIPPED = "round_even(greatest(0, least(case when airport = 'A3' then 140000 else 10800 end, {})), 0)::int as taxi"


@query(f"""with {_STAGED}, {_partial_sql('p', 'blend')}, {_partial_sql('q', 'blendq')}
       select 'stack' as stage, mvt_id, {_CLIPPED.format('pred')} from bl where not ho union all select 'blend', mvt_id, {_CLIPPED.format('blend')} from bl where not ho
       union all select 'partial', mvt_id, {_CLIPPED.format('case when k then base + ppw.w * (est - base) else base end')} from pes left join ppw on ppw.near = (first_own_m < 500) where not ho
       union all select 'quality', mvt_id, {_CLIPPED.format('case when k then base + qpw.w * (est - base) else base end')} from qes left join qpw on qpw.near = (first_own_m < 500) where not ho""")
def staged_stack(s, d):
    """Submissions by stage: stack of two engines, blend, partial tracks, and both by quality."""
    from turnpike.operators import models

    m = movements(s, d).where("phase = 'DEP'").select("mvt_id", (700 + F.col("value")).alias("a"), (300 + F.col("taxi") * 0.5 + F.col("user_id")).alias("b"))
    x = _tracked(s, d).drop("pred").join(m, "mvt_id")
    stages = models.staged_stack(x.where("mvt_id % 2 = 1"), x.where("mvt_id % 2 = 0"), ["a", "b"], **_BLEND_HOW)
    return reduce(DataFrame.unionByName, [f.withColumn("stage", F.lit(name)) for name, f in stages.items()])


@query(f"""with {MOV}, x as (select mvt_id, taxi, airport in ('A1', 'A4') and coalesce(mvt_id % 3 < 2, false) as eligible, (abs(d) < 300)::int as is_echo, (user_id % 100) / 100.0::double as e1, (user_id % 50) / 50.0::double as e2, (700 + value)::double as m1, (800 + value / 2)::double as m2,
       (750 + value)::double as base, taxi * 0.9::double + 40 as track, day(ts) % 2 = 1 as odd from m where phase = 'DEP'),
       l as (select median(track - taxi) as lag from x where eligible and odd and is_echo = 0), c as (select x.*, 0.6::double * (1 - e1) * (track - lag - m1) + 0.4::double * (1 - e2) * (track - lag - m2) as c from x, l),
       w as (select greatest(0, least(1, sum((taxi - base) * c) / greatest(sum(c * c), 1e-9))) as w from c where eligible and odd)
       select mvt_id, round(case when eligible then base + w * c else base end, 4)::double as taxi from c, w""")
def echo_mixture(s, d):
    """One weight and lag fitted on odd days, for the part of two engines that isn't the echo."""
    from turnpike.operators import models

    u, v = F.col("user_id"), F.col("value")
    x = movements(s, d).where("phase = 'DEP'").select(
        "mvt_id", "taxi", (F.col("airport").isin("A1", "A4") & (F.col("mvt_id") % 3 < 2)).alias("eligible"), (F.abs("d") < 300).cast("int").alias("is_echo"), (u % 100 / 100.0).alias("echo_a"),
        (u % 50 / 50.0).alias("echo_b"), (700 + v).alias("raw_a"), (800 + v / 2).alias("raw_b"), (750 + v).alias("base"), (F.col("taxi") * 0.9 + 40).alias("track_taxi"), (F.dayofmonth("ts") % 2 == 1).alias("odd"),
    )
    return models.echo_mixture(x, {"a": 0.6, "b": 0.4}, fit=F.col("odd")).select("mvt_id", F.round("mixture", 4).alias("taxi"))


@query(f"with {_BLEND} select mvt_id, round(p * greatest(0, least(200000, off - model)) + (1 - p) * model, 4)::double as taxi from x")
def tail_router(s, d):
    from turnpike.operators.models import tail_routed

    return _parts(s, d).select("mvt_id", F.round(tail_routed(F.col("p"), F.col("model"), F.col("off"), F.col("model")), 4).alias("taxi"))


MODEL_FEATURES = ("l_quantity", "l_discount", "l_tax", "flag")


def _model_rows(s, d):
    line = table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice", (F.year("l_shipdate") % 3).cast("string").alias("fold"))
    # Keys of lines repeat; rows are numbered once and kept.
    codes = C.category_codes(line, "l_returnflag")
    return store.cut(C.encode(line, codes, "l_returnflag", "flag").withColumn("key", F.monotonically_increasing_id()))


@query()
def model_regressor(s, d):
    """Boosted trees fitted on two thirds of the rows, predictions for the rest; rows only."""
    from turnpike.operators import models

    rows = _model_rows(s, d)
    model = models.fit_regressor(rows.where("fold <> '0'"), MODEL_FEATURES, F.col("l_extendedprice"), alpha=20_000.0, rounds=4)
    return models.predict(model, rows.where("fold = '0'"), MODEL_FEATURES, "pred").select("key", "l_extendedprice", "pred")


@query()
def model_echo_classifier(s, d):
    """Probability that a price is above a limit, fitted on two thirds of the rows; rows only."""
    from turnpike.operators import models

    rows = _model_rows(s, d)
    model = models.fit_classifier(rows.where("fold <> '0'"), MODEL_FEATURES, (F.col("l_extendedprice") > 35000).cast("int"), rounds=4)
    return models.predict(model, rows.where("fold = '0'"), MODEL_FEATURES, "prob").select("key", "prob")


@query()
def model_month_folds(s, d):
    """Out-of-fold predictions by fold; rows only."""
    from turnpike.operators import models

    return models.month_folds(_model_rows(s, d), MODEL_FEATURES, F.col("l_extendedprice"), fold="fold", folds=("0", "1", "2"), key="key", rounds=2, alpha=20_000.0)


_COLUMNS = ("sched_takeoff_offset", "hour", "dow", "n_dep_30m_prev", "n_dep_15m_next", "prev_gap", "sat_run", "L_sec", "U_sec", "actual_ground", "aobt3_taxi")


def _framed(s, d):
    """Features and labels of the departures, with weeks in the role of months, kept in the shared folder."""
    m = movements(s, d)
    ym = F.concat(F.lit("w"), F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)).cast("string"))
    labels = features.with_stand_group(m.where("phase = 'DEP'")).select("mvt_id", "airport", "operator", "stand", "stand_group", "runway", "taxi", "d", ym.alias("ym"))
    frame = features.build_features(m).select("mvt_id", "airport", "operator", "stand", "stand_group", "runway", *_COLUMNS)
    return store.cut(frame), store.cut(labels)


_ENCODED = [f"{g}_{n}" for g in ("op", "stand") for n in ("echo_rate", "mean_d", "n")]


def _encoded_sql(name: str, key: str) -> str:
    of_group, of_fold = f"partition by airport, {key}", f"partition by airport, {key}, ym"
    others = lambda x, group, fold: f"sum({x}) over ({group}) - sum({x}) over ({fold})"
    mean = lambda x: f"(({others(x, 'partition by airport', 'partition by airport, ym')}) / nullif({others('k', 'partition by airport', 'partition by airport, ym')}, 0))"
    parts = [f"case when {key} is null then {mean(x)} else (({others(x, of_group, of_fold)}) + 30 * {mean(x)}) / (({others('k', of_group, of_fold)}) + 30) end as {name}_{n}" for x, n in (("e", "echo_rate"), ("c", "mean_d"))]
    return ", ".join([*parts, f"case when {key} is null then 0 else {others('k', of_group, of_fold)} end::bigint as {name}_n"])


@query(f"""with {MOV}, lab as (select mvt_id, airport, operator, stand, 'w' || least((day(ts) - 1) // 8, 3) as ym, case when mvt_id % 23 <> 0 then d end as d0 from m where phase = 'DEP'),
       k as (select *, (d0 is not null)::int as k, coalesce((abs(d0) < 30)::int, 0)::double as e, (case when d0 is null then 0 else greatest(-3600, least(10800, d0)) end)::double as c from lab),
       x as (select mvt_id, {_encoded_sql('op', 'operator')}, {_encoded_sql('stand', 'stand')} from k)
       select mvt_id, {', '.join(c if c.endswith('_n') else f'round({c}, 8) as {c}' for c in _ENCODED)} from x""")
def group_encodings(s, d):
    """Echo rates and mean delays of operators and stands, from the other weeks."""
    from turnpike.operators import models

    ym = F.concat(F.lit("w"), F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)).cast("string"))
    rows = movements(s, d).where("phase = 'DEP'").select("mvt_id", "airport", "operator", "stand", ym.alias("ym"), F.when(F.col("mvt_id") % 23 != 0, F.col("d")).alias("d"))
    out = models.with_group_encodings(rows.drop("d"), rows, fold="ym")
    return out.select("mvt_id", *[F.col(c) if c.endswith("_n") else F.round(c, 8).alias(c) for c in _ENCODED])


@query("""select p_partkey, (p_size > 25)::tinyint as large, p_size, coalesce(v.code, -1) as p_type from part left join (select p_type, row_number() over (order by p_type) - 1 as code from (select distinct p_type from part where p_partkey % 2 = 0)) v using (p_type)""")
def model_matrix(s, d):
    """Features as a model reads them: flags as numbers, texts as codes, no clocks."""
    p = table(s, d, "part").withColumn("large", F.col("p_size") > 25).withColumn("seen", F.lit("2024-01-01").cast("timestamp"))
    vocabulary = C.category_codes(p.where("p_partkey % 2 = 0"), "p_type")
    return C.model_matrix(p.drop("p_name", "p_brand"), ["p_retailprice"], {"p_type": vocabulary})


_RUN_HOW = {"columns": _COLUMNS, "flipped": ("A3",), "rounds": 2, "depth": 3, "patience": 1}


@query()
def model_run(s, d):
    """Holdout of the last week from the others, and the ranking (the first week again, under new ids) after a refit; rows only."""
    from turnpike.operators import models

    frame, labels = _framed(s, d)
    held = frame.join(labels.where("ym = 'w3'").select("mvt_id"), "mvt_id", "left_semi")
    new = frame.join(labels.where("ym = 'w0'").select("mvt_id"), "mvt_id", "left_semi").withColumn("mvt_id", -F.col("mvt_id") - 1)
    out = models.run(frame, labels, ["w0", "w1", "w2"], ["w3"], held, new, valid_month="w2", **_RUN_HOW)
    return out["holdout"].withColumn("part", F.lit("holdout")).unionByName(out["ranking"].withColumn("part", F.lit("ranking")))


@query()
def model_corrector(s, d):
    """Out-of-fold predictions of the weeks, resumable, and the residual corrector fitted on two of them; rows only."""
    from turnpike.operators import models

    frame, labels = _framed(s, d)
    path = store.folder(s, "folds")
    models.run_folds(frame, labels, ["w0", "w1", "w2"], path, valid_of=lambda m: "w1" if m == "w2" else "w2", **_RUN_HOW)
    folds = s.read.parquet(path).select("mvt_id", "pred", F.col("fold").cast("string").alias("fold"))
    rows = store.cut(folds.join(labels.select("mvt_id", "taxi"), "mvt_id").join(frame, "mvt_id"))
    model = models.fit_corrector(rows.where("fold <> 'w2'"), _COLUMNS, rounds=2)
    return models.apply_corrector(model, rows.where("fold = 'w2'")).select("mvt_id", "taxi", "pred", "corrected")
