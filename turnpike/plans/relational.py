"""Scans, projections, filters, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnpike.functions import exprs as X
from turnpike.operators import store
from turnpike.plans.registry import MOV, query
from turnpike.sources import sinks
from turnpike.sources import tables as S
from turnpike.sources.tables import movements, table


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def scan_project(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select l_orderkey, l_quantity from lineitem where l_shipdate < timestamp '1996-01-01' and l_quantity > 30")
def scan_filter_pushdown(s, d):
    return table(s, d, "lineitem").where((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 30)).select("l_orderkey", "l_quantity")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m') as ym from orders where strftime(o_orderdate, '%Y-%m') in ('1996-01', '1996-07')")
def split_loader(s, d):
    return S.split_by_month(table(s, d, "orders"), "holdout", "o_orderdate", ["1996-01", "1996-07"]).select("o_orderkey", "ym")


@query("select o_orderkey, try_cast(substr(o_orderdate::varchar, 1, 10) as date) as day from orders")
def parse_date_prefix(s, d):
    return table(s, d, "orders").withColumn("text", F.col("o_orderdate").cast("string")).select("o_orderkey", S.date_prefix("text").alias("day"))


def _by_day(s, d):
    """Events written to folders by day, in the session's shared folder."""
    path = store.folder(s, "days")
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    sinks.write_parquet(e.repartition("day"), path, partition_by=["day"])
    return path


@query("select event_id, value, ts::date as day from events where ts::date between date '2024-01-05' and date '2024-01-06'")
def partitioned_scan(s, d):
    """Two days of a table in folders by day: the others are neither listed nor read."""
    return S.read_days(s, _by_day(s, d), "2024-01-05", "2024-01-06").select("event_id", "value", "day")


@query("select ts::date as day, count(*) as n, min(event_id) as first_id from events group by 1")
def all_days(s, d):
    return S.read_days(s, _by_day(s, d)).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("""select 'h' || user_id as hex, event_id % 4 = 0 as is_ground, case when event_id % 4 <> 0 then value end as alt_baro, case when event_id % 2 <> 0 then value / 2 end as track, count(*) as n
       from (select *, row_number() over (partition by user_id, event_id // 2 order by event_id) as k from events) where ts::date = date '2024-01-05' group by all""")
def schema_unify(s, d):
    """Points of the old schema (ground as an altitude) and of the new, of one day."""
    e = table(s, d, "events").withColumns({"hex": F.concat(F.lit("h"), F.col("user_id").cast("string")), "airport": F.lit("A"), "t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    point = [F.col("hex"), F.col("airport"), F.col("t").alias("ts")]
    ground = F.col("event_id") % 4 == 0
    old = e.where("event_id % 2 = 0").select(*point, F.when(ground, S.OLD_GROUND).otherwise(F.col("value")).alias("alt"))
    new = e.where("event_id % 2 <> 0").select(*point, F.col("value").alias("alt_raw"), ground.alias("is_ground"), (F.col("value") / 2).alias("track"))
    day = S.points_of_day(S.unify_points(old, new), "2024-01-05")
    return day.groupBy("hex", "is_ground", "alt_baro", "track").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, i - 1 as at, case i when 1 then 0.0 else value end as dt, case when i = 1 then value end as lat, case when i = 1 and event_id % 3 <> 0 then value * 2 end as alt_raw, i = 1 and event_id % 3 = 0 as is_ground,
       case when i = 1 then 12.5 end as gs, case when i = 1 and event_id % 5 = 0 then 'mlat' end as src from events, (values (1), (2)) t(i)""")
def json_trace_explode(s, d):
    """Traces whose points hold numbers, the word ground, objects and nulls."""
    v, i = F.col("value").cast("string"), F.col("event_id")
    altitude = F.when(i % 3 == 0, F.lit('"ground"')).otherwise((F.col("value") * 2).cast("string"))
    source = F.when(i % 5 == 0, F.lit('"mlat"')).otherwise(F.lit('{"alt": 1}'))
    trace = F.concat(F.lit("[[0, "), v, F.lit(", 8.5, "), altitude, F.lit(', 12.5, null, 0, 0, {"flight": "X", "n": [1]}, '), source, F.lit("], ["), v, F.lit("]]"))
    return S.trace_points(table(s, d, "events").withColumn("trace", trace), "trace", ["event_id"]).select("event_id", F.col("at").cast("bigint").alias("at"), "dt", "lat", "alt_raw", "is_ground", "gs", "src")


@query("""with l as (select event_id as no, case when event_id % 3 = 0 then 1300 else 1301 end as code, event_type, user_id from events),
       c as (select *, max(case when code = 1300 then no end) over (order by no) as stand_no from l), a as (select stand_no, arg_max(event_type, no) as width, arg_max(user_id, no) as airline from c where code = 1301 group by 1)
       select s.no as stand_no, s.user_id::double as lat, 'jets' as aircraft_classes, 'gate ' || s.event_type as name, coalesce(a.width, '') as width, coalesce('a' || a.airline || ' b', '') as airlines from l s left join a on a.stand_no = s.no where s.code = 1300""")
def text_record_parse(s, d):
    e = table(s, d, "events")
    user = F.col("user_id").cast("string")
    stand = F.concat(F.lit("1300 "), user, F.lit(" 2.5 90 gate jets gate "), F.col("event_type"))
    line = F.when(F.col("event_id") % 3 == 0, stand).otherwise(F.concat(F.lit("1301 "), F.col("event_type"), F.lit(" airline a"), user, F.lit(" b")))
    return S.records_of_text(e.select(F.col("event_id").alias("line_no"), line.alias("value"))).select("stand_no", "lat", "aircraft_classes", "name", "width", "airlines")


@query("""select event_id as no, r as runway, case when r = '09' then value else value + 1 end as lat, case when r = '09' then 8.5 else 8.6 end as lon, case when r = '09' then 100.0 else 0.0 end as displaced_m, 45.0 as width_m, case when r = '09' then '27' else '09' end as opposite
       from events, (values ('09'), ('27')) t(r) where event_id % 2 = 0""")
def runway_record_parse(s, d):
    e = table(s, d, "events")
    v = F.col("value").cast("string")
    line = F.concat(F.lit("100 45 1 0 0.25 0 2 1 09 "), v, F.lit(" 8.5 100 0 1 1 1 0 27 "), (F.col("value") + 1).cast("string"), F.lit(" 8.6 0 0 1 1 0 0"))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 2 == 0, line).otherwise("100 45 1 too short").alias("value"))
    return S.runways_of_text(lines)


@query("""with p as (select o_orderkey as id, case when o_orderkey % 7 = 0 then null else o_totalprice - 2000 end as pred from orders where o_orderkey % 10 <> 0),
       t as (select o_orderkey as id from orders where o_orderkey % 3 <> 0)
       select 'missing' as issue, (select count(*) from t where id not in (select id from p)) as n
       union all select 'extra', (select count(*) from p where id not in (select id from t))
       union all select 'null', (select count(*) from p where pred is null)
       union all select 'negative', (select count(*) from p where pred < 0)
       union all select 'repeated', (select count(*) - count(distinct id) from p)""")
def submission_conform(s, d):
    o = table(s, d, "orders")
    p = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") - 2000).alias("pred"))
    t = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))
    return sinks.check_submission(t, p, id_col="id", value_col="pred")


@query("""with p as (select o_orderkey as id, o_totalprice / 8 as pred from orders where o_orderkey % 10 <> 0)
       select o_orderkey as id, round_even(p.pred, 0)::int as pred from orders left join p on o_orderkey = id where o_orderkey % 3 <> 0 and p.pred is not null""")
def submission_rounded(s, d):
    o = table(s, d, "orders")
    p = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 8).alias("pred"))
    t = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))
    return sinks.conform(t.join(p, "id", "left_semi"), p, id_col="id", value_col="pred")


@query("""with c as (select o_orderkey, list_sort(list_filter(['o_orderkey', 'o_custkey', case when o_orderkey % 2 = 0 then 'o_orderstatus' end, case when o_orderkey % 3 = 0 then 'o_totalprice' end], lambda x: x is not null)) as names from orders)
       select o_orderkey, sha256(array_to_string(names, ',')) as digest from c""")
def feature_hash(s, d):
    """Digests of the sorted names of the features that a row has."""
    k = F.col("o_orderkey")
    names = F.array_compact(F.array(F.lit("o_orderkey"), F.lit("o_custkey"), F.when(k % 2 == 0, "o_orderstatus"), F.when(k % 3 == 0, "o_totalprice")))
    return table(s, d, "orders").select("o_orderkey", F.sha2(F.array_join(F.sort_array(names), ","), 256).alias("digest"))


@query("select event_id, case when value >= 20 then value end as value from events")
def nan_as_null(s, d):
    e = table(s, d, "events")
    return e.select("event_id", X.nan_to_null(F.when(F.col("value") < 20, float("nan")).otherwise(F.col("value"))).alias("value"))


@query("""select event_id, hour(ts)::int as hour, isodow(ts)::int as dow, month(ts)::int as month, dayofyear(ts)::int as doy, (isodow(ts) >= 6)::int as weekend,
       (hour(ts) * 60 + minute(ts))::int as minute_of_day from events""")
def calendar_features(s, d):
    dow = X.iso_weekday("ts")
    return table(s, d, "events").select(
        "event_id", F.hour("ts").alias("hour"), dow.cast("int").alias("dow"), F.month("ts").alias("month"), F.dayofyear("ts").alias("doy"),
        (dow >= 6).cast("int").alias("weekend"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"),
    )


@query("select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_discount <= 0.05 and l_returnflag <> 'R'")
def filter_conj(s, d):
    return table(s, d, "lineitem").where((F.col("l_quantity") >= 10) & (F.col("l_discount") <= 0.05) & (F.col("l_returnflag") != "R")).select("l_orderkey", "l_linenumber")


@query("select o_orderkey from orders where o_totalprice between 1000 and 5000")
def filter_between(s, d):
    return table(s, d, "orders").where(F.col("o_totalprice").between(1000, 5000)).select("o_orderkey")


@query("select event_id from events where event_type in ('click', 'purchase')")
def filter_isin(s, d):
    return table(s, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id")


@query(f"with {MOV} select mvt_id, coalesce(runway = 'R1', false) as ok from m")
def null_safe_mask(s, d):
    return movements(s, d).select("mvt_id", X.null_safe(F.col("runway") == "R1").alias("ok"))


#: Events as weather observations: several an hour and station, boundary values of the flight categories among them.
WX = """wx as (select 'A' || (user_id % 10) as station, date_trunc('minute', ts) as valid, case when event_id % 11 <> 0 then (event_id % 80)::double end as tmpf, case when event_id % 13 <> 0 then (event_id % 61)::double end as dwpf,
       (event_id % 360)::double as drct, (event_id % 31)::double as sknt, case when event_id % 3 = 0 then (event_id % 50)::double end as gust, case when event_id % 7 <> 0 then ((event_id % 13) / 2.0)::double end as vsby,
       case when event_id % 5 <> 0 then ((event_id % 4) / 10.0)::double end as p01i, ['FEW', 'BKN', 'CLR', 'OVC'][(event_id % 4 + 1)::bigint] as skyc1, ['SCT', 'OVC', 'VV'][(event_id % 3 + 1)::bigint] as skyc2, case when event_id % 6 = 0 then 'BKN' end as skyc3,
       (event_id % 9 * 500)::double as skyl1, (event_id % 8 * 500)::double as skyl2, (event_id % 10 * 100)::double as skyl3, ['-SN BR', 'FZRA', '+TSRA', null, 'HZ', 'RA'][(event_id % 6 + 1)::bigint] as wxcodes, event_id from events),
       one as (select station, valid, arg_min(w, event_id) as w from wx w group by all),
       obs as (select station, valid, date_trunc('hour', valid) as hour, w.vsby as vis_mi, least(case when w.skyc1 in ('BKN', 'OVC', 'VV') then w.skyl1 end, case when w.skyc2 in ('BKN', 'OVC', 'VV') then w.skyl2 end, case when w.skyc3 in ('BKN', 'OVC', 'VV') then w.skyl3 end) as ceiling_ft,
       (w.tmpf - 32) / 1.8::double as temp_c, (w.dwpf - 32) / 1.8::double as dewpoint_c, w.drct as wind_dir, w.sknt as wind_kt, w.gust as gust_kt, w.p01i as precip_1h_in,
       coalesce(regexp_matches(w.wxcodes, 'SN|SG|PL|GS|GR'), false) as wx_snow, coalesce(contains(w.wxcodes, 'FZ'), false) as wx_freezing, coalesce(contains(w.wxcodes, 'TS'), false) as wx_tstorm, coalesce(regexp_matches(w.wxcodes, 'FG|BR|HZ|FU|VA|DU|SA'), false) as wx_obscuration from one),
       der as (select *, temp_c - dewpoint_c as temp_dewpoint_spread_c, temp_c < 0 as below_freezing, (temp_c < 0) and (coalesce(precip_1h_in, 0) > 0 or wx_snow or wx_freezing) as deicing_risk,
       case when coalesce(vis_mi < 1, false) or coalesce(ceiling_ft, 99999) < 500 then 'LIFR' when coalesce(vis_mi < 3, false) or coalesce(ceiling_ft, 99999) < 1000 then 'IFR' when coalesce(vis_mi < 5, false) or coalesce(ceiling_ft, 99999) < 3000 then 'MVFR' else 'VFR' end as flight_category from obs),
       hours as (select * exclude (valid) from der qualify row_number() over (partition by station, hour order by valid desc) = 1)"""


def observations(s, d):
    """One observation per station and minute, that of the smallest event."""
    i = F.col("event_id")
    pick = lambda values, n: F.array(*[F.lit(v) for v in values])[(i % n).cast("int")]
    unless = lambda n, x: F.when(i % n != 0, x)
    e = table(s, d, "events").select(
        F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("station"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("valid"), i,
        unless(11, (i % 80).cast("double")).alias("tmpf"), unless(13, (i % 61).cast("double")).alias("dwpf"), (i % 360).cast("double").alias("drct"), (i % 31).cast("double").alias("sknt"),
        F.when(i % 3 == 0, (i % 50).cast("double")).alias("gust"), unless(7, (i % 13) / 2.0).alias("vsby"), unless(5, (i % 4) / 10.0).alias("p01i"),
        pick(("FEW", "BKN", "CLR", "OVC"), 4).alias("skyc1"), pick(("SCT", "OVC", "VV"), 3).alias("skyc2"), F.when(i % 6 == 0, "BKN").alias("skyc3"),
        (i % 9 * 500).cast("double").alias("skyl1"), (i % 8 * 500).cast("double").alias("skyl2"), (i % 10 * 100).cast("double").alias("skyl3"), pick(("-SN BR", "FZRA", "+TSRA", None, "HZ", "RA"), 6).alias("wxcodes"),
    )
    rest = [c for c in e.columns if c not in ("station", "valid", "event_id")]
    return e.groupBy("station", "valid").agg(F.min_by(F.struct(*rest), "event_id").alias("r")).select("station", "valid", "r.*")


WEATHER = ["vis_mi", "ceiling_ft", "temp_c", "dewpoint_c", "temp_dewpoint_spread_c", "below_freezing", "deicing_risk", "wx_snow", "wx_freezing", "wx_tstorm", "wx_obscuration", "flight_category", "wind_dir", "wind_kt", "gust_kt", "precip_1h_in"]
_ROUNDED = ("temp_c", "dewpoint_c", "temp_dewpoint_spread_c")


@query(f"with {WX} select station, hour, {', '.join(f'round({c}, 9) as {c}' if c in _ROUNDED else c for c in WEATHER)} from hours")
def weather_hourly(s, d):
    from turnpike.operators.features import weather_hours

    h = weather_hours(observations(s, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    return h.select("station", "hour", *[F.round(c, 9).alias(c) if c in _ROUNDED else F.col(c) for c in WEATHER])


@query("""with w as (select event_id, case when event_id % 10 <> 0 then event_id % 13 * 250.0::double end as ceiling, case when event_id % 17 <> 0 then (user_id % 12)::double / 2 end as vis from events)
       select event_id, case when coalesce(vis < 1, false) or coalesce(ceiling < 500, false) then 'LIFR' when coalesce(vis < 3, false) or coalesce(ceiling < 1000, false) then 'IFR'
              when coalesce(vis < 5, false) or coalesce(ceiling < 3000, false) then 'MVFR' else 'VFR' end as category from w""")
def flight_category(s, d):
    from turnpike.operators.features import flight_category as category

    i = F.col("event_id")
    w = table(s, d, "events").select(i, F.when(i % 10 != 0, i % 13 * 250.0).alias("ceiling"), F.when(i % 17 != 0, (F.col("user_id") % 12).cast("double") / 2).alias("vis"))
    return w.select("event_id", category(F.col("ceiling"), F.col("vis")).alias("category"))


@query(f"with {MOV} select mvt_id, phase, case when phase = 'DEP' then null else block_us end as block_us, case when phase = 'DEP' then null else taxi end as taxi from m")
def blind_frame(s, d):
    from turnpike.operators.features import blind

    return blind(movements(s, d)).select("mvt_id", "phase", "block_us", "taxi")


@query(f"with {MOV} select mvt_id, case when runway is null then null else greatest(100, least(taxi, 900)) end as taxi from m")
def clip_bounds(s, d):
    m = movements(s, d).withColumn("x", F.when(F.col("runway").isNotNull(), F.col("taxi")))
    return m.select("mvt_id", X.clip("x", 100, 900).cast("bigint").alias("taxi"))


@query(f"""with {MOV}, x as (select mvt_id, case when runway is not null then taxi end as a, case when stand is not null then d end as b, user_id as c from m)
       select mvt_id, greatest(a, b, c) as hi, least(a, b, c) as lo, round((coalesce(a, 0) + coalesce(b, 0) + c)::double / ((a is not null)::int + (b is not null)::int + 1), 6) as mean,
              coalesce(a, 0) + coalesce(b, 0) + c as total from x""")
def horizontal_aggs(s, d):
    x = movements(s, d).select("mvt_id", F.when(F.col("runway").isNotNull(), F.col("taxi")).alias("a"), F.when(F.col("stand").isNotNull(), F.col("d")).alias("b"), F.col("user_id").alias("c"))
    total = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) + F.col("c")
    return x.select("mvt_id", F.greatest("a", "b", "c").alias("hi"), F.least("a", "b", "c").alias("lo"), F.round(X.mean_of("a", "b", "c"), 6).alias("mean"), total.alias("total"))


@query(f"with {MOV} select mvt_id, coalesce(case runway when 'R0' then 10 when 'R2' then 30 end, -1)::bigint as lag from m")
def map_with_default(s, d):
    lags = s.createDataFrame([("R0", 10), ("R2", 30)], "rwy string, lag bigint")
    return movements(s, d).join(F.broadcast(lags), F.col("runway") == F.col("rwy"), "left").select("mvt_id", F.coalesce("lag", F.lit(-1)).cast("bigint").alias("lag"))


@query("""with b(box, box_order, lat_min, lat_max, lon_min, lon_max) as (values ('a', 1, 0, 50, 0, 60), ('b', 2, 25, 90, 30, 120), ('c', 3, 0, 200, 100, 149))
       select event_id, arg_min(box, box_order) as box from events join b on value between lat_min and lat_max and user_id between lon_min and lon_max group by event_id""")
def bbox_assign(s, d):
    boxes = s.createDataFrame([("a", 1, 0, 50, 0, 60), ("b", 2, 25, 90, 30, 120), ("c", 3, 0, 200, 100, 149)], "box string, box_order int, lat_min int, lat_max int, lon_min int, lon_max int")
    return S.box_assign(table(s, d, "events"), boxes, "value", "user_id", "event_id", grid=25)


@query(f"with {MOV} select mvt_id, case when d < -300 then 'early' when d < 0 then 'ahead' when d < 300 then 'on time' else 'late' end as band from m")
def offset_bands(s, d):
    return movements(s, d).select("mvt_id", X.bands("d", [-300, 0, 300], ["early", "ahead", "on time", "late"]).alias("band"))


@query("select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey")
def multi_sort(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey")


@query(f"with {MOV} select mvt_id, (taxi - 900) * (taxi - 900) as se from m order by (taxi - 900) * (taxi - 900) desc, mvt_id limit 20")
def topk_errors(s, d):
    m = movements(s, d).select("mvt_id", ((F.col("taxi") - 900) * (F.col("taxi") - 900)).alias("se"))
    return m.orderBy(F.desc("se"), "mvt_id").limit(20)


@query(f"""with {MOV}, c as (select airport, runway, count(*) as n from m where runway is not null group by all)
       select airport, runway, n from c qualify row_number() over (partition by airport order by n desc, runway) <= 2""")
def topk_per_group(s, d):
    c = movements(s, d).where("runway is not null").groupBy("airport", "runway").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("airport").orderBy(F.desc("n"), "runway"))).where("r <= 2").drop("r")


@query("select c_custkey as key, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_acctbal, null from supplier")
def union_diagonal(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query(f"with {MOV} select distinct airport, t_us // 300000000 as bin from m")
def distinct_bins(s, d):
    return movements(s, d).select("airport", F.floor(F.col("t_us") / 300_000_000).alias("bin")).distinct()


@query("select user_id, event_type, min(event_id) as event_id from events group by all")
def dedupe_first(s, d):
    # Keep-first by key is a minimum of the order: no sort of whole groups.
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""select (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) as orders_only,
       (select count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders)) as lines_only""")
def id_alignment(s, d):
    o, line = table(s, d, "orders").select(F.col("o_orderkey").alias("k")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    sides = o.join(line, "k", "left_anti").select(F.lit("o").alias("side")).unionByName(line.join(o, "k", "left_anti").select(F.lit("l").alias("side")))
    return sides.agg(F.count_if(F.col("side") == "o").alias("orders_only"), F.count_if(F.col("side") == "l").alias("lines_only"))


_NAMES = """n as (select s_suppkey, ['Gate ', 'Stand-', 'ramp_', 'PARKING', 'Apron ', 'pos 0', '', 'F0'][(s_suppkey % 8 + 1)::bigint] || printf('%03d', s_suppkey) || ['', 'L', 'b', ' C', 'X', '-(C)', 'R'][(s_suppkey % 7 + 1)::bigint] as name from supplier)"""


@query(f"""with {_NAMES}, k as (select s_suppkey, name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(name), '-\\([A-Z]\\)$', ''), '^(GATE|STAND|RAMP|PARKING|APRON|POS)\\s*', ''), '[\\s_\\-]', '', 'g'), '(^|[A-Z])0+(\\d)', '\\1\\2', 'g') as key from n)
       select s_suppkey, name, key, regexp_replace(key, '(\\d)[LRABC]$', '\\1') as base from k""")
def stand_key_normalise(s, d):
    k = F.col("s_suppkey")
    pick = lambda values: F.array(*[F.lit(v) for v in values])[(k % len(values)).cast("int")]
    name = F.concat(pick(("Gate ", "Stand-", "ramp_", "PARKING", "Apron ", "pos 0", "", "F0")), F.format_string("%03d", k), pick(("", "L", "b", " C", "X", "-(C)", "R")))
    n = table(s, d, "supplier").select(k, name.alias("name")).withColumn("key", X.stand_key("name"))
    return n.withColumn("base", X.variant_base("key"))


@query("select p_partkey, (contains(p_type, 'A') or contains(p_type, 'O'))::int as flag, starts_with(p_brand, 'Brand') as brand, substr(p_name, 1, 4) as head, p_brand || '/' || p_type as both from part")
def string_flags(s, d):
    return table(s, d, "part").select(
        "p_partkey", (F.col("p_type").contains("A") | F.col("p_type").contains("O")).cast("int").alias("flag"), F.col("p_brand").startswith("Brand").alias("brand"),
        F.substring("p_name", 1, 4).alias("head"), F.concat("p_brand", F.lit("/"), "p_type").alias("both"),
    )


@query("""select event_id, date_trunc('hour', ts) as hour_start, epoch_us(ts) // 300000000 as five, epoch_us(ts) // 1000 as millis, strftime(ts, '%Y-%m') as ym, ts::date as day,
       year(ts)::int as year, day(ts)::int as dom, ts + interval 90 second as later from events""")
def time_functions(s, d):
    t = F.col("ts").cast("timestamp")
    return table(s, d, "events").select(
        "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start"), F.floor(F.unix_micros(t) / 300_000_000).alias("five"), F.unix_millis(t).alias("millis"),
        F.date_format("ts", "yyyy-MM").alias("ym"), F.to_date("ts").alias("day"), F.year("ts").alias("year"), F.dayofmonth("ts").alias("dom"),
        (F.col("ts") + F.expr("interval 90 seconds")).alias("later"),
    )


