"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnpike.functions import exprs as X
from turnpike.operators import features, joins
from turnpike.plans.registry import MOV, query
from turnpike.sources.tables import movements, table

LINE_KEYS = (["l_returnflag", "l_linestatus", "l_suppkey"], ["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"])


@query("select o_orderkey, o_totalprice, c_mktsegment, c_acctbal from orders left join customer on o_custkey = c_custkey")
def left_join_features(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_totalprice", "c_mktsegment", "c_acctbal")


@query("select l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey")
def inner_join(s, d):
    return table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def semi_restrict(s, d):
    rich = table(s, d, "customer").where("c_acctbal > 5000")
    return table(s, d, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def anti_join(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(f"""with {MOV}, a as (select airport, ts::date as day, count(*) as n_dep from m where phase = 'DEP' and user_id % 3 <> 0 group by all),
       b as (select airport, ts::date as day, count(*) as n_arr from m where phase = 'ARR' and user_id % 7 <> 0 group by all),
       c as (select airport, ts::date as day, sum(taxi)::bigint as taxi from m where taxi > 1500 group by all)
       select airport, day, n_dep, n_arr, taxi from a full join b using (airport, day) full join c using (airport, day)""")
def full_outer_3way(s, d):
    m = movements(s, d).withColumn("day", F.to_date("ts"))
    key = ["airport", "day"]
    a = m.where("phase = 'DEP' and user_id % 3 <> 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n_dep"))
    b = m.where("phase = 'ARR' and user_id % 7 <> 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n_arr"))
    c = m.where("taxi > 1500").groupBy(*key).agg(F.sum("taxi").alias("taxi"))
    return a.join(b, key, "full").join(c, key, "full")


@query("select l_orderkey, l_linenumber, c_name, s_name from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey and s_nationkey = c_nationkey")
def composite_key_join(s, d):
    line, o, c, u = (table(s, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = line.join(u, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).select("l_orderkey", "l_linenumber", "c_name", "s_name")


@query("""select o_orderkey, l_linenumber, cn.n_name as cust_nation, sn.n_name as supp_nation, (cn.n_regionkey = sn.n_regionkey)::int as same_region from lineitem
       join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
       left join nation cn on c_nationkey = cn.n_nationkey left join nation sn on s_nationkey = sn.n_nationkey""")
def dual_dim_join(s, d):
    line = table(s, d, "lineitem")
    n = table(s, d, "nation")
    cust = n.select(F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("cust_nation"), F.col("n_regionkey").alias("cn_region"))
    supp = n.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("supp_nation"), F.col("n_regionkey").alias("sn_region"))
    joined = line.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(cust, F.col("c_nationkey") == F.col("cn_key"), "left").join(supp, F.col("s_nationkey") == F.col("sn_key"), "left")
    return joined.select("o_orderkey", "l_linenumber", "cust_nation", "supp_nation", (F.col("cn_region") == F.col("sn_region")).cast("int").alias("same_region"))


@query(f"""with {MOV}, w as (select airport, t_us // 3600000000 as hour, max(value) as gust from m where phase = 'ARR' and user_id % 2 = 0 group by all)
       select mvt_id, coalesce(gust, -1.0) as gust, (gust is not null)::int as has_weather from m left join w on w.airport = m.airport and w.hour = m.t_us // 3600000000""")
def hour_bucket_join(s, d):
    m = movements(s, d).withColumn("hour", F.floor(F.col("t_us") / 3_600_000_000))
    w = m.where("phase = 'ARR' and user_id % 2 = 0").groupBy("airport", "hour").agg(F.max("value").alias("gust"))
    return m.join(w, ["airport", "hour"], "left").select("mvt_id", F.coalesce("gust", F.lit(-1.0)).alias("gust"), F.col("gust").isNotNull().cast("int").alias("has_weather"))


_SIDES = f"""with {MOV}, dep as (select * from m where phase = 'DEP'), arr as (select * from m where phase = 'ARR')"""


def _dep_arr(s, d):
    m = movements(s, d)
    dep = m.where("phase = 'DEP'").select("mvt_id", "airport", "stand", "actype", "sched_us")
    arr = m.where("phase = 'ARR'").select(F.col("mvt_id").alias("arr_id"), "airport", "stand", "actype", F.col("block_us").alias("arr_us"))
    return dep, arr


def _brute(direction: str, keys: str) -> str:
    pick = "arg_max(a.mvt_id, (a.block_us, a.mvt_id))" if direction == "back" else "arg_min(a.mvt_id, (a.block_us, a.mvt_id))"
    op = "<=" if direction == "back" else ">="
    on = " and ".join(f"a.{k} = dep.{k}" for k in keys.split())
    return f"{_SIDES} select dep.mvt_id, {pick} as arr_id from dep left join arr a on {on} and a.block_us {op} dep.sched_us group by dep.mvt_id"


@query(_brute("back", "airport stand actype"))
def asof_backward_typed(s, d):
    dep, arr = _dep_arr(s, d)
    return joins.asof(dep, arr, by=["airport", "stand", "actype"], left_time="sched_us", right_time="arr_us", right_id="arr_id", columns=["arr_id"]).select("mvt_id", "arr_id")


@query(_brute("back", "airport stand"))
def asof_backward_any(s, d):
    dep, arr = _dep_arr(s, d)
    return joins.asof(dep, arr, by=["airport", "stand"], left_time="sched_us", right_time="arr_us", right_id="arr_id", columns=["arr_id"]).select("mvt_id", "arr_id")


@query(_brute("forward", "airport stand"))
def asof_forward(s, d):
    dep, arr = _dep_arr(s, d)
    return joins.asof(dep, arr, by=["airport", "stand"], left_time="sched_us", right_time="arr_us", right_id="arr_id", columns=["arr_id"], forward=True).select("mvt_id", "arr_id")


_STAND_PAIR = "a.airport = d.airport and a.stand = d.stand"
LINK_SQL = f"""lk as (select *, t_us - {features.NOMINAL_TAXI}000000 as est from m where phase = 'DEP' and stand is not null and t_us is not null),
    ar as (select * from m where phase = 'ARR' and stand is not null and block_us is not null),
    ty as (select d.mvt_id, arg_max(a.mvt_id, (a.block_us, a.mvt_id)) as id from lk d join ar a on {_STAND_PAIR} and a.actype = d.actype and a.block_us <= d.est group by 1),
    an as (select d.mvt_id, arg_max(a.mvt_id, (a.block_us, a.mvt_id)) as id from lk d join ar a on {_STAND_PAIR} and a.block_us <= d.est group by 1),
    nx as (select d.mvt_id, min(a.block_us) as us from lk d join ar a on {_STAND_PAIR} and a.block_us >= d.est group by 1),
    l0 as (select d.mvt_id, d.airport, d.stand, o.mvt_id as inbound_mvt_id, o.block_us as "A_own_us", nx.us as "A_next_us", ty.id is not null as type_match, nx.us is not null as has_next,
           trunc((d.t_us - o.block_us) / 1e6)::bigint as "U_sec", trunc((d.t_us - nx.us) / 1e6)::bigint as raw_low, trunc((d.est - o.block_us) / 1e6)::bigint as ground_time_sec
           from lk d left join ty using (mvt_id) left join an using (mvt_id) left join nx using (mvt_id) left join m o on o.mvt_id = coalesce(ty.id, an.id)),
    l1 as (select *, greatest(0, coalesce(raw_low, 0)) as "L_sec", coalesce(ground_time_sec between {features.GROUND_LEAST} and {features.GROUND_MOST}, false) as plausible from l0),
    links as (select mvt_id, airport, stand, inbound_mvt_id, "A_own_us", "A_next_us", "L_sec", "U_sec", "U_sec" - "L_sec" as interval_sec, ground_time_sec, type_match, has_next, raw_low > 0 as bound_binding,
           case when inbound_mvt_id is null then 'none' when type_match and plausible and has_next then 'high' when type_match or plausible then 'med' else 'low' end as link_confidence from l1)"""


@query(f"with {MOV}, {LINK_SQL} select * from links")
def stand_link(s, d):
    return features.stand_links(movements(s, d))


@query(f"with {MOV}, {LINK_SQL} select link_confidence, type_match, has_next, bound_binding, count(*) as n from links group by all")
def link_confidence(s, d):
    return features.stand_links(movements(s, d)).groupBy("link_confidence", "type_match", "has_next", "bound_binding").agg(F.count(F.lit(1)).alias("n"))


@query("""with dim as (select upper(substr(p_name, 1, 6)) as full_key, upper(substr(p_name, 1, 3)) as base, p_retailprice as v from part where p_partkey % 3 <> 0)
       select p_partkey, round(coalesce((select avg(v) from dim where full_key = upper(substr(p_name, 1, 6))), (select avg(v) from dim where base = upper(substr(p_name, 1, 3)))), 6) as v from part""")
def fallback_key_join(s, d):
    p = table(s, d, "part").select("p_partkey", F.upper(F.substring("p_name", 1, 6)).alias("k"), F.upper(F.substring("p_name", 1, 3)).alias("b"), "p_retailprice")
    dim = p.where("p_partkey % 3 <> 0").select(F.col("k").alias("dk"), F.col("b").alias("db"), F.col("p_retailprice").alias("v"))
    return joins.fallback_key(p, dim, exact="k", base="b", dim_exact="dk", dim_base="db", value="v").select("p_partkey", F.round("v", 6).alias("v"))


@query("""with t as (select * from lineitem where l_orderkey % 4 <> 0), e as (select * from lineitem where l_orderkey % 4 = 0),
       a as (select l_returnflag, l_linestatus, l_suppkey, avg(l_quantity) as p from t where l_suppkey % 3 <> 0 group by all), b as (select l_returnflag, l_linestatus, avg(l_quantity) as p from t where l_linestatus <> 'F' group by all),
       c as (select l_returnflag, avg(l_quantity) as p from t where l_returnflag <> 'R' group by all), g as (select l_linestatus, avg(l_quantity) as p from t group by all)
       select count(*) as n, round(sqrt(avg(pow(l_quantity - coalesce(a.p, b.p, c.p, g.p, 0), 2))), 6) as rmse, round(avg(l_quantity - coalesce(a.p, b.p, c.p, g.p, 0)), 6) as bias from e
       left join a using (l_returnflag, l_linestatus, l_suppkey) left join b using (l_returnflag, l_linestatus) left join c using (l_returnflag) left join g using (l_linestatus)""")
def backoff_group_mean(s, d):
    line = table(s, d, "lineitem")
    train, test = line.where("l_orderkey % 4 <> 0"), line.where("l_orderkey % 4 = 0")
    kept = (train.where("l_suppkey % 3 <> 0"), train.where("l_linestatus <> 'F'"), train.where("l_returnflag <> 'R'"), train)
    levels = [(k, t.groupBy(*k).agg(F.avg("l_quantity").alias("p"))) for k, t in zip(LINE_KEYS, kept, strict=True)]
    e = F.col("l_quantity") - F.col("p")
    return joins.backoff(test, levels, "p", 0.0).agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("bias"))


_PAIRS = f"""pairs as (select dep.mvt_id as dep_id, a.mvt_id as arr_id, abs(a.t_us - dep.t_us) // 1000000 as gap, abs(a.t_us - dep.t_us) as off from (select * from m where phase = 'DEP') dep
       join (select * from m where phase = 'ARR') a on a.airport = dep.airport and a.t_us >= dep.t_us - 180000000 and a.t_us < dep.t_us + 180000000)"""


def _pairs(s, d):
    m = movements(s, d)
    dep = m.where("phase = 'DEP'").select(F.col("mvt_id").alias("dep_id"), "airport", "t_us", F.col("stand").alias("dep_stand"))
    arr = m.where("phase = 'ARR'").select(F.col("mvt_id").alias("arr_id"), F.col("airport").alias("airport_r"), F.col("t_us").alias("arr_us"), F.col("stand").alias("arr_stand"))
    pairs = joins.band(dep, arr, by=["airport"], left_time="t_us", right_time="arr_us", reach=180_000_000)
    off = F.abs(F.col("arr_us") - F.col("t_us"))
    return pairs.withColumn("gap", F.floor(off / 1_000_000)).withColumn("off", off)


@query(f"with {MOV}, {_PAIRS} select dep_id, arr_id, gap from pairs")
def band_join(s, d):
    return _pairs(s, d).select("dep_id", "arr_id", "gap")


@query(f"""with recursive {MOV}, {_PAIRS}, ranked as (select p.*, d.airport, (not coalesce(d.stand = a.stand, false))::int as elsewhere,
           row_number() over (partition by d.airport order by not coalesce(d.stand = a.stand, false), off, dep_id, arr_id) as i from pairs p join m d on d.mvt_id = dep_id join m a on a.mvt_id = arr_id),
       greedy as (select airport, 0::bigint as i, []::bigint[] as ds, []::bigint[] as rs, null::bigint as dep_id, null::bigint as arr_id from (select distinct airport from ranked)
                  union all
                  select g.airport, r.i, case when ok then list_append(ds, r.dep_id) else ds end, case when ok then list_append(rs, r.arr_id) else rs end, case when ok then r.dep_id end, case when ok then r.arr_id end
                  from greedy g join ranked r on r.airport = g.airport and r.i = g.i + 1, lateral (select not list_contains(ds, r.dep_id) and not list_contains(rs, r.arr_id) as ok) o)
       select r.dep_id, r.arr_id, r.elsewhere, r.off from greedy g join ranked r on r.airport = g.airport and r.dep_id = g.dep_id and r.arr_id = g.arr_id""")
def greedy_match(s, d):
    """One-to-one matches of the band pairs by visit to the stand, distance in time and ids."""
    pairs = _pairs(s, d).withColumn("elsewhere", (~X.null_safe(F.col("dep_stand") == F.col("arr_stand"))).cast("int")).select("dep_id", "arr_id", "elsewhere", "off")
    return joins.greedy_one_to_one(pairs, left="dep_id", right="arr_id", cost=["elsewhere", "off"])


@query("""with a as (select l_orderkey, l_linenumber, l_quantity * 1.1 as p from lineitem), b as (select l_orderkey, l_linenumber, l_quantity + 1 as p from lineitem)
       select count(*) as n, round(avg(pow(a.p - l_quantity, 2) - pow(b.p - l_quantity, 2)), 6) as delta from a join b using (l_orderkey, l_linenumber) join lineitem using (l_orderkey, l_linenumber)""")
def paired_eval(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    key = ["l_orderkey", "l_linenumber"]
    a = line.select(*key, (F.col("l_quantity") * 1.1).alias("pa"))
    b = line.select(*key, (F.col("l_quantity") + 1).alias("pb"))
    delta = F.pow(F.col("pa") - F.col("l_quantity"), F.lit(2)) - F.pow(F.col("pb") - F.col("l_quantity"), F.lit(2))
    return a.join(b, key).join(line, key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(delta), 6).alias("delta"))


@query("""with pl as (select distinct 'A' || (user_id % 10) as airport, 'S' || user_id as stand, (user_id * 37 % 101)::double as x, (user_id * 53 % 97)::double as y from events),
       pt as (select event_id, 'A' || (user_id % 10) as airport, (event_id * 29 % 103)::double as x, (event_id * 31 % 89)::double as y from events where event_type = 'click')
       select event_id, round(min(sqrt(pow(pt.x - pl.x, 2) + pow(pt.y - pl.y, 2))), 6) as distance from pt join pl using (airport) group by event_id""")
def nearest_stand(s, d):
    e = table(s, d, "events").withColumn("airport", F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")))
    places = e.select("airport", F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("stand"), (F.col("user_id") * 37 % 101).cast("double").alias("px"), (F.col("user_id") * 53 % 97).cast("double").alias("py")).distinct()
    points = e.where("event_type = 'click'").select("event_id", "airport", (F.col("event_id") * 29 % 103).cast("double").alias("x"), (F.col("event_id") * 31 % 89).cast("double").alias("y"))
    found = joins.nearest(points, places, by="airport", x="x", y="y", place_x="px", place_y="py", place="stand", id_col="event_id")
    return found.select("event_id", F.round("distance", 6).alias("distance"))


@query("select o_orderstatus = 'F' as is_f, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by 1")
def bool_group(s, d):
    return table(s, d, "orders").groupBy((F.col("o_orderstatus") == "F").alias("is_f")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
