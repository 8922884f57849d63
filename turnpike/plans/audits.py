"""Data-quality and leak audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnpike.functions.exprs import n_rows
from turnpike.operators import features
from turnpike.operators.evaluate import quantiles
from turnpike.plans.joined import LINK_SQL
from turnpike.plans.registry import MOV, query
from turnpike.sources.tables import movements, table


@query(f"with {MOV} select phase, count(*) as n, count(*) filter (where phase = 'DEP') as blanked, count(*) filter (where phase = 'ARR') as known from m group by phase")
def blank_invariant(s, d):
    b = features.blind(movements(s, d))
    return b.groupBy("phase").agg(n_rows().alias("n"), F.count_if(F.col("block_us").isNull() & F.col("taxi").isNull()).alias("blanked"), F.count_if(F.col("block_us").isNotNull()).alias("known"))


@query(f"""with {MOV}, u as (select 'offset' as name, case when stand is not null then trunc((t_us - sched_us) / 1e6)::bigint end as x, taxi from m union all select 'd', case when runway is not null then d end, taxi from m)
       select name, count(x) as n, round(count(x)::double / count(*), 8) as coverage, round(median(x - taxi), 4) as med, round(quantile_cont(x - taxi, 0.1), 4) as p10, round(quantile_cont(x - taxi, 0.9), 4) as p90,
              round(avg((abs(x - taxi) <= 60)::int), 8) as in_1, round(avg((abs(x - taxi) <= 300)::int), 8) as in_5 from u group by name""")
def leak_audit(s, d):
    m = movements(s, d)
    offset = F.when(F.col("stand").isNotNull(), ((F.col("t_us") - F.col("sched_us")) / 1_000_000).cast("bigint"))
    long = m.select("taxi", F.explode(F.array(F.struct(F.lit("offset").alias("name"), offset.alias("x")), F.struct(F.lit("d").alias("name"), F.when(F.col("runway").isNotNull(), F.col("d")).alias("x")))).alias("c")).select("taxi", "c.*")
    e = F.col("x") - F.col("taxi")
    g = long.groupBy("name").agg(F.count("x").alias("n"), F.round(F.count("x") / n_rows(), 8).alias("coverage"), F.round(F.avg((F.abs(e) <= 60).cast("int")), 8).alias("in_1"), F.round(F.avg((F.abs(e) <= 300).cast("int")), 8).alias("in_5"))
    g = g.join(quantiles(long.withColumn("e", e), "e", [0.5, 0.1, 0.9], by=["name"]).drop("n"), "name", "left")
    return g.select("name", "n", "coverage", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("med", "p10", "p90"))], "in_1", "in_5")


@query(f"with {MOV} select airport, round(sqrt(avg(pow(d - taxi, 2))), 6) as rmse, round(avg(abs(d - taxi)), 6) as mae, round(avg(d - taxi), 6) as bias from m group by airport")
def naive_error(s, d):
    e = F.col("d") - F.col("taxi")
    return movements(s, d).groupBy("airport").agg(F.round(F.sqrt(F.avg(F.pow(e, F.lit(2)))), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e), 6).alias("bias"))


_TRUTH = f"""{LINK_SQL}, j as (select l.*, m.taxi, m.taxi > "U_sec" + 60 as high, m.taxi < "L_sec" - 60 as low from links l join m using (mvt_id) where m.taxi between 0 and 14400)"""


@query(f"""with {MOV}, {_TRUTH} select airport, count(*) as n, round(avg((link_confidence <> 'none')::int), 8) as linked, round(avg(has_next::int), 8) as next, round(coalesce(avg((bound_binding and link_confidence <> 'none')::int) filter (where link_confidence <> 'none' and bound_binding is not null), 0), 8) as binding,
       round(coalesce(avg((high or low)::int) filter (where link_confidence <> 'none'), 0), 8) as violated, round(avg(high::int) filter (where link_confidence <> 'none'), 8) as too_high, round(avg(low::int) filter (where link_confidence <> 'none'), 8) as too_low,
       median(interval_sec) filter (where link_confidence <> 'none') as width, case when coalesce(avg((high or low)::int) filter (where link_confidence <> 'none'), 0) <= 0.10 then 'HARD' else 'SOFT' end as verdict from j group by airport""")
def link_validation(s, d):
    """Per airport: links, successors, bounds that bind, and how often the true taxi leaves them by over a minute."""
    j = _truth(s, d)
    linked = F.col("link_confidence") != "none"
    share = lambda c: F.avg(F.when(linked, c.cast("int")))
    violated = F.coalesce(share(F.col("high") | F.col("low")), F.lit(0.0))
    r = lambda c: F.round(c, 8)
    g = j.groupBy("airport").agg(
        n_rows().alias("n"), r(F.avg(linked.cast("int"))).alias("linked"), r(F.avg(F.col("has_next").cast("int"))).alias("next"), r(F.coalesce(share(F.col("bound_binding")), F.lit(0.0))).alias("binding"),
        r(violated).alias("violated"), r(share(F.col("high"))).alias("too_high"), r(share(F.col("low"))).alias("too_low"), F.when(violated <= 0.10, "HARD").otherwise("SOFT").alias("verdict"),
    )
    width = quantiles(j.where(linked), "interval_sec", [0.5], by=["airport"]).select("airport", F.col("q")[0].alias("width"))
    return g.join(width, "airport", "left")


@query(f"""with {MOV}, {_TRUTH} select link_confidence as tier, count(*) as n, round(avg(bound_binding::int), 8) as binding, round(avg((not high and not low)::int), 8) as in_bounds, median(interval_sec) as width from j group by 1""")
def link_tiers(s, d):
    j = _truth(s, d)
    inside = (~F.col("high") & ~F.col("low")).cast("int")
    g = j.groupBy(F.col("link_confidence").alias("tier")).agg(n_rows().alias("n"), F.round(F.avg(F.col("bound_binding").cast("int")), 8).alias("binding"), F.round(F.avg(inside), 8).alias("in_bounds"))
    width = quantiles(j, "interval_sec", [0.5], by=["link_confidence"]).select(F.col("link_confidence").alias("tier"), F.col("q")[0].alias("width"))
    return g.join(width, "tier", "left")


def _truth(s, d):
    m = movements(s, d)
    truth = m.where("phase = 'DEP' and taxi between 0 and 14400").select("mvt_id", "taxi")
    taxi = F.col("taxi")
    return features.stand_links(m).join(truth, "mvt_id").withColumn("high", taxi > F.col("U_sec") + 60).withColumn("low", taxi < F.col("L_sec") - 60)


@query(f"""with {MOV}, {_TRUTH}, a as (select airport, avg(taxi) as mean from j group by 1), h as (select j.*, mean, greatest("L_sec", least("U_sec", mean)) as clamped from j join a using (airport) where link_confidence = 'high')
       select count(*) as n, round(sqrt(avg(pow(mean - taxi, 2))), 6) as rmse, round(sqrt(avg(pow(clamped - taxi, 2))), 6) as rmse_clamped, count(*) filter (where mean <> clamped) as changed, count(*) filter (where bound_binding) as binding from h""")
def truncation_gain(s, d):
    """What clamping an airport's mean to the bounds of confident links gains."""
    j = _truth(s, d)
    h = j.join(j.groupBy("airport").agg(F.avg("taxi").alias("mean")), "airport").where("link_confidence = 'high'")
    h = h.withColumn("clamped", features.clip_to_bounds(F.col("mean"), F.col("L_sec"), F.col("U_sec")))
    sq = lambda c: F.round(F.sqrt(F.avg(F.pow(F.col(c) - F.col("taxi"), F.lit(2)))), 6)
    return h.agg(n_rows().alias("n"), sq("mean").alias("rmse"), sq("clamped").alias("rmse_clamped"), F.count_if(F.col("mean") != F.col("clamped")).alias("changed"), F.count_if("bound_binding").alias("binding"))


@query(f"with {MOV} select airport, ts::date as day, count(distinct user_id) filter (where value < 40) >= 6 as covered from m group by all")
def coverage_flag(s, d):
    slow = F.count_distinct(F.when(F.col("value") < 40, F.col("user_id")))
    return movements(s, d).groupBy("airport", F.to_date("ts").alias("day")).agg((slow >= 6).alias("covered"))


@query("""select ts::date as day, count(*) as n, count(distinct (user_id, event_type)) as kept, round(1 - count(distinct (user_id, event_type))::double / count(*), 8) as dropped from events group by 1""")
def drop_rate(s, d):
    kept = F.count_distinct("user_id", "event_type")
    return table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(n_rows().alias("n"), kept.alias("kept"), F.round(1 - kept / n_rows(), 8).alias("dropped"))
