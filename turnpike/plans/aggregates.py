"""Aggregations, error reports, deciles, blends' sums and bootstrap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnpike.functions import exprs as X
from turnpike.functions.exprs import n_rows
from turnpike.operators import blend as B
from turnpike.operators import evaluate as E
from turnpike.plans.registry import MOV, query
from turnpike.sources.tables import movements, table


def _r(c, places=6):
    return F.round(c, places)


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def group_count(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(n_rows().alias("n"))


@query("""select l_returnflag, round(sum(l_quantity), 4) as total, round(avg(l_extendedprice), 4) as mean, min(l_quantity) as lo, max(l_quantity) as hi,
       round(stddev_samp(l_discount), 8) as sd, round(var_samp(l_tax), 8) as var from lineitem group by l_returnflag""")
def group_stats(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(
        _r(F.sum("l_quantity"), 4).alias("total"), _r(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
        _r(F.stddev_samp("l_discount"), 8).alias("sd"), _r(F.var_samp("l_tax"), 8).alias("var"),
    )


@query("select l_suppkey, round(median(l_quantity), 6) as median from lineitem group by l_suppkey")
def group_median(s, d):
    q = E.quantiles(table(s, d, "lineitem"), "l_quantity", [0.5], by=["l_suppkey"])
    return q.select("l_suppkey", _r(F.col("q")[0]).alias("median"))


@query("select l_suppkey, list_sort(list(l_quantity))[round((count(*) - 1) * 0.2::double)::bigint + 1] as prior, count(*) as n from lineitem where l_quantity between 5 and 45 group by l_suppkey")
def unimpeded_prior(s, d):
    kept = table(s, d, "lineitem").where(F.col("l_quantity").between(5, 45))
    return E.quantiles(kept, "l_quantity", [0.2], by=["l_suppkey"], method="nearest").select("l_suppkey", F.col("q")[0].alias("prior"), "n")


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 6) as p1, round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.99), 6) as p99 from lineitem group by 1")
def percentile_linear(s, d):
    p = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    q = E.quantiles(table(s, d, "lineitem"), "l_extendedprice", list(p.values()), by=["l_returnflag"])
    return q.select("l_returnflag", *[_r(F.col("q")[i]).alias(n) for i, n in enumerate(p)])


@query(f"with {MOV} select airport, count(distinct runway) + max((runway is null)::int) as n from m group by airport")
def distinct_incl_null(s, d):
    return movements(s, d).groupBy("airport").agg(X.distinct_with_null("runway").cast("bigint").alias("n"))


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, round(avg((o_totalprice > 2500)::int), 8) as rate from orders group by 1")
def conditional_counts(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), _r(F.avg((F.col("o_totalprice") > 2500).cast("int")), 8).alias("rate"))


@query(f"with {MOV} select phase, count(*) filter (where runway is null) as runway, count(*) filter (where stand is null) as stand, count(*) filter (where taxi is null) as taxi from m group by phase")
def null_profile(s, d):
    return movements(s, d).groupBy("phase").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("runway", "stand", "taxi")])


@query(f"with {MOV} select airport, t_us // 3600000000 as hour, coalesce(string_agg(distinct runway, '+' order by runway), '') as config from m group by all")
def runway_config_set(s, d):
    m = movements(s, d)
    return m.groupBy("airport", F.floor(F.col("t_us") / 3_600_000_000).alias("hour")).agg(F.array_join(F.sort_array(F.collect_set("runway")), "+").alias("config"))


@query(f"with {MOV} select airport, t_us // 3600000000 as hour, arg_max(mvt_id, (t_us, mvt_id)) as mvt_id, arg_max(taxi, (t_us, mvt_id)) as taxi from m group by all")
def last_per_hour(s, d):
    last = F.max_by(F.struct("mvt_id", "taxi"), F.struct("t_us", "mvt_id")).alias("r")
    return movements(s, d).groupBy("airport", F.floor(F.col("t_us") / 3_600_000_000).alias("hour")).agg(last).select("airport", "hour", "r.mvt_id", "r.taxi")


@query(f"with {MOV} select round(sqrt(avg(pow(taxi - 900, 2))), 6) as rmse, round(avg(abs(taxi - 900)), 6) as mae, round(avg(taxi - 900), 6) as bias, count(*) as n from m")
def error_metrics(s, d):
    m = movements(s, d).agg(*E.metrics(F.col("taxi") - 900))
    return m.select(*[_r(c).alias(c) for c in ("rmse", "mae", "bias")], "n")


@query(f"""with {MOV}, e as (select airport, (taxi - 900)::double as e from m)
       select airport, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae, round(avg(e), 6) as bias, count(*) as n, round(sum(e * e), 2) as sse, round(sum(e * e) / (select sum(e * e) from e), 8) as share from e group by airport""")
def slice_report(s, d):
    r = E.slices(movements(s, d), "airport", (F.col("taxi") - 900).cast("double"))
    return r.select("airport", _r("rmse").alias("rmse"), _r("mae").alias("mae"), _r("bias").alias("bias"), "n", _r("sse", 2).alias("sse"), _r("share", 8).alias("share"))


# Keys of lines repeat, so the order goes on to all that tells them apart.
_LINE_ORDER = ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]
_POS = f"(row_number() over (order by {', '.join(_LINE_ORDER)}) - 1)"


def _deciles(s, d, bins=10):
    line = table(s, d, "lineitem").select(*_LINE_ORDER)
    placed = E.positions(line, _LINE_ORDER, chunk=F.floor("l_quantity"))
    return placed.withColumn("bin", X.equal_count_bin(F.col("pos"), F.col("total"), bins))


@query(f"""with p as (select *, ({_POS} * 10 // count(*) over ())::int as bin from lineitem)
       select bin, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi, round(sqrt(avg(pow(l_extendedprice - 1500 * l_quantity, 2))), 4) as rmse from p group by bin""")
def decile_report(s, d):
    e = F.col("l_extendedprice") - 1500 * F.col("l_quantity")
    return _deciles(s, d).groupBy("bin").agg(n_rows().alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), _r(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


@query("""with e as (select quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from lineitem)
       select list_sum([(l_extendedprice > x)::int for x in edges])::int as bin, count(*) as n, round(avg(l_quantity), 6) as mean from lineitem, e group by 1""")
def qcut_deciles(s, d):
    line = table(s, d, "lineitem")
    edges = E.quantiles(line, "l_extendedprice", [i / 10 for i in range(1, 10)]).select(F.col("q").alias("edges"), F.lit(1).alias("_one"))
    joined = line.withColumn("_one", F.lit(1)).join(F.broadcast(edges), "_one")
    bin_ = F.aggregate("edges", F.lit(0), lambda a, x: a + (F.col("l_extendedprice") > x).cast("int"))
    return joined.withColumn("bin", bin_).groupBy("bin").agg(n_rows().alias("n"), _r(F.avg("l_quantity")).alias("mean"))


@query("""with r as (select l_orderkey, l_linenumber, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as avg_rank, count(*) over () as n from lineitem)
       select least(floor((avg_rank - 1) * 10 / n), 9)::int as bin, count(*) as n from r group by 1""")
def avg_rank_decile(s, d):
    # Ranks of equal values from counts per value: the rows themselves are never sorted.
    line = table(s, d, "lineitem")
    per = line.groupBy("l_quantity").agg(n_rows().alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("rank", before + 1 + (F.col("c") - 1) / 2.0).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return per.groupBy(F.least(F.floor((F.col("rank") - 1) * 10 / F.col("n")), F.lit(9)).cast("int").alias("bin")).agg(F.sum("c").alias("n"))


@query("""with src as (select * from lineitem where l_orderkey % 2 = 0), dst as (select * from lineitem where l_orderkey % 2 = 1),
       e as (select quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) as edges from src),
       a as (select list_sum([(l_extendedprice > x)::int for x in edges])::int as bin, avg(l_quantity) as m from src, e group by 1),
       b as (select list_sum([(l_extendedprice > x)::int for x in edges])::int as bin, avg(l_quantity) as m, count(*) as n from dst, e group by 1)
       select bin, b.n, round(a.m, 6) as source_mean, round(b.m, 6) as target_mean from a join b using (bin)""")
def transfer_deciles(s, d):
    line = table(s, d, "lineitem").withColumn("_one", F.lit(1))
    src, dst = line.where("l_orderkey % 2 = 0"), line.where("l_orderkey % 2 = 1")
    edges = F.broadcast(E.quantiles(src, "l_extendedprice", [0.2, 0.4, 0.6, 0.8]).select(F.col("q").alias("edges"), F.lit(1).alias("_one")))
    bin_ = F.aggregate("edges", F.lit(0), lambda a, x: a + (F.col("l_extendedprice") > x).cast("int")).alias("bin")
    a = src.join(edges, "_one").groupBy(bin_).agg(_r(F.avg("l_quantity")).alias("source_mean"))
    b = dst.join(edges, "_one").groupBy(bin_).agg(n_rows().alias("n"), _r(F.avg("l_quantity")).alias("target_mean"))
    return b.join(a, "bin").select("bin", "n", "source_mean", "target_mean")


@query(f"""with {MOV}, x as (select airport, (taxi - 900)::double as r, (d / 2.0)::double as delta from m)
       select airport, round(greatest(0, least(1, sum(r * delta) / greatest(sum(delta * delta), 1e-9))), 8) as w from x group by airport""")
def ls_blend_weight(s, d):
    m = movements(s, d)
    return m.groupBy("airport").agg(_r(B.ls_weight((F.col("taxi") - 900).cast("double"), F.col("d") / 2.0), 8).alias("w"))


@query(f"""with {MOV}, g as (select runway, actype, count(taxi) as n, median(taxi) as own from m where runway is not null group by all)
       select runway || actype as cell, n, round(case when n >= 1000 then own else (select median(taxi) from m where runway is not null) end, 6) as lag from g""")
def group_lag_fallback(s, d):
    m = movements(s, d).where("runway is not null").withColumn("cell", F.concat("runway", "actype"))
    return B.lag_with_fallback(m, "cell", "taxi", 1000).select("cell", "n", _r("lag").alias("lag"))


@query("""with b as (select quantile_cont(l_extendedprice, 0.01) as lo, quantile_cont(l_extendedprice, 0.99) as hi from lineitem), big as (select l_suppkey from lineitem group by 1 having count(*) >= 600),
       x as (select g.l_suppkey as g, l_quantity as x, greatest(lo, least(hi, l_extendedprice)) as y from lineitem l left join big g using (l_suppkey), b),
       g as (select g, count(*) as n, avg(x) as mx, avg(y) as my, sum(x * y) as sxy, sum(x * x) as sxx from x group by g),
       b2 as (select sum(sxy - n * mx * my) / sum(sxx - n * mx * mx) as slope from g)
       select g as l_suppkey, n, round(slope, 6) as slope, round(my - slope * mx, 4) as intercept from g, b2""")
def fixed_effect_ols(s, d):
    """Groups under 600 rows share the intercept of the row without a group."""
    f = B.fixed_effects(table(s, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice", least=600)
    return f.select("l_suppkey", "n", _r("slope").alias("slope"), _r("intercept", 4).alias("intercept"))


@query("""with x as (select l_returnflag as g, l_quantity as a, 30 * l_discount + 20 as b, l_extendedprice / 1500 as y from lineitem),
       s as (select g, sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, sum(a*y) ay, sum(b*y) b_y from x group by g),
       w as (select *, (bb*ay - ab*b_y) / (aa*bb - ab*ab) as wa, (aa*b_y - ab*ay) / (aa*bb - ab*ab) as wb, greatest(ay/aa, 0) as oa, greatest(b_y/bb, 0) as ob from s)
       select g as l_returnflag, round(case when wa >= 0 and wb >= 0 then wa when oa * ay >= ob * b_y then oa else 0 end, 6) as wa,
              round(case when wa >= 0 and wb >= 0 then wb when oa * ay >= ob * b_y then 0 else ob end, 6) as wb from w""")
def nnls_stack(s, d):
    wa, wb = B.nnls_pair(F.col("l_quantity"), 30 * F.col("l_discount") + 20, F.col("l_extendedprice") / 1500)
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(_r(wa).alias("wa"), _r(wb).alias("wb"))


@query("select l_returnflag, round(corr(l_quantity, l_extendedprice), 8) as r from lineitem group by 1")
def grouped_corr(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(_r(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))


@query("""with g as (select l_suppkey, count(l_quantity) as n, avg(l_quantity) as m, var_samp(l_quantity) as v from lineitem group by all having count(*) >= 2),
       t as (select count(*) as groups, sum(n)::double as n, sum(n * m) / sum(n) as mean, sum(n * m * m) / sum(n) as m2, sum((n - 1) * v) / sum(n - 1) as within from g)
       select groups, round(within, 6) as within, round(m2 - mean * mean, 6) as between_, round(greatest(m2 - mean * mean - within * groups / n, 0), 6) as corrected,
              round((m2 - mean * mean) / (m2 - mean * mean + within), 8) as share from t""")
def variance_decomp(s, d):
    v = E.variance_parts(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity")
    return v.select("groups", _r("within").alias("within"), _r("between").alias("between_"), _r("between_corrected").alias("corrected"), _r("share", 8).alias("share"))


@query("with g as (select l_suppkey, count(*) as n, var_samp(l_quantity) as v from lineitem group by all having count(*) >= 2) select round(sqrt(sum((n - 1) * v) / sum(n - 1)), 8) as sd from g")
def pooled_within_sd(s, d):
    g = table(s, d, "lineitem").groupBy("l_suppkey").agg(n_rows().alias("n"), F.var_samp("l_quantity").alias("v")).where("n >= 2")
    return g.agg(_r(F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)), 8).alias("sd"))


@query(f"""with {MOV}, e as (select (taxi - 900) * (taxi - 900) as se, mvt_id from m), r as (select se, row_number() over (order by se desc, mvt_id) as r from e)
       select k, round(sum(se)::double / (select sum(se) from e), 8) as share from r, (values (10), (100), (1000)) t(k) where r <= k group by k""")
def error_concentration(s, d):
    m = movements(s, d).select(((F.col("taxi") - 900) * (F.col("taxi") - 900)).alias("se"), "mvt_id")
    top = m.orderBy(F.desc("se"), "mvt_id").limit(1000).withColumn("r", F.row_number().over(Window.orderBy(F.desc("se"), "mvt_id")))
    total = m.agg(F.sum("se").alias("all")).withColumn("_one", F.lit(1))
    ks = top.withColumn("k", F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000)))).where("r <= k").groupBy("k").agg(F.sum("se").alias("se")).withColumn("_one", F.lit(1))
    return ks.join(total, "_one").select("k", _r(F.col("se") / F.col("all"), 8).alias("share"))


@query(f"""with {MOV}, p as (select d > 0 as said, taxi > 900 as is_so from m)
       select count(*) filter (where said and is_so) as tp, round(count(*) filter (where said and is_so)::double / count(*) filter (where said), 8) as precision,
              round(count(*) filter (where said and is_so)::double / count(*) filter (where is_so), 8) as recall from p""")
def precision_recall(s, d):
    said, so = F.col("d") > 0, F.col("taxi") > 900
    tp = F.count_if(said & so)
    return movements(s, d).agg(tp.alias("tp"), _r(F.try_divide(tp, F.count_if(said)), 8).alias("precision"), _r(F.try_divide(tp, F.count_if(so)), 8).alias("recall"))


@query("select floor(ln(o_totalprice / 100) / ln(1.5) + 1e-9)::bigint as bin, count(*) as n from orders where o_totalprice >= 100 group by 1")
def log_histogram(s, d):
    bin_ = F.floor(F.log(F.col("o_totalprice") / 100) / F.log(F.lit(1.5)) + 1e-9)
    return table(s, d, "orders").where("o_totalprice >= 100").groupBy(bin_.alias("bin")).agg(n_rows().alias("n"))


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by 1")
def pivot_recovery(s, d):
    p = table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(n_rows())
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("""with c as (select year(o_orderdate) as y, o_orderpriority as cell, median(o_totalprice) as med, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) as iqr, count(*) as n from orders group by all having count(*) >= 50)
       select a.y::int as y, a.cell, round(b.med - a.med, 6) as shift, round(b.iqr, 6) as iqr from c a join c b on a.cell = b.cell and b.y = a.y + 1""")
def drift_shift(s, d):
    o = table(s, d, "orders")
    cells = o.select(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("cell"), "o_totalprice")
    c = E.quantiles(cells, "o_totalprice", [0.25, 0.5, 0.75], by=["y", "cell"]).where("n >= 50").drop("n")
    later = c.select((F.col("y") - 1).alias("y"), "cell", F.col("q").alias("q2"))
    return c.join(later, ["y", "cell"]).select("y", "cell", _r(F.col("q2")[1] - F.col("q")[1]).alias("shift"), _r(F.col("q2")[2] - F.col("q2")[0]).alias("iqr"))


DRAWS = 3000


def _boot_sql(name: str, rows: str) -> str:
    """A paired bootstrap of ``rows(cluster, b, t)`` under names with a prefix."""
    return f"""{name}_c as (select cluster, sum(b) as b, sum(t) as t, count(*) as n from ({rows}) group by all),
       {name}_k as (select count(*) as k, sqrt(sum(t) / sum(n)) - sqrt(sum(b) / sum(n)) as point from {name}_c), {name}_num as (select *, row_number() over (order by cluster) - 1 as number from {name}_c),
       {name}_spots as (select draw, ('0x' || substr(md5(draw || '-' || spot), 1, 8))::bigint % k as number from {name}_k, range({DRAWS}) a(draw), lateral (select unnest(range(k)) as spot) b),
       {name}_deltas as (select draw, sqrt(sum(t) / sum(n)) - sqrt(sum(b) / sum(n)) as delta from {name}_spots join {name}_num using (number) group by draw),
       {name} as (select point, quantile_cont(delta, 0.025) as low, quantile_cont(delta, 0.975) as high, avg((delta > 0)::int)::double as p_worse from {name}_deltas, {name}_k group by point)"""


#: Squared errors of two constant predictions of the taxi time; a half of the days plays a month, short taxis the trimmed rows.
_ERRORS = "e as (select airport || '|' || (ts::date)::varchar as cluster, day(ts) % 2 as half, taxi <= 1800 as kept, pow(900 - taxi, 2) as b, pow(950 - taxi, 2) as t from m)"


def _rows(s, d):
    m = movements(s, d).withColumn("day", F.to_date("ts").cast("string")).withColumn("half", F.dayofmonth("ts") % 2)
    return m.withColumn("base", F.lit(900)).withColumn("treat", F.lit(950))


@query(f"with {MOV}, {_ERRORS}, {_boot_sql('boot', 'select * from e')} select round(point, 6) as point, round(low, 6) as low, round(high, 6) as high, round(p_worse, 6) as p_worse from boot")
def cluster_bootstrap(s, d):
    m = _rows(s, d)
    c = m.groupBy(F.concat_ws("|", "airport", "day").alias("cluster")).agg(F.sum(F.pow(F.col("taxi") - 900, F.lit(2))).alias("b"), F.sum(F.pow(F.col("taxi") - 950, F.lit(2))).alias("t"), n_rows().alias("n"))
    return E.cluster_bootstrap(c, base="b", treatment="t", n="n", draws=DRAWS).select(*[_r(c).alias(c) for c in ("point", "low", "high", "p_worse")])


@query(f"""with {MOV}, {_ERRORS}, {_boot_sql('trim', 'select * from e where kept')}, {_boot_sql('full_', 'select * from e')},
       halves as (select max(delta) as worst from (select sqrt(avg(t)) - sqrt(avg(b)) as delta from e where kept group by half))
       select round(trim.point, 6) as delta, round(trim.p_worse, 6) as p_worse, round(worst, 6) as worst_month, round(full_.p_worse, 6) as p_worse_full, trim.point < 0 and trim.p_worse < 0.05 and worst < 0 and full_.p_worse < 0.9 as adopt from trim, full_, halves""")
def adoption_rule(s, d):
    """Trimmed rows decide, pooled and in every month; all rows guard."""
    a = E.adoption(_rows(s, d), cluster=["airport", "day"], base="base", treatment="treat", truth="taxi", month="half", trimmed=F.col("taxi") <= 1800, draws=DRAWS)
    return a.select(*[_r(c).alias(c) for c in ("delta", "p_worse", "worst_month", "p_worse_full")], "adopt")


@query(f"""with {MOV}, g as (select runway is null as masked, pow(taxi - 900, 2) - pow(taxi - 950, 2) as gain from m)
       select masked, round(sum(gain), 4) as gain, round(sum(gain) / (select sum(gain) from g), 8) as share from g group by masked""")
def gain_share(s, d):
    gain = F.pow(F.col("taxi") - 900, F.lit(2)) - F.pow(F.col("taxi") - 950, F.lit(2))
    g = movements(s, d).groupBy(F.col("runway").isNull().alias("masked")).agg(F.sum(gain).alias("gain"))
    return g.select("masked", _r("gain", 4).alias("gain"), _r(F.col("gain") / F.sum("gain").over(Window.partitionBy()), 8).alias("share"))


@query("select o_orderkey, round((o_totalprice + o_totalprice * 1.01 + o_totalprice * 0.98) / 3, 6) as pred from orders")
def seed_ensemble(s, d):
    o = table(s, d, "orders")
    runs = [o.select("o_orderkey", (F.col("o_totalprice") * k).alias("pred")) for k in (1.0, 1.01, 0.98)]
    return B.seed_mean(runs, "o_orderkey", "pred").select("o_orderkey", _r("pred").alias("pred"))


@query("select count(o_totalprice) as n, round(avg(o_totalprice), 6) as mean, round(quantile_cont(o_totalprice, 0.1), 6) as p10, round(median(o_totalprice), 6) as p50, round(quantile_cont(o_totalprice, 0.9), 6) as p90, min(o_totalprice) as lo, max(o_totalprice) as hi from orders")
def distribution_summary(s, d):
    v = "o_totalprice"
    o = table(s, d, "orders")
    q = E.quantiles(o, v, [0.1, 0.5, 0.9]).select("q", F.lit(1).alias("_one"))
    a = o.agg(F.count(v).alias("n"), _r(F.avg(v)).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi")).withColumn("_one", F.lit(1)).join(q, "_one", "left")
    return a.select("n", "mean", *[_r(F.col("q")[i]).alias(p) for i, p in enumerate(("p10", "p50", "p90"))], "lo", "hi")


@query("""with t as (select l_suppkey, l_returnflag, count(*) as n from lineitem where l_orderkey % 5 <> 0 group by all), e as (select * from lineitem where l_orderkey % 5 = 0)
       select case when coalesce(n, 0) < 150 then 'few' when n < 200 then 'some' else 'many' end as band, count(*) as rows_, round(avg(l_quantity), 6) as mean from e left join t using (l_suppkey, l_returnflag) group by 1""")
def support_bands(s, d):
    line = table(s, d, "lineitem")
    key = ["l_suppkey", "l_returnflag"]
    t = line.where("l_orderkey % 5 <> 0").groupBy(*key).agg(n_rows().alias("n"))
    e = line.where("l_orderkey % 5 = 0").join(t, key, "left")
    return e.groupBy(X.bands(F.coalesce("n", F.lit(0)), [150, 200], ["few", "some", "many"]).alias("band")).agg(n_rows().alias("rows_"), _r(F.avg("l_quantity")).alias("mean"))


@query(f"""with p as (select *, ({_POS} * 5 // count(*) over ())::int as bin from lineitem)
       select bin, round(avg(l_quantity / 50), 8) as said, round(avg((l_extendedprice > 35000)::int), 8) as was from p group by bin""")
def calibration_bins(s, d):
    return _deciles(s, d, 5).groupBy("bin").agg(_r(F.avg(F.col("l_quantity") / 50), 8).alias("said"), _r(F.avg((F.col("l_extendedprice") > 35000).cast("int")), 8).alias("was"))


@query(f"""with p as (select l_extendedprice - 1500 * l_quantity as e, ({_POS} * 10 // count(*) over ())::int as bin from lineitem), g as (select bin, avg(e) as bias, avg(e * e) as mse, count(*) as n from p group by bin)
       select bin, round(bias, 4) as bias, round(bias * bias / mse, 8) as bias_share, round(n * mse / sum(n * mse) over (), 8) as sse_share from g""")
def bias_variance_deciles(s, d):
    e = F.col("l_extendedprice") - 1500 * F.col("l_quantity")
    g = _deciles(s, d).groupBy("bin").agg(F.avg(e).alias("bias"), F.avg(e * e).alias("mse"), n_rows().alias("n"))
    sse = F.col("n") * F.col("mse")
    return g.select("bin", _r("bias", 4).alias("bias"), _r(F.col("bias") * F.col("bias") / F.col("mse"), 8).alias("bias_share"), _r(sse / F.sum(sse).over(Window.partitionBy()), 8).alias("sse_share"))


@query(f"""with p as (select *, ({_POS} * 10 // count(*) over ())::int as bin from lineitem)
       select bin, round(corr(l_quantity, l_extendedprice), 8) as r, round(stddev_samp(l_extendedprice), 4) as sd from p group by bin""")
def corr_by_decile(s, d):
    return _deciles(s, d).groupBy("bin").agg(_r(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), _r(F.stddev_samp("l_extendedprice"), 4).alias("sd"))


@query(f"with {MOV} select max(abs((t_us - sched_us) - ((t_us - block_us) + d * 1000000))) as worst from m where phase = 'DEP'")
def identity_check(s, d):
    gap = (F.col("t_us") - F.col("sched_us")) - ((F.col("t_us") - F.col("block_us")) + F.col("d") * 1_000_000)
    return movements(s, d).where("phase = 'DEP'").agg(F.max(F.abs(gap)).alias("worst"))


@query(f"""with {MOV} select round(sqrt(avg(pow(taxi - 900, 2))), 6) as base, round(sqrt(avg(case when d < -400 then pow(taxi - 600, 2) else pow(taxi - 900, 2) end)), 6) as what_if from m""")
def what_if_sse(s, d):
    base, other = F.pow(F.col("taxi") - 900, F.lit(2)), F.pow(F.col("taxi") - 600, F.lit(2))
    return movements(s, d).agg(_r(F.sqrt(F.avg(base))).alias("base"), _r(F.sqrt(F.avg(F.when(F.col("d") < -400, other).otherwise(base)))).alias("what_if"))


@query(f"""with {MOV}, x as (select pow(taxi - 900, 2) as e, airport = 'A1' as hit from m), t as (select sum(e) as total, sum(e) filter (where hit) as part, count(*) as n from x)
       select scale, round(sqrt((total - scale * part) / n), 6) as rmse from t, (values (1.0), (0.5), (0.25)) s(scale)""")
def coverage_ceiling(s, d):
    e = F.pow(F.col("taxi") - 900, F.lit(2))
    t = movements(s, d).agg(F.sum(e).alias("total"), F.sum(F.when(F.col("airport") == "A1", e)).alias("part"), n_rows().alias("n"))
    scaled = t.withColumn("scale", F.explode(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25))))
    return scaled.select("scale", _r(F.sqrt((F.col("total") - F.col("scale") * F.col("part")) / F.col("n"))).alias("rmse"))


@query(f"with {MOV} select (runway is null)::int + (stand is null)::int + (taxi > 1500)::int as n_null, count(*) as n from m group by 1")
def near_total_null(s, d):
    n = F.col("runway").isNull().cast("int") + F.col("stand").isNull().cast("int") + (F.col("taxi") > 1500).cast("int")
    return movements(s, d).groupBy(n.alias("n_null")).agg(n_rows().alias("n"))


@query("select r, round(avg((value < r)::int), 8) as share from events, (values (5.0), (20.0), (60.0), (100.0)) t(r) group by r")
def proximity_curve(s, d):
    radii = (5.0, 20.0, 60.0, 100.0)
    wide = table(s, d, "events").agg(*[F.avg((F.col("value") < r).cast("int")).alias(f"r{i}") for i, r in enumerate(radii)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), _r(F.col(f"r{i}"), 8).alias("share")) for i, r in enumerate(radii)])).alias("x")).select("x.r", "x.share")


@query("select t as threshold, count(*) filter (where o_totalprice >= t) as n from orders, (values (1000.0), (2000.0), (4000.0)) x(t) group by t")
def threshold_sweep(s, d):
    ts = (1000.0, 2000.0, 4000.0)
    wide = table(s, d, "orders").agg(*[F.count_if(F.col("o_totalprice") >= t).alias(f"n{i}") for i, t in enumerate(ts)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(ts)])).alias("x")).select("x.threshold", "x.n")


@query(f"""with {MOV}, e as (select abs(taxi - 900) as a, abs(taxi - 700 - d / 4.0) as b, abs(taxi - (900 + 700 + d / 4.0) / 2) as mix from m)
       select round(avg((a < b)::int), 8) as first_closer, round(avg((a <= 60)::int), 8) as a60, round(avg((b <= 300)::int), 8) as b300, round(avg(mix), 6) as mix_mae from e""")
def estimator_compare(s, d):
    other = 700 + F.col("d") / 4.0
    a, b, mix = F.abs(F.col("taxi") - 900), F.abs(F.col("taxi") - other), F.abs(F.col("taxi") - (900 + other) / 2)
    rate = lambda c: _r(F.avg(c.cast("int")), 8)
    return movements(s, d).agg(rate(a < b).alias("first_closer"), rate(a <= 60).alias("a60"), rate(b <= 300).alias("b300"), _r(F.avg(mix)).alias("mix_mae"))
