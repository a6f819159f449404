"""Queries over the monthly panel: projections, filters, imputation, joins, windows, selections, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import selection as T
from ..operators import statistics as A
from ..operators import windows as W
from .registry import market, panel, query, read, rounded



def E():  # noqa: N802
    return W.along(["entity"], ["month"])


def RUN():  # noqa: N802
    return W.upto(["entity"], ["month"])


@query("panel_composite", """+ z as (select entity, month, case when stddev_pop(disc) over m < 1e-12 then 0 else (disc - avg(disc) over m) / stddev_pop(disc) over m end as zd,
 case when stddev_pop(tax) over m < 1e-12 then 0 else (tax - avg(tax) over m) / stddev_pop(tax) over m end as zt,
 case when stddev_pop(qty) over m < 1e-12 then 0 else (qty - avg(qty) over m) / stddev_pop(qty) over m end as zq from panel window m as (partition by month))
 select entity, month, round(zd - zt + zq, 6) as composite from z""")
def composite(spark, d):
    p = panel(spark, d)
    z = p.select("entity", "month", *[W.zscore(F.col(c), ["month"]).alias(c) for c in ("disc", "tax", "qty")])
    return z.select("entity", "month", F.round(W.signed_sum({"disc": 1, "tax": -1, "qty": 1}, z.columns), 6).alias("composite"))


@query("prj_alpha_target", """+ j as (select entity, month, ret, mret, ret - disc * mret as alpha from panel left join market using (month))
 select entity, month, round(alpha, 6) as alpha, case when alpha >= 0 then 1 else -1 end as target, cast(sign(alpha) as int) as side, round(coalesce(abs(alpha), 0), 6) as weight from j""")
def alpha_target(spark, d):
    j = panel(spark, d).join(F.broadcast(market(spark, d)), "month", "left").withColumn("alpha", F.col("ret") - F.col("disc") * F.col("mret"))
    return j.select("entity", "month", *rounded("alpha"), S.up_or_down(F.col("alpha")).alias("target"), F.signum("alpha").cast("int").alias("side"), F.round(F.coalesce(F.abs("alpha"), F.lit(0.0)), 6).alias("weight"))


@query("prj_safe_log_clip", """select entity, month, round(case when gap = 0 then 0 else ln(gap) end, 6) as log_gap, greatest(-0.1, least(0.1, ret)) as clipped,
 case when ret > 0.05 then 0.05 else ret end as capped from (select entity, month, gap, round(ret, 6) as ret from panel)""")
def safe_log_clip(spark, d):
    p = panel(spark, d).select("entity", "month", "gap", *rounded("ret"))
    return p.select("entity", "month", F.round(S.safe_log(F.col("gap")), 6).alias("log_gap"), F.when(F.col("ret").isNotNull(), S.clip(F.col("ret"), -0.1, 0.1)).otherwise(F.lit(0.1)).alias("clipped"), F.when(F.col("ret") > 0.05, 0.05).otherwise(F.col("ret")).alias("capped"))


@query("flt_min_history", "select entity, month, n from panel qualify count(*) over (partition by entity) >= 82")
def min_history(spark, d):
    return panel(spark, d).withColumn("__c", F.count(F.lit(1)).over(W.across(["entity"]))).where("__c >= 82").select("entity", "month", "n")


@query("flt_window_dropna", "select entity, month, round(ret, 6) as ret, round(gap, 6) as gap from panel where month >= date '1996-01-01' and month < date '1998-01-01' and ret is not null and gap is not null")
def window_dropna(spark, d):
    return panel(spark, d).where("month >= date'1996-01-01' and month < date'1998-01-01'").na.drop(subset=["ret", "gap"]).select("entity", "month", *rounded("ret", "gap"))


@query("flt_sparse_columns", "select 'gap' as dropped where (select count(*) filter (where gap is null) from panel) > 100")
def sparse_columns(spark, d):
    p = panel(spark, d)
    counts = p.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("px", "qty", "disc", "tax", "gap")])
    return counts.unpivot([], ["px", "qty", "disc", "tax", "gap"], "dropped", "n").where("n > 100").select("dropped")


@query("flt_iqr_outlier", """+ b as (select quantile_cont(ret, 0.25) as a, quantile_cont(ret, 0.75) as c from panel)
 select entity, month, (ret < a - 1.5 * (c - a) or ret > c + 1.5 * (c - a)) as outlier from panel, b where ret is not null""")
def iqr_outlier(spark, d):
    p = panel(spark, d).where("ret is not null")
    q = p.agg(F.percentile("ret", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    wide = F.col("q")[1] - F.col("q")[0]
    return p.join(F.broadcast(q)).select("entity", "month", ((F.col("ret") < F.col("q")[0] - 1.5 * wide) | (F.col("ret") > F.col("q")[1] + 1.5 * wide)).alias("outlier"))


@query("flt_membership", "select s_suppkey, s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1) and s_suppkey not in (select entity from panel where qty > 700)")
def membership(spark, d):
    s, n = read(spark, d, "supplier"), read(spark, d, "nation").where("n_regionkey = 1")
    big = panel(spark, d).where("qty > 700").select(F.col("entity").alias("s_suppkey"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left_semi").join(big, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query("imp_month_median", "select entity, month, round(coalesce(gap, median(gap) over (partition by month)), 6) as filled from panel")
def month_median(spark, d):
    return W.fill_median(panel(spark, d).select("entity", "month", "gap"), "gap", ["month"]).select("entity", "month", F.round("gap", 6).alias("filled"))


@query("imp_fill", """select entity, month, round(last_value(gap ignore nulls) over (partition by entity order by month rows between unbounded preceding and current row), 6) as forward,
 round(first_value(gap ignore nulls) over (partition by entity order by month rows between current row and unbounded following), 6) as backward, round(coalesce(gap, 0), 6) as constant from panel""")
def fill(spark, d):
    g = F.col("gap")
    return panel(spark, d).select("entity", "month", F.round(W.forward_fill(g, RUN()), 6).alias("forward"), F.round(W.backward_fill(g, E()), 6).alias("backward"), F.round(F.coalesce(g, F.lit(0.0)), 6).alias("constant"))


@query("imp_infinite", "select entity, month, case when qty <> 100 then px / (qty - 100) end as ratio from panel")
def infinite(spark, d):
    r = F.try_divide(F.col("px"), F.col("qty") - 100)
    return panel(spark, d).select("entity", "month", S.null_if_nan(r).alias("ratio"))


@query("jn_benchmark_inner", "select month, round(avg(ret), 6) as portfolio, round(any_value(mret), 6) as benchmark from panel join market using (month) where mret is not null group by month")
def benchmark_inner(spark, d):
    own = panel(spark, d).groupBy("month").agg(F.avg("ret").alias("portfolio"))
    return own.join(market(spark, d).where("mret is not null"), "month").select("month", F.round("portfolio", 6).alias("portfolio"), F.round("mret", 6).alias("benchmark"))


@query("jn_shifted_self", "select a.entity, a.month, b.entity is not null as stayed from panel a left join panel b on a.entity = b.entity and b.month = cast(a.month - interval 1 month as date)")
def shifted_self(spark, d):
    p = panel(spark, d).select("entity", "month")
    before = p.select("entity", F.add_months("month", 1).alias("month"), F.lit(True).alias("stayed"))
    return p.join(before, ["entity", "month"], "left").select("entity", "month", F.coalesce("stayed", F.lit(False)).alias("stayed"))


@query("jn_outer_columns", "select month, round(mret, 6) as mret, d.n from market full outer join (select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n from orders group by 1) d using (month)")
def outer_columns(spark, d):
    o = read(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return market(spark, d).join(o, "month", "full").select("month", *rounded("mret"), "n")


@query("jn_dictionary_lookup", "select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def dictionary_lookup(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    names = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    s = read(spark, d, "supplier")
    return s.join(F.broadcast(names), s.s_nationkey == names.n_nationkey, "left").select("s_suppkey", "n_name", "r_name")


@query("jn_purge", """+ v as (select o_orderkey as id, o_orderdate as t0, o_orderdate + interval 20 day as t1 from orders), te as (select * from v where t0 >= date '1995-01-01' and t0 < date '1996-01-01')
 select id from v where not exists (select 1 from te where v.t0 <= te.t1 and v.t1 >= te.t0)""")
def purge(spark, d):
    v = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("t0"), (F.col("o_orderdate") + F.expr("interval 20 days")).cast("timestamp").alias("t1"))
    fold = v.where("t0 >= date'1995-01-01' and t0 < date'1996-01-01'")
    return J.purge(v, fold, "t0", "t1").select("id")


@query("win_index", """+ g as (select entity, month, ret, product(1 + ret) over (partition by entity order by month rows unbounded preceding) as s from panel)
 select entity, month, round(case when ret is not null then 100 * s end, 4) as price_index, round(case when ret is not null then s - 1 end, 6) as cumulative,
 round(case when row_number() over w = 1 then 0 else lag(ret) over w end, 6) as lagged from g window w as (partition by entity order by month)""")
def index(spark, d):
    p = panel(spark, d)
    return p.select("entity", "month", F.round(W.price_index(F.col("ret"), RUN()), 4).alias("price_index"), F.round(W.growth(F.col("ret"), RUN()) - 1, 6).alias("cumulative"), F.round(W.first_zero_lag(F.col("ret"), E()), 6).alias("lagged"))


@query("win_running", """select entity, month, round(case when row_number() over w = 1 then 0 else px - lag(px) over w end, 4) as diff, round(sum(qty) over (w rows unbounded preceding), 2) as run_sum,
 max(qty) over (w rows unbounded preceding) as run_max, lead(qty) over w as next_qty from panel window w as (partition by entity order by month)""")
def running(spark, d):
    return panel(spark, d).select("entity", "month", F.round(W.difference(F.col("px"), E()), 4).alias("diff"), F.round(F.sum("qty").over(RUN()), 2).alias("run_sum"), F.max("qty").over(RUN()).alias("run_max"), F.lead("qty").over(E()).alias("next_qty"))


@query("win_rolling", """select entity, month, round(case when count(ret) over f = 12 then avg(ret) over f end, 6) as mean12, round(case when count(ret) over f = 12 then stddev_samp(ret) over f end, 6) as vol12
 from panel window f as (partition by entity order by month rows between 11 preceding and current row)""")
def rolling(spark, d):
    r = F.col("ret")
    return panel(spark, d).select("entity", "month", F.round(W.rolling(F.avg, r, E(), 12), 6).alias("mean12"), F.round(W.rolling(F.stddev_samp, r, E(), 12), 6).alias("vol12"))


@query("win_ewm", """+ o as (select entity, month, px, row_number() over (partition by entity order by month) as i from panel),
 w as (select a.entity, a.month, pow(1 - 2.0 / 11, a.i - b.i) as u, b.px from o a join o b on a.entity = b.entity and b.i <= a.i)
 select entity, month, round(sum(u * px) / sum(u), 4) as ewm_mean from w group by 1, 2""")
def ewm(spark, d):
    p = panel(spark, d).select("entity", F.col("month").cast("timestamp").alias("month"), "px")
    return W.ewm(p, ["entity"], "month", "px", 10).select("entity", F.col("month").cast("date").alias("month"), F.round("ewm_mean", 4).alias("ewm_mean"))


@query("win_ewm_std", """+ o as (select entity, month, ret, row_number() over (partition by entity order by month) as i from panel where ret is not null),
 w as (select a.entity, a.month, pow(1 - 2.0 / 13, a.i - b.i) as u, b.ret as x, a.i - b.i as back, b.i = 1 as oldest from o a join o b on a.entity = b.entity and b.i <= a.i),
 m as (select entity, month, sum(u) as s1, sum(u * u) as s2, sum(u * x) / sum(u) as mean, sum(case when oldest then u else u * 2.0 / 13 end * x) as rec from w group by 1, 2),
 v as (select entity, month, sum(w.u * (w.x - m.mean) * (w.x - m.mean)) / any_value(s1) as biased from w join m using (entity, month) group by 1, 2)
 select entity, month, round(mean, 6) as ewm_mean, round(rec, 6) as ewm_recursive, round(case when s1 * s1 - s2 > 1e-12 * s1 * s1 then sqrt(biased * s1 * s1 / (s1 * s1 - s2)) end, 6) as ewm_std from m join v using (entity, month)""")
def ewm_std(spark, d):
    p = panel(spark, d).where("ret is not null").select("entity", F.col("month").cast("timestamp").alias("month"), "ret")
    return W.ewm(p, ["entity"], "month", "ret", 12).select("entity", F.col("month").cast("date").alias("month"), *rounded("ewm_mean", "ewm_recursive", "ewm_std"))


@query("win_rank_scaled", """+ r as (select entity, month, disc, dense_rank() over (partition by month order by disc) - 1 as k from panel), t as (select *, max(k) over (partition by month) as top from r)
 select entity, month, round(case when top = 0 then 0 else cast(k as double) / top * 2 - 1 end, 6) as scaled from t""")
def rank_scaled(spark, d):
    return panel(spark, d).select("entity", "month", F.round(W.rank_scaled(F.col("disc"), ["month"]), 6).alias("scaled"))


@query("win_decile", """+ r as (select entity, month, rank() over (partition by month order by qty) + (count(*) over (partition by month, qty) - 1) / 2.0 as a, count(*) over (partition by month) as c from panel)
 select entity, month, cast(floor(a * 10 / (c + 1)) as int) as decile from r""")
def decile(spark, d):
    return panel(spark, d).select("entity", "month", W.decile(F.col("qty"), ["month"]).alias("decile"))


@query("win_min_max", "select entity, month, round(case when max(tax) over m = min(tax) over m then 0 else (tax - min(tax) over m) / (max(tax) over m - min(tax) over m) end, 6) as scaled from panel window m as (partition by month)")
def min_max(spark, d):
    return panel(spark, d).select("entity", "month", F.round(W.min_max(F.col("tax"), ["month"]), 6).alias("scaled"))


@query("win_latest_name", "select distinct entity, last_value(n) over (partition by entity order by month rows between unbounded preceding and unbounded following) as latest from panel")
def latest_name(spark, d):
    return panel(spark, d).groupBy("entity").agg(F.max_by("n", "month").alias("latest"))


@query("win_time_decay", """+ c as (select month, sum(n) as n from panel group by month), r as (select month, sum(n) over (order by month) as s, sum(n) over () as t from c)
 select month, round(greatest(0, (1 - 0.5) / t * s + 1 - (1 - 0.5) / t * t), 6) as linear, round(pow(0.5, 1 - s / t), 6) as exponential from r""")
def time_decay(spark, d):
    return A.time_decay(panel(spark, d), "month", "n", 0.5)


@query("win_lags", "select entity, month, " + ", ".join(f"lag(qty, {k}) over w as lag{k}" for k in range(4)) + " from panel window w as (partition by entity order by month)")
def lags(spark, d):
    return panel(spark, d).select("entity", "month", *[F.lag("qty", k).over(E()).alias(f"lag{k}") for k in range(4)])


@query("win_crossover", """+ a as (select entity, month, avg(px) over (w rows 2 preceding) as fast, avg(px) over (w rows 9 preceding) as slow, row_number() over w as i from panel window w as (partition by entity order by month)),
 s as (select *, lag(fast) over (partition by entity order by month) as lf, lag(slow) over (partition by entity order by month) as ls from a where i >= 10)
 select entity, month, case when lf <= ls and fast > slow then 1 when lf >= ls and fast < slow then -1 else 0 end as signal from s where lf is not null""")
def crossover(spark, d):
    a = panel(spark, d).withColumns({"fast": W.rolling(F.avg, F.col("px"), E(), 3), "slow": W.rolling(F.avg, F.col("px"), E(), 10)}).where("slow is not null")
    s = a.withColumns({"lf": F.lag("fast").over(E()), "ls": F.lag("slow").over(E())}).where("lf is not null")
    return s.select("entity", "month", F.expr("case when lf <= ls and fast > slow then 1 when lf >= ls and fast < slow then -1 else 0 end").alias("signal"))


@query("win_technical", """+ a as (select entity, month, px, avg(px) over f as ma, stddev_samp(px) over f as sd, count(px) over f as c, px - lag(px) over w as ch from panel window w as (partition by entity order by month), f as (partition by entity order by month rows 9 preceding)),
 r as (select *, avg(greatest(ch, 0)) over (partition by entity order by month rows 13 preceding) as up, avg(greatest(-ch, 0)) over (partition by entity order by month rows 13 preceding) as dn, count(ch) over (partition by entity order by month rows 13 preceding) as k from a)
 select entity, month, round(ma + 2 * sd, 4) as upper, round(ma - 2 * sd, 4) as lower, round(100 - 100 / (1 + up / dn), 4) as rsi from r where c = 10 and k = 14 and dn > 0""")
def technical(spark, d):
    return A.technical(panel(spark, d), E(), "px", 10, 14).select("entity", "month", *rounded("upper", "lower", "rsi", places=4))


@query("top_long_only", "select month, entity, cast(pick as int) as pick from (select month, entity, row_number() over (partition by month order by ret desc, entity) as pick from panel where ret > 0) where pick <= 10")
def long_only(spark, d):
    return T.long_only(panel(spark, d), ["month"], "ret", 10, ["entity"]).select("month", "entity", "pick")


@query("top_absolute", "select month, entity, cast(pick as int) as pick from (select month, entity, row_number() over (partition by month order by abs(ret) desc, entity) as pick from panel where ret is not null) where pick <= 10")
def absolute(spark, d):
    return T.top_k(panel(spark, d).where("ret is not null"), ["month"], F.abs("ret"), 10, ["entity"]).select("month", "entity", "pick")


@query("top_long_short", """+ r as (select month, entity, row_number() over (partition by month order by ret desc, entity) as h, row_number() over (partition by month order by ret, entity) as l from panel where ret is not null)
 select month, entity, case when h <= 5 then 1 else -1 end as side from r where h <= 5 or l <= 5""")
def long_short(spark, d):
    return T.long_short(panel(spark, d), ["month"], "ret", 10, ["entity"]).select("month", "entity", "side")


@query("top_capped_turnover", """+ r as (select entity, month, qty, row_number() over (partition by month order by qty desc, entity) as k from panel),
 b as (select entity, cast(month + interval 1 month as date) as month from r where k <= 15), j as (select r.month, r.entity, r.qty, b.entity is not null as kept from r left join b on r.entity = b.entity and r.month = b.month)
 select month, entity, cast(kept as int) as kept from (select *, row_number() over (partition by month order by kept desc, qty desc, entity) as p from j) where p <= 20""")
def capped_turnover(spark, d):
    p = panel(spark, d).select("entity", "month", "qty")
    now = p.select(F.col("month").alias("period"), "entity", "qty")
    before = p.select(F.add_months("month", 1).alias("period"), "entity", "qty")
    return T.capped_turnover(now, before, "entity", "qty", 20).select(F.col("period").alias("month"), "entity", "kept")


@query("set_operations", """select 'union' as op, count(*) as n from (select l_suppkey from lineitem union select s_suppkey from supplier) union all
 select 'intersect', count(*) from (select o_custkey from orders intersect select c_custkey from customer) union all select 'except', count(*) from (select c_custkey from customer except select o_custkey from orders)""")
def set_operations(spark, d):
    a, b = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    o, c = read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    made = {"union": a.union(b).distinct(), "intersect": o.intersect(c), "except": c.subtract(o)}
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, x in made.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("set_keep_first", "select entity, month, qty from (select *, row_number() over (partition by entity order by qty desc, month) as r from panel) where r = 1")
def keep_first(spark, d):
    return T.keep_one(panel(spark, d), ["entity"], [F.desc("qty"), F.asc("month")]).select("entity", "month", "qty")


@query("pivot_wide", "select month, " + ", ".join(f"max(qty) filter (where entity = {k}) as e{k}" for k in range(1, 6)) + " from panel group by month")
def pivot_wide(spark, d):
    p = panel(spark, d).groupBy("month").pivot("entity", list(range(1, 6))).agg(F.first("qty"))
    return p.select("month", *[F.col(f"`{k}`").alias(f"e{k}") for k in range(1, 6)])


@query("pivot_long", "select entity, month, metric, value from (select entity, month, qty, cast(n as double) as n from panel) unpivot include nulls (value for metric in (qty, n))")
def pivot_long(spark, d):
    return panel(spark, d).select("entity", "month", "qty", F.col("n").cast("double").alias("n")).unpivot(["entity", "month"], ["qty", "n"], "metric", "value")


@query("dates_business_month", """+ m as (select distinct month as d from panel), e as (select d, cast(d + interval 1 month - interval 1 day as date) as l from m)
 select d as month, cast(l - interval (greatest(isodow(l) - 5, 0)) day as date) as month_end, cast(d + interval (case when isodow(d) > 5 then 8 - isodow(d) else 0 end) day as date) as month_first from e""")
def business_month(spark, d):
    m = panel(spark, d).select("month").distinct()
    return m.select("month", S.month_end_weekday(F.col("month")).alias("month_end"), S.month_first_weekday(F.last_day("month")).alias("month_first"))


@query("agg_signal_by_month", """select month, count(*) filter (where ret > 0) as hits, count(*) filter (where ret < 0) as misses, round(avg(ret) filter (where ret > 0), 6) as mean_hit, round(avg(ret) filter (where ret < 0), 6) as mean_miss,
 round(sum(sum(ret)) over (order by month), 5) as run_total from panel group by month""")
def signal_by_month(spark, d):
    return A.hit_miss(panel(spark, d), ["month"], "ret").withColumn("run_total", F.round(F.sum("total").over(Window.orderBy("month")), 5)).select("month", "hits", "misses", *rounded("mean_hit", "mean_miss"), "run_total")


@query("agg_signal_by_entity", "select entity, count(*) filter (where ret > 0) as hits, count(*) filter (where ret < 0) as misses, round(avg(ret) filter (where ret > 0), 6) as mean_hit, round(avg(ret) filter (where ret < 0), 6) as mean_miss from panel group by entity")
def signal_by_entity(spark, d):
    return A.hit_miss(panel(spark, d), ["entity"], "ret").select("entity", "hits", "misses", *rounded("mean_hit", "mean_miss"))


@query("agg_long_short_split", """+ w as (select month, case when ret is null then 0 else sign(ret) / 100.0 end as wt, coalesce(ret, 0) as ret from panel)
 select month, round(coalesce(sum(wt * ret) filter (where wt > 0), 0), 6) as long_part, round(coalesce(sum(wt * ret) filter (where wt < 0), 0), 6) as short_part, count(*) filter (where wt > 0) as n_long from w group by month""")
def long_short_split(spark, d):
    w = panel(spark, d).select("month", F.coalesce(F.signum("ret") / 100, F.lit(0.0)).alias("wt"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("wt") * F.col("ret"))), F.lit(0.0))
    return w.groupBy("month").agg(F.round(part(F.col("wt") > 0), 6).alias("long_part"), F.round(part(F.col("wt") < 0), 6).alias("short_part"), F.count_if(F.col("wt") > 0).alias("n_long"))


_STATS = """+ r as (select month, avg(ret) as r from panel where ret is not null group by month), b as (select r.month, r, mret from r join market using (month) where mret is not null),
 c as (select *, exp(sum(ln(1 + r)) over (order by month)) - 1 as c from b), x as (select *, max(c) over (order by month) as top from c)
 select count(*) as n, round(max_by(c, month), 5) as total, round(pow(1 + max_by(c, month), 12.0 / count(*)) - 1, 6) as annual_return, round(12 * avg(r), 6) as average_annual, round(sqrt(12) * stddev_samp(r), 6) as annual_vol,
 round(12 * avg(r) / (sqrt(12) * stddev_samp(r)), 6) as sharpe, round(min(case when top <> 0 then (c - top) / top end), 5) as max_drawdown, round(count(*) filter (where top <> 0 and (c - top) / top < 0) / 12.0, 6) as under_water,
 round(min(r), 6) as worst_month, round(12 * avg(r - mret) / (sqrt(12) * stddev_samp(r - mret)), 6) as information_ratio, round(12 * regr_intercept(r, mret), 6) as alpha, round(sqrt(12) * (stddev_samp(r) - stddev_samp(mret)), 6) as tracking_error,
 round(corr(r, mret), 6) as correlation from x"""


@query("agg_return_statistics", _STATS)
def return_statistics(spark, d):
    r = panel(spark, d).where("ret is not null").groupBy("month").agg(F.avg("ret").alias("r"))
    return A.return_statistics(r.join(market(spark, d).where("mret is not null").withColumnRenamed("mret", "b"), "month"), "month", "r", "b").drop("psr", "calmar")


@query("agg_probabilistic_sharpe", _STATS[: _STATS.rindex(" select ")] + f""", y as (select arg_max(c, month) as total, count(*) as n, avg(r) / stddev_samp(r) * sqrt(count(*)) as z, min(case when top <> 0 then (c - top) / top end) as dd from x)
 select round({S.normal_cdf_sql("z")}, 6) as psr, round((pow(1 + total, 12.0 / n) - 1) / abs(dd), 6) as calmar from y""")
def probabilistic_sharpe(spark, d):
    r = panel(spark, d).where("ret is not null").groupBy("month").agg(F.avg("ret").alias("r"))
    return A.return_statistics(r.join(market(spark, d).where("mret is not null").withColumnRenamed("mret", "b"), "month"), "month", "r", "b").select("psr", "calmar")


@query("agg_turnover", """+ w as (select entity, month, qty / sum(qty) over (partition by month) as w from panel), l as (select *, lag(w) over (partition by entity order by month) as p from w),
 t as (select month, sum(coalesce(abs(w - p), 0)) as t from l group by month) select round(avg(t), 6) as turnover from t""")
def turnover(spark, d):
    w = panel(spark, d).withColumn("w", F.col("qty") / F.sum("qty").over(W.across(["month"])))
    return A.turnover(w, "entity", "month", "w").select(*rounded("turnover"))


@query("agg_na_profile", "select year(month) as y, count(*) filter (where gap is null) as gaps, count(*) filter (where ret is null) as rets, count(distinct entity) filter (where gap is null) as entities from panel group by 1")
def na_profile(spark, d):
    return panel(spark, d).groupBy(F.year("month").cast("long").alias("y")).agg(F.count_if(F.col("gap").isNull()).alias("gaps"), F.count_if(F.col("ret").isNull()).alias("rets"), F.count_distinct(F.when(F.col("gap").isNull(), F.col("entity"))).alias("entities"))


@query("agg_decile_returns", """+ r as (select entity, month, ret, qty, lag(qty) over (partition by entity order by month) as pq from panel), k as (select *, rank() over (partition by month order by pq) + (count(*) over (partition by month, pq) - 1) / 2.0 as a, count(*) over (partition by month) as c from r where pq is not null),
 f as (select month, cast(floor(a * 10 / (c + 1)) as int) as decile, avg(ret) as m from k group by 1, 2)
 select month, round(max(m) filter (where decile = 9) - max(m) filter (where decile = 0), 6) as spread from f group by month""")
def decile_returns(spark, d):
    r = panel(spark, d).withColumn("pq", F.lag("qty").over(E())).where("pq is not null")
    f = r.withColumn("decile", W.decile(F.col("pq"), ["month"])).groupBy("month").pivot("decile", list(range(10))).agg(F.avg("ret"))
    return f.select("month", F.round(F.col("`9`") - F.col("`0`"), 6).alias("spread"))


@query("agg_describe", """select round(avg(ret), 6) as mean, round(stddev_samp(ret), 6) as std, round(min(ret), 6) as low, round(quantile_cont(ret, 0.25), 6) as q1, round(median(ret), 6) as q2, round(quantile_cont(ret, 0.75), 6) as q3, round(max(ret), 6) as high, count(ret) as n from panel""")
def describe(spark, d):
    return A.describe(panel(spark, d), "ret").select(*rounded("mean", "std", "low", "q1", "q2", "q3", "high"), "n")


@query("agg_moments", """+ s as (select count(ret) as cnt, avg(ret) as m from panel), c as (select cnt as n, sum(pow(ret - m, 2)) / cnt as m2, sum(pow(ret - m, 3)) / cnt as m3, sum(pow(ret - m, 4)) / cnt as m4 from panel, s where ret is not null group by cnt)
 select round(m3 / pow(m2, 1.5), 5) as skew, round(m4 / (m2 * m2) - 3, 5) as kurtosis, round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 2) as jarque_bera, round(sqrt(n * (n - 1.0)) / (n - 2.0) * m3 / pow(m2, 1.5), 5) as sample_skew from c""")
def moments(spark, d):
    return A.moments(panel(spark, d), "ret").select(*rounded("skew", "kurtosis", places=5), *rounded("jarque_bera", places=2), *rounded("sample_skew", places=5))


@query("agg_variance_of_variance", "select round(var_samp(v) * 1e3, 6) as v from (select month(month) as m, var_samp(ret) as v from panel group by 1)")
def variance_of_variance(spark, d):
    v = panel(spark, d).groupBy(F.month("month").alias("m")).agg(F.var_samp("ret").alias("v"))
    return v.agg(F.round(F.var_samp("v") * 1e3, 6).alias("v"))


@query("agg_autocorrelation", "select entity, round(corr(r, l), 6) as rho from (select entity, ret as r, lag(ret) over (partition by entity order by month) as l from panel) where r is not null and l is not null group by entity")
def autocorrelation(spark, d):
    return panel(spark, d).select("entity", F.col("ret").alias("r"), F.lag("ret").over(E()).alias("l")).where("r is not null and l is not null").groupBy("entity").agg(F.round(F.corr("r", "l"), 6).alias("rho"))


@query("agg_top_average", "select entity, round(avg(qty), 6) as mean_qty from panel group by entity order by avg(qty) desc, entity limit 10")
def top_average(spark, d):
    return panel(spark, d).groupBy("entity").agg(F.avg("qty").alias("a")).orderBy(F.desc("a"), "entity").limit(10).select("entity", F.round("a", 6).alias("mean_qty"))


@query("agg_value_counts", "select o_orderpriority as k, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from orders group by 1")
def value_counts(spark, d):
    c = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("agg_classification", """+ y as (select d.doc_id, case when length(text) > 1500 then 1 else 0 end as p, quality as y, least(0.999, greatest(0.001, length(text) / 5000.0)) as s from documents d join labels l using (doc_id) where quality is not null),
 k as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from y)
 select round(avg(case when p = y then 1.0 else 0 end), 6) as accuracy, round(sum(p * y) / cast(sum(p) as double), 6) as precis, round(sum(p * y) / cast(sum(y) as double), 6) as recall,
 round((sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (cast(sum(y) as double) * (count(*) - sum(y))), 6) as auc, round(-avg(y * ln(s) + (1 - y) * ln(1 - s)), 6) as log_loss from k""")
def classification(spark, d):
    s = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.length("text") / 5000.0))
    y = read(spark, d, "documents").join(read(spark, d, "labels").where("quality is not null"), "doc_id").select(F.when(F.length("text") > 1500, 1).otherwise(0).alias("p"), F.col("quality").alias("y"), s.alias("s"))
    return A.classification(y, "y", "p", "s")


@query("agg_regression", "select round(avg(pow(ret - mret, 2)), 8) as mse, round(avg(abs(ret - mret)), 6) as mae, round(1 - sum(pow(ret - mret, 2)) / sum(pow(ret, 2)), 6) as oos_r2 from panel join market using (month) where ret is not null and mret is not null")
def regression(spark, d):
    j = panel(spark, d).join(F.broadcast(market(spark, d)), "month").where("ret is not null and mret is not null")
    e = F.col("ret") - F.col("mret")
    return j.agg(F.round(F.avg(e * e), 8).alias("mse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(1 - F.sum(e * e) / F.sum(F.col("ret") * F.col("ret")), 6).alias("oos_r2"))


@query("agg_vol_gap_share", """+ r as (select month, avg(ret) as r from panel where ret is not null group by month), j as (select r.month, r, mret from r join market using (month) where mret is not null),
 s as (select count(r) over f as c, stddev_samp(r) over f as a, stddev_samp(mret) over f as b from j window f as (order by month rows 11 preceding)) select round(count(*) filter (where c = 12 and a - b > 0.01) / cast(count(*) as double), 6) as share from s""")
def vol_gap_share(spark, d):
    r = panel(spark, d).where("ret is not null").groupBy("month").agg(F.avg("ret").alias("r")).join(market(spark, d).where("mret is not null"), "month")
    w = Window.orderBy("month")
    gap = W.rolling(F.stddev_samp, F.col("r"), w, 12) - W.rolling(F.stddev_samp, F.col("mret"), w, 12)
    return r.withColumn("g", gap).agg(F.round(F.count_if(F.col("g") > 0.01) / F.count(F.lit(1)), 6).alias("share"))


@query("pf_equal_weight", "select month, entity, round(1.0 / count(*) over (partition by month), 8) as weight from (select month, entity, row_number() over (partition by month order by ret desc, entity) as k from panel where ret > 0) where k <= 10")
def equal_weight(spark, d):
    t = T.long_only(panel(spark, d), ["month"], "ret", 10, ["entity"])
    return t.select("month", "entity", F.round(1 / F.count(F.lit(1)).over(W.across(["month"])), 8).alias("weight"))


@query("pf_inverse_variance", """+ v as (select entity, var_samp(ret) as v from panel group by entity having var_samp(ret) > 0) select entity, round(1 / v / sum(1 / v) over (), 8) as weight from v""")
def inverse_variance(spark, d):
    v = panel(spark, d).groupBy("entity").agg(F.var_samp("ret").alias("v")).where("v > 0")
    total = v.agg(F.sum(1 / F.col("v")).alias("t"))
    return v.join(F.broadcast(total)).select("entity", F.round(1 / F.col("v") / F.col("t"), 8).alias("weight"))


@query("pf_factor_composite", """+ z as (select entity, month, round(1 / px, 10) as value, ret as momentum, -ln(qty) as size from panel) select entity, month, round(value + momentum + size, 6) as signal from z""")
def factor_composite(spark, d):
    return panel(spark, d).select("entity", "month", F.round(F.round(1 / F.col("px"), 10) + F.col("ret") - F.log("qty"), 6).alias("signal"))


@query("cv_rolling_windows", """+ w as (select k, date '1995-01-01' + to_years(cast(k as int)) as a, date '1995-01-01' + to_years(cast(k + 2 as int)) as b, date '1995-01-01' + to_years(cast(k + 3 as int)) as c, date '1995-01-01' + to_years(cast(k + 4 as int)) as d from range(0, 4) t(k))
 select cast(k as int) as window_id, count(*) filter (where month >= a and month < b) as n_train, count(*) filter (where month >= b and month < c) as n_val, count(*) filter (where month >= c and month < d) as n_test from panel, w group by k""")
def rolling_windows(spark, d):
    return A.rolling_splits(panel(spark, d), "month", "1995-01-01", 4, 2, 1, 1)


@query("sta_frac_diff", """+ o as (select entity, month, ln(px) as x from panel) select entity, month, round(x - 0.4 * lag(x) over w - 0.12 * lag(x, 2) over w - 0.064 * lag(x, 3) over w - 0.0416 * lag(x, 4) over w, 6) as fd from o window w as (partition by entity order by month)
 qualify lag(x, 4) over w is not null""")
def frac_diff(spark, d):
    fd = A.frac_diff(F.log("px"), E(), A.ffd_weights(0.4, size=5))
    return panel(spark, d).select("entity", "month", F.round(fd, 6).alias("fd")).where("fd is not null")
