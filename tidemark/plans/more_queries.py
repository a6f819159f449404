"""Further queries: growth rates, covariances, expanding splits, feature probes, volatility labels, attribution weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import labels as L
from ..operators import selection as T
from ..operators import windows as W
from .registry import TICKS_SQL, market, panel, query, read, rounded, ticks
from .tick_queries import EVENTS_SQL, events


def along():
    return W.along(["entity"], ["month"])


@query("win_percent_change", "select entity, month, round(gap2 / lag(gap2) over w - 1, 6) as change from (select entity, month, last_value(gap ignore nulls) over (partition by entity order by month rows unbounded preceding) + 1 as gap2 from panel) window w as (partition by entity order by month)")
def percent_change(spark, d):
    """Change of the last known value."""
    filled = panel(spark, d).withColumn("g", W.forward_fill(F.col("gap"), W.upto(["entity"], ["month"])) + 1)
    return filled.select("entity", "month", F.round(W.percent_change(F.col("g"), along()), 6).alias("change"))


@query("win_rolling_covariance", """+ j as (select entity, month, ret, mret from panel join market using (month) where ret is not null and mret is not null)
 select entity, month, round(case when count(*) over f = 24 then covar_samp(ret, mret) over f * 1e3 end, 6) as cov from j window f as (partition by entity order by month rows 23 preceding)""")
def rolling_covariance(spark, d):
    j = panel(spark, d).join(F.broadcast(market(spark, d)), "month").where("ret is not null and mret is not null")
    f = along().rowsBetween(-23, 0)
    return j.select("entity", "month", F.round(F.when(F.count(F.lit(1)).over(f) == 24, F.covar_samp("ret", "mret").over(f) * 1e3), 6).alias("cov"))


@query("win_bands", """+ b as (select entity, month, px, avg(px) over f as ma, count(px) over f as c, lag(px) over w as lp from panel window w as (partition by entity order by month), f as (partition by entity order by month rows 9 preceding))
 select entity, month, case when lp <= ma * 1.02 and px > ma * 1.02 then 1 when lp >= ma * 0.98 and px < ma * 0.98 then -1 else 0 end as crossing from b where c = 10""")
def bands(spark, d):
    """Outward crossings of percentage bands; the price before is held against the band now."""
    b = panel(spark, d).withColumns({"ma": W.rolling(F.avg, F.col("px"), along(), 10), "lp": F.lag("px").over(along())}).where("ma is not null")
    return b.select("entity", "month", F.expr("case when lp <= ma * 1.02 and px > ma * 1.02 then 1 when lp >= ma * 0.98 and px < ma * 0.98 then -1 else 0 end").alias("crossing"))


@query("win_vol_bars", "select k, round(stddev_samp(r), 6) as vol, count(r) as n from (select k, ln(price) - ln(lag(price) over (partition by k order by ts)) as r from ticks where price > 0) group by k", TICKS_SQL)
def vol_bars(spark, d):
    t = ticks(spark, d).where("price > 0")
    r = F.log("price") - F.log(F.lag("price").over(Window.partitionBy("k").orderBy("ts")))
    return t.withColumn("r", r).groupBy("k").agg(F.round(F.stddev_samp("r"), 6).alias("vol"), F.count("r").alias("n"))


@query("agg_growth_rate", """+ y as (select entity, year(month) as y, arg_min(px, month) as a, arg_max(px, month) as b from panel group by 1, 2),
 g as (select entity, y, coalesce(b / nullif(a, 0) - 1, 0) as g from y), m as (select y, avg(g) as m from g where g <> 0 group by y) select entity, g.y, round(coalesce(g.g / nullif(m.m, 0), 0), 3) as ratio from g left join m using (y)""")
def growth_rate(spark, d):
    """Yearly growth against the mean of all non-zero ones; 0 where it can't be told."""
    y = panel(spark, d).groupBy("entity", F.year("month").cast("long").alias("y")).agg(F.min_by("px", "month").alias("a"), F.max_by("px", "month").alias("b"))
    g = y.select("entity", "y", F.coalesce(F.try_divide("b", "a") - 1, F.lit(0.0)).alias("g"))
    m = g.where("g <> 0").groupBy("y").agg(F.avg("g").alias("m"))
    return g.join(F.broadcast(m), "y", "left").select("entity", "y", F.round(S.safe_div(F.col("g"), F.col("m")), 3).alias("ratio"))


@query("agg_holdings", """+ p as (select month, entity, row_number() over (partition by month order by ret desc, entity) as k from panel where ret > 0), c as (select month, least(count(*), 10) as n from p where k <= 10 group by month) select n, count(*) as months from c group by n""")
def holdings(spark, d):
    t = T.long_only(panel(spark, d), ["month"], "ret", 10, ["entity"])
    return t.groupBy("month").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("months"))


@query("agg_concat", "select n_regionkey as region, string_agg(n_name, ' ' order by n_nationkey) as names, arg_min(n_name, n_nationkey) as first_name from nation where length(n_name) > 0 group by 1")
def concat(spark, d):
    n = read(spark, d, "nation").where("length(n_name) > 0")
    return n.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), " ").alias("names"), F.min_by("n_name", "n_nationkey").alias("first_name"))


@query("agg_newey_west", """+ r as (select month, avg(ret) as y, row_number() over (order by month) as i from panel where ret is not null group by month), c as (select i, y - (select avg(y) from r) as e from r),
 g as (select sum(a.e * a.e) as g0, sum(a.e * b.e) as g1, sum(a.e * c2.e) as g2, sum(a.e * d.e) as g3, count(*) as n from c a left join c b on b.i = a.i - 1 left join c c2 on c2.i = a.i - 2 left join c d on d.i = a.i - 3)
 select round((select avg(y) from r) / sqrt((g0 + 2 * (0.75 * g1 + 0.5 * g2 + 0.25 * g3)) / n / n), 5) as t_stat from g""")
def newey_west(spark, d):
    """t statistic of the mean with Bartlett weights over three lags (one row a month)."""
    r = panel(spark, d).where("ret is not null").groupBy("month").agg(F.avg("ret").alias("y"))
    w = Window.orderBy("month")
    e = r.withColumn("m", F.avg("y").over(Window.partitionBy())).withColumn("e", F.col("y") - F.col("m"))
    lagged = e.withColumns({f"g{k}": F.col("e") * F.lag("e", k).over(w) for k in (1, 2, 3)})
    n = F.count(F.lit(1))
    var = (F.sum(F.col("e") * F.col("e")) + 2 * (0.75 * F.sum("g1") + 0.5 * F.sum("g2") + 0.25 * F.sum("g3"))) / n / n
    return lagged.agg(F.round(F.max("m") / F.sqrt(var), 5).alias("t_stat"))


@query("cv_expanding_windows", """+ w as (select k, date '1995-01-01' as a, date '1997-01-01' + to_years(cast(k as int)) as b, date '1998-01-01' + to_years(cast(k as int)) as c from range(0, 4) t(k))
 select cast(k as int) as window_id, count(*) filter (where month >= a and month < b) as n_train, count(*) filter (where month >= b and month < c) as n_test from panel, w group by k""")
def expanding_windows(spark, d):
    w = panel(spark, d).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = lambda y: F.add_months(F.lit(f"{y}-01-01").cast("date"), F.col("window_id") * 12)
    within = lambda a, b: F.count_if((F.col("month") >= a) & (F.col("month") < b))
    return w.groupBy("window_id").agg(within(F.lit("1995-01-01").cast("date"), at(1997)).alias("n_train"), within(at(1997), at(1998)).alias("n_test"))


@query("top_beats_probe", """+ s as (select 'corr' as method, unnest([struct_pack(f := 'px', v := abs(corr(px, ret))), struct_pack(f := 'qty', v := abs(corr(qty, ret))), struct_pack(f := 'disc', v := abs(corr(disc, ret))), struct_pack(f := 'probe', v := abs(corr(tax, ret)))]) as x from panel
 union all select 'var', unnest([struct_pack(f := 'px', v := stddev_samp(px) / avg(px)), struct_pack(f := 'qty', v := stddev_samp(qty) / avg(qty)), struct_pack(f := 'disc', v := stddev_samp(disc) / avg(disc)), struct_pack(f := 'probe', v := stddev_samp(tax) / avg(tax))]) from panel),
 t as (select method, x.f as feature, x.v as score, x.v / sum(x.v) over (partition by method) as share, max(case when x.f = 'probe' then x.v end) over (partition by method) as p from s)
 select feature, round(avg(share), 6) as mean_share from t where feature in (select feature from t where score > p) group by feature""")
def beats_probe(spark, d):
    cols = {"px": "px", "qty": "qty", "disc": "disc", "probe": "tax"}
    p = panel(spark, d)
    a = p.agg(*[F.abs(F.corr(c, "ret")).alias(k) for k, c in cols.items()]).withColumn("method", F.lit("corr"))
    b = p.agg(*[(F.stddev_samp(c) / F.avg(c)).alias(k) for k, c in cols.items()]).withColumn("method", F.lit("var"))
    scores = a.unionByName(b).unpivot(["method"], list(cols), "feature", "score")
    return T.beats_probe(scores, "probe", 100).select("feature", *rounded("mean_share"))


@query("lbl_daily_volatility", """+ t as (select * from ticks where price > 0), q as (select k, ts, price, ts - interval 1 day as due from t),
 r as (select q.k, q.ts, q.price / b.price - 1 as r, row_number() over (partition by q.k order by q.ts) as i from q asof join t b on q.k = b.k and q.due > b.ts),
 w as (select a.k, a.ts, pow(1 - 2.0 / 101, a.i - b.i) as u, b.r as x from r a join r b on a.k = b.k and b.i <= a.i), m as (select k, ts, sum(u) as s1, sum(u * u) as s2, sum(u * x) / sum(u) as mean from w group by 1, 2)
 select k, ts, round(case when count(*) > 1 then sqrt(sum(u * (x - mean) * (x - mean)) * any_value(s1) / (any_value(s1) * any_value(s1) - any_value(s2))) end, 6) as ewm_std from w join m using (k, ts) group by 1, 2""", TICKS_SQL)
def daily_volatility(spark, d):
    """Return against the last price more than a day before, and its exponentially weighted deviation."""
    t = ticks(spark, d).where("price > 0")
    q = t.select("k", "ts", "price", (F.col("ts") - F.expr("interval 1 day")).alias("due"))
    r = J.as_of(q, t.select("k", "ts", F.col("price").alias("before")), ["k"], "due", "ts", ["before"], strict=True).where("before is not null")
    return W.ewm(r.select("k", "ts", (F.col("price") / F.col("before") - 1).alias("r")), ["k"], "ts", "r", 100).select("k", "ts", *rounded("ewm_std"))


@query("wgt_return_attribution", """+ c as (select t.k, t.ts, t.price, count(e.id) as n, coalesce(t.price - lag(t.price) over (partition by t.k order by t.ts), 0) as r from ticks t left join ev e on e.k = t.k and t.ts between e.t0 and e.t1 group by t.k, t.ts, t.price)
 select e.id, round(abs(sum(c.r / c.n)), 6) as weight from ev e join c on e.k = c.k and c.ts between e.t0 and e.t1 group by e.id""", EVENTS_SQL)
def return_attribution(spark, d):
    """|sum of change / concurrency| over each event's span, from running sums at its ends."""
    e, t = events(spark, d), ticks(spark, d)
    order = Window.partitionBy("k").orderBy("ts")
    t = t.withColumn("r", F.coalesce(F.col("price") - F.lag("price").over(order), F.lit(0.0)))
    seen = t.join(J.concurrency(e, t, ["k"], "t0", "t1", "ts"), ["k", "ts"])
    run = seen.withColumn("s", F.sum(F.when(F.col("n_active") > 0, F.col("r") / F.col("n_active")).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("k", "ts", "s")
    end = J.as_of(e, run.withColumnRenamed("s", "s1"), ["k"], "t1", "ts", ["s1"])
    both = J.as_of(end, run.withColumnRenamed("s", "s0"), ["k"], "t0", "ts", ["s0"], strict=True)
    return both.select("id", F.round(F.abs(F.col("s1") - F.coalesce("s0", F.lit(0.0))), 6).alias("weight"))


@query("lbl_zero_at_barrier", """select e.id, case when p.ts - e.t1 < interval 1 hour then 0 else cast(sign(p.price / e.p0 - 1) as int) end as bin from ev e asof join ticks p on e.k = p.k and e.t1 <= p.ts where e.p0 > 0""", EVENTS_SQL)
def zero_at_barrier(spark, d):
    """0 for events that end at the barrier itself (a bar within the hour), else the sign of the outcome."""
    e = events(spark, d).where("p0 > 0").withColumn("end", F.col("t1"))
    t = ticks(spark, d).withColumn("seen", F.col("ts"))
    out = J.as_of(e, t.select("k", "ts", "seen", F.col("price").alias("p1")), ["k"], "end", "ts", ["seen", "p1"], "forward").where("p1 is not null")
    return out.select("id", F.when(F.col("seen") - F.col("t1") < F.expr("interval 1 hour"), 0).otherwise(F.signum(F.col("p1") / F.col("p0") - 1)).cast("int").alias("bin"))


@query("cv_purged_train", """+ o as (select event_id as id, ts as t0, ts + interval 6 hour as t1, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from ticks),
 f as (select *, case when i < (n % 5) * (n // 5 + 1) then i // (n // 5 + 1) else n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) end as fold from o), b as (select fold, min(t0) as lo, max(t1) as hi from f group by fold)
 select cast(b.fold as int) as fold, count(*) as n_train from f, b where f.fold <> b.fold and (f.t1 < b.lo or f.t0 > b.hi) group by b.fold""", TICKS_SQL)
def purged_train(spark, d):
    """Training rows left per fold once those that overlap the fold's span are purged."""
    t = L.folds(ticks(spark, d).select("event_id", "ts"), ["ts", "event_id"], 5, "own").select("own", F.col("ts").alias("t0"), (F.col("ts") + F.expr("interval 6 hours")).alias("t1"))
    span = t.groupBy(F.col("own").alias("fold")).agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    both = t.join(F.broadcast(span), (F.col("own") != F.col("fold")) & ((F.col("t1") < F.col("lo")) | (F.col("t0") > F.col("hi"))))
    return both.groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"))
