"""Signals, trading logs and their summaries, label shares, profiles of missing values, neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import joins as J
from ..operators import labels as L
from ..operators import neighbours as K
from ..operators import selection as T
from .registry import TICKS_SQL, panel, query, rounded, ticks
from .tick_queries import _IMBALANCE, EVENTS_SQL, events

_LOG = "g as (select entity, month, coalesce(ret * (case when qty > 500 then 0.01 else -0.005 end), 0) as pnl from panel)"


def _log(spark, d):
    return panel(spark, d).select("entity", "month", F.coalesce(F.col("ret") * F.when(F.col("qty") > 500, 0.01).otherwise(-0.005), F.lit(0.0)).alias("pnl"))


@query("prj_signal", "select entity, month, round((case when ret >= 0 then 1 else -1 end) * (0.5 + tax), 6) as signal from panel")
def signal(spark, d):
    """Prediction times probability."""
    return panel(spark, d).select("entity", "month", F.round(F.when(F.col("ret") >= 0, 1).otherwise(-1) * (0.5 + F.col("tax")), 6).alias("signal"))


@query("agg_trading_log", f"+ {_LOG} select entity, month, round(pnl, 8) as pnl from g")
def trading_log(spark, d):
    return _log(spark, d).select("entity", "month", *rounded("pnl", places=8))


@query("agg_overall", f"""+ {_LOG} select count(*) filter (where pnl > 0) as hit, count(*) filter (where pnl < 0) as miss, count(*) filter (where pnl <> 0) as total,
 round(sum(pnl) filter (where pnl > 0) / count(*) filter (where pnl > 0), 8) as avg_hit, round(sum(pnl) filter (where pnl < 0) / count(*) filter (where pnl < 0), 8) as avg_miss,
 round(sum(pnl) / count(*) filter (where pnl <> 0), 8) as avg_trade, count(*) filter (where pnl > 0) - count(*) filter (where pnl < 0) as hits_less_misses,
 round(count(*) filter (where pnl > 0) / count(*) filter (where pnl <> 0), 6) as hit_ratio from g""")
def overall(spark, d):
    """One row over all trades; averages are sums over counts."""
    p = F.col("pnl")
    hit, miss = F.count_if(p > 0), F.count_if(p < 0)
    mean = lambda which, n: F.round(F.try_divide(F.sum(F.when(which, p)), n), 8)
    return _log(spark, d).agg(
        hit.alias("hit"), miss.alias("miss"), (hit + miss).alias("total"), mean(p > 0, hit).alias("avg_hit"), mean(p < 0, miss).alias("avg_miss"), mean(p != 0, hit + miss).alias("avg_trade"),
        (hit - miss).alias("hits_less_misses"), F.round(F.try_divide(hit, hit + miss), 6).alias("hit_ratio"),
    )


@query("agg_portfolio_return", f"+ {_LOG} select month, round(sum(pnl), 6) as portfolio from g group by month")
def portfolio_return(spark, d):
    return _log(spark, d).groupBy("month").agg(F.round(F.sum("pnl"), 6).alias("portfolio"))


@query("agg_first_order", """+ l as (select entity, px as x, lag(px) over (partition by entity order by month) as y, count(px) over (partition by entity) as n from panel),
 c as (select entity, any_value(n) as n, corr(x, y) as c from l group by entity) select entity, round(c, 6) as ar1, round(c * sqrt((n - 2) / (1 - c * c)), 4) as t_stat from c""")
def first_order(spark, d):
    """Coefficient of the first lag and its t statistic."""
    w = Window.partitionBy("entity").orderBy("month")
    c = panel(spark, d).select("entity", "px", F.lag("px").over(w).alias("y")).groupBy("entity").agg(F.count("px").alias("n"), F.corr("px", "y").alias("c"))
    return c.select("entity", F.round("c", 6).alias("ar1"), F.round(F.col("c") * F.sqrt((F.col("n") - 2) / (1 - F.col("c") * F.col("c"))), 4).alias("t_stat"))


@query("agg_sample_moments", "select count(ret) as n, round(skewness(ret), 5) as skew, round(kurtosis(ret), 4) as kurtosis from panel")
def sample_moments(spark, d):
    """Skewness and excess kurtosis corrected for the sample's size."""
    s = panel(spark, d).agg(F.count("ret").alias("n"), F.skewness("ret").alias("s"), F.kurtosis("ret").alias("k"))
    n = F.col("n").cast("double")
    return s.select("n", F.round(F.sqrt(n * (n - 1)) / (n - 2) * F.col("s"), 5).alias("skew"), F.round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6), 4).alias("kurtosis"))


@query("agg_na_by", """select year(month) as year, entity, count(*) as n, count(*) filter (where gap is null) as gap_missing, count(*) filter (where ret is null) as ret_missing,
 count(distinct case when gap is null or ret is null then entity end) as entities_missing from panel group by grouping sets ((), (year(month)), (entity), (year(month), entity))""")
def na_by(spark, d):
    """Missing values in all, by year, by entity and by both, and how many entities miss any."""
    p = panel(spark, d).withColumn("year", F.year("month"))
    return p.groupingSets([[], ["year"], ["entity"], ["year", "entity"]], "year", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap").isNull()).alias("gap_missing"), F.count_if(F.col("ret").isNull()).alias("ret_missing"),
        F.count_distinct(F.when(F.col("gap").isNull() | F.col("ret").isNull(), F.col("entity"))).alias("entities_missing"),
    )


@query("agg_classification_weighted", """+ c as (select year(month) as year, qty as w, case when ret >= 0 then 1 else 0 end as y, case when disc > 0.05 then 1 else 0 end as p from panel where ret is not null),
 t as (select year, sum(w) filter (where y = p) / sum(w) as weighted, avg(cast(y = p as int)) as accuracy, count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp, count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 0 and p = 0) as tn from c group by rollup (year))
 select year, round(weighted, 6) as weighted_accuracy, round(accuracy, 6) as macro_accuracy, tp, fp, fn, tn, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1, round((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2, 6) as macro_f1 from t""")
def classification_weighted(spark, d):
    """Weighted and plain accuracy, confusion counts and F1 by year and over all years (year NULL)."""
    c = panel(spark, d).where("ret is not null").select(F.year("month").alias("year"), F.col("qty").alias("w"), (F.col("ret") >= 0).alias("y"), (F.col("disc") > 0.05).alias("p"))
    ok, both = F.col("y") == F.col("p"), lambda y, p: F.count_if((F.col("y") == y) & (F.col("p") == p))
    t = c.rollup("year").agg((F.sum(F.when(ok, F.col("w"))) / F.sum("w")).alias("weighted"), F.avg(ok.cast("int")).alias("accuracy"), both(True, True).alias("tp"), both(False, True).alias("fp"), both(True, False).alias("fn"), both(False, False).alias("tn"))
    miss = F.col("fp") + F.col("fn")
    f1 = lambda hits: F.try_divide(2.0 * F.col(hits), 2 * F.col(hits) + miss)
    return t.select("year", F.round("weighted", 6).alias("weighted_accuracy"), F.round("accuracy", 6).alias("macro_accuracy"), "tp", "fp", "fn", "tn", F.round(f1("tp"), 6).alias("f1"), F.round((f1("tp") + f1("tn")) / 2, 6).alias("macro_f1"))


@query("imp_nearest", """+ h as (select entity, month, px, qty, tax from panel where gap is null), r as (select h.entity, h.month, p.gap, row_number() over (partition by h.entity, h.month
 order by (h.px - p.px) * (h.px - p.px) + (h.qty - p.qty) * (h.qty - p.qty) + (h.tax - p.tax) * (h.tax - p.tax), p.entity) as k from h join panel p on p.month = h.month and p.gap is not null),
 f as (select entity, month, avg(gap) as v from r where k <= 5 group by 1, 2) select entity, month, round(coalesce(gap, v), 6) as filled from panel left join f using (entity, month)""")
def nearest(spark, d):
    """Holes filled from the five nearest entities of the month."""
    p = panel(spark, d).select("entity", "month", "px", "qty", "tax", "gap")
    return K.impute(p, ["month"], "entity", "gap", ["px", "qty", "tax"]).select("entity", "month", F.round("gap", 6).alias("filled"))


@query("jn_back_to_panel", """+ s as (select entity, month, ret - disc as spread from panel where ret > 0) select panel.entity, panel.month, round(spread, 6) as spread from panel left join s on s.entity = panel.entity and s.month = panel.month""")
def back_to_panel(spark, d):
    p = panel(spark, d)
    s = p.where("ret > 0").select("entity", "month", (F.col("ret") - F.col("disc")).alias("spread"))
    return p.select("entity", "month").join(s, ["entity", "month"], "left").select("entity", "month", *rounded("spread"))


@query("pf_long_short_weights", """+ r as (select month, entity, row_number() over (partition by month order by ret desc, entity) as h, row_number() over (partition by month order by ret, entity) as l from panel where ret is not null)
 select month, entity, cast(case when h <= 10 then 0.05 else -0.05 end as double) as weight from r where h <= 10 or l <= 10""")
def long_short_weights(spark, d):
    """1 / k on the ten best, -1 / k on the ten worst."""
    return T.long_short(panel(spark, d), ["month"], "ret", 20, ["entity"]).select("month", "entity", (F.col("side") / 20.0).alias("weight"))


@query("lbl_events", """+ v as (select * from ev where p0 / 20 > 0.25), m as (select e.id, e.p0, p.ts, p.price / e.p0 - 1 as r from v e join ticks p on e.k = p.k and p.ts between e.t0 and e.t1),
 f as (select id, min(ts) filter (where r < -1.5 * p0 / 20) as sl, min(ts) filter (where r > 1.5 * p0 / 20) as pt from m group by id)
 select v.id, least(v.t1, sl, pt) as t_end, case when pt is not null and (sl is null or pt < sl) then 1 when sl is not null then -1 else 0 end as first_touch from v left join f using (id)""", EVENTS_SQL)
def barrier_events(spark, d):
    """Events whose target (a twentieth of the price) exceeds a quarter, with equal barriers on both sides."""
    e = events(spark, d).withColumn("trgt", F.col("p0"))
    kept = L.barrier_events(e, ticks(spark, d), ["k"], 1.5, 1.0, 0.25, unit=20.0)
    return kept.select("id", F.col("end").alias("t_end"), "first_touch")


_KIND = "case when price < 0.5 then 'a' when price < 1 then 'b' when price < 8 then 'c' when price < 14 then 'd' else 'e' end"


@query("lbl_drop_rare", f"""+ x as (select event_id, {_KIND} as kind from ticks), c as (select kind, count(*) as c from x group by kind), s as (select kind, c, sum(c) over w as rest, count(*) over w as remain, row_number() over (order by c, kind) as i from c window w as (order by c, kind rows between current row and unbounded following)),
 g as (select kind, min(case when c / rest <= 0.05 and remain >= 3 then 1 else 0 end) over (order by i rows unbounded preceding) as gone from s) select event_id, kind from x where kind not in (select kind from g where gone = 1)""", TICKS_SQL)
def drop_rare(spark, d):
    return L.drop_rare(ticks(spark, d).select("event_id", F.expr(_KIND).alias("kind")), "kind")


@query("wgt_indicator_uniqueness", """+ c as (select e.id, t.k, t.ts from ev e join ticks t on e.k = t.k and t.ts between e.t0 and e.t1), n as (select k, ts, count(*) as n from c group by 1, 2)
 select id, round(avg(1.0 / n), 6) as uniqueness from c join n using (k, ts) group by id""", EVENTS_SQL)
def indicator_uniqueness(spark, d):
    return L.indicator_uniqueness(L.indicator(events(spark, d), ticks(spark, d), ["k"]), ["k"]).select("id", *rounded("uniqueness"))


@query("bar_imbalance_ohlc", _IMBALANCE.format(amount="1", first="3.0").replace(" select k, opened as", ", b as (select k, opened as", 1) + """) select b.k, b.time_close, arg_min(t.price, t.ts) as open, max(t.price) as high, min(t.price) as low, arg_max(t.price, t.ts) as close, count(*) as n
 from b join ticks t on t.k = b.k and t.ts between b.time_open and b.time_close group by 1, 2""", TICKS_SQL)
def imbalance_ohlc(spark, d):
    """Prices of every imbalance bar: each tick goes to the next close of its key."""
    t = ticks(spark, d).select("k", F.col("ts"), "price", "size")
    closes = B.imbalance_bars(t, ["k"], "tick", first=3.0).select("k", F.col("time_close").alias("at"), "time_close")
    own = J.as_of(t, closes, ["k"], "ts", "at", ["time_close"], "forward").where("time_close is not null")
    return own.groupBy("k", "time_close").agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).alias("n"))
