"""Queries over ticks: as-of and range joins, bars, event filters, labels, weights, text sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators import joins as J
from ..operators import labels as L
from ..operators import pairs as P
from .registry import PANEL_SQL, TICKS_SQL, panel, query, read, ticks

EVENTS_SQL = TICKS_SQL.rstrip() + ",\n ev as (select event_id as id, k, ts as t0, ts + interval 36 hour as t1, price as p0, 0.5 as trgt, 1 as side from ticks)"


def events(spark, d):
    t = ticks(spark, d)
    return t.select(F.col("event_id").alias("id"), "k", F.col("ts").alias("t0"), (F.col("ts") + F.expr("interval 36 hours")).alias("t1"), F.col("price").alias("p0"), F.lit(0.5).alias("trgt"), F.lit(1).alias("side"))


@query("jn_as_of_backward", "+ q as (select event_id, k, ts - interval 1 day as t from ticks) select q.event_id, p.price from q asof left join ticks p on q.k = p.k and q.t > p.ts", TICKS_SQL)
def as_of_backward(spark, d):
    t = ticks(spark, d)
    q = t.select("event_id", "k", (F.col("ts") - F.expr("interval 1 day")).alias("t"))
    return J.as_of(q, t.select("k", "ts", "price"), ["k"], "t", "ts", ["price"], strict=True).select("event_id", "price")


@query("jn_as_of_forward", "+ q as (select event_id, k, ts + interval 1 day as t from ticks) select q.event_id, p.price from q asof join ticks p on q.k = p.k and q.t <= p.ts", TICKS_SQL)
def as_of_forward(spark, d):
    t = ticks(spark, d)
    q = t.select("event_id", "k", (F.col("ts") + F.expr("interval 1 day")).alias("t"))
    return J.as_of(q, t.select("k", "ts", "price"), ["k"], "t", "ts", ["price"], "forward").where("price is not null").select("event_id", "price")


@query("jn_range", "select e.id, count(*) as n, max(p.price) as high from ev e join ticks p on e.k = p.k and p.ts between e.t0 and e.t1 group by e.id", EVENTS_SQL)
def in_range(spark, d):
    return J.in_range(events(spark, d), ticks(spark, d).select("k", "ts", "price"), ["k"], "t0", "t1", "ts").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high"))


@query("wgt_concurrency", "select t.event_id, count(e.id) as n_active from ticks t left join ev e on e.k = t.k and t.ts between e.t0 and e.t1 group by t.event_id", EVENTS_SQL)
def concurrency(spark, d):
    t = ticks(spark, d)
    c = J.concurrency(events(spark, d), t, ["k"], "t0", "t1", "ts")
    return t.join(c, ["k", "ts"]).select("event_id", F.col("n_active").cast("long").alias("n_active"))


@query("wgt_uniqueness", """+ c as (select t.k, t.ts, count(e.id) as n from ticks t join ev e on e.k = t.k and t.ts between e.t0 and e.t1 group by 1, 2)
 select e.id, round(avg(1.0 / c.n), 6) as uniqueness from ev e join c on e.k = c.k and c.ts between e.t0 and e.t1 group by e.id""", EVENTS_SQL)
def uniqueness(spark, d):
    return L.uniqueness(events(spark, d), ticks(spark, d), ["k"]).select("id", F.round("uniqueness", 6).alias("uniqueness"))


@query("jn_active_mean", "select t.event_id, round(coalesce(avg(e.p0), 0), 6) as active from ticks t left join ev e on e.k = t.k and e.t0 <= t.ts and t.ts < e.t1 group by t.event_id", EVENTS_SQL)
def active_mean(spark, d):
    """Mean of the open events' values: running sums over starts and ends."""
    e, t = events(spark, d), ticks(spark, d)
    up = e.select("k", F.col("t0").alias("ts"), F.col("p0").alias("v"), F.lit(1).alias("c"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("event_id"))
    down = e.select("k", F.col("t1").alias("ts"), (-F.col("p0")).alias("v"), F.lit(-1).alias("c"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("event_id"))
    here = t.select("k", "ts", F.lit(0.0).alias("v"), F.lit(0).alias("c"), F.lit(1).alias("o"), "event_id")
    w = Window.partitionBy("k").orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    s = up.unionByName(down).unionByName(here).withColumns({"s": F.sum("v").over(w), "n": F.sum("c").over(w)}).where("o = 1")
    return s.select("event_id", F.round(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0), 6).alias("active"))


@query("lbl_vertical_barrier", "select e.id, p.ts as t1 from (select *, t0 + interval 2 day as due from ev) e asof join ticks p on e.k = p.k and e.due <= p.ts", EVENTS_SQL)
def vertical_barrier(spark, d):
    return L.vertical_barrier(events(spark, d).drop("t1"), ticks(spark, d), ["k"], 2).select("id", "t1")


@query("lbl_triple_barrier", """+ m as (select e.id, p.ts, p.price / e.p0 - 1 as r from ev e join ticks p on e.k = p.k and p.ts between e.t0 and e.t1 where e.p0 > 0),
 f as (select id, min(ts) filter (where r < -1.0 * 0.5) as sl, min(ts) filter (where r > 2.0 * 0.5) as pt from m group by id)
 select e.id, least(e.t1, sl, pt) as t_end, case when pt is not null and (sl is null or pt < sl) then 1 when sl is not null then -1 else 0 end as first_touch from ev e left join f using (id) where e.p0 > 0""", EVENTS_SQL)
def triple_barrier(spark, d):
    return L.triple_barrier(events(spark, d).where("p0 > 0"), ticks(spark, d), ["k"], 2.0, 1.0).select("id", F.col("end").alias("t_end"), "first_touch")


@query("lbl_outcome", "select e.id, round(p.price / e.p0 - 1, 6) as ret, cast(sign(p.price / e.p0 - 1) as int) as bin from ev e asof join ticks p on e.k = p.k and e.t1 <= p.ts where e.p0 > 0", EVENTS_SQL)
def outcome(spark, d):
    e = events(spark, d).where("p0 > 0").withColumn("end", F.col("t1"))
    return L.outcome(e, ticks(spark, d), ["k"]).select("id", F.round("ret", 6).alias("ret"), "bin")


_OHLC = "min(ts) as time_open, max(ts) as time_close, arg_min(round(price * 100), ts) as open, min(round(price * 100)) as low, max(round(price * 100)) as high, arg_max(round(price * 100), ts) as close, sum(round(price * 100) * size) / nullif(sum(size), 0) as vwap, cast(sum(size) as bigint) as volume"


def _bars(df, keys):
    """Bars with prices in whole cents, so that sums don't depend on the order of rows."""
    return B.ohlcv(df.withColumn("price", F.round(F.col("price") * 100, 0)), keys)


@query("bar_time", f"select k, cast(date_trunc('day', ts) as date) as day, {_OHLC} from ticks group by 1, 2", TICKS_SQL)
def bar_time(spark, d):
    return _bars(ticks(spark, d).withColumn("day", F.to_date("ts")), ["k", "day"])


@query("bar_tick", f"select k, bar, {_OHLC} from (select *, cast(floor((row_number() over (partition by k order by ts) - 1) / 10.0) as bigint) as bar from ticks) group by 1, 2", TICKS_SQL)
def bar_tick(spark, d):
    return _bars(ticks(spark, d).withColumn("bar", B.bar_id("tick", ["k"], 10)), ["k", "bar"])


@query("bar_volume", f"select k, bar, {_OHLC} from (select *, cast(floor(sum(size) over (partition by k order by ts rows unbounded preceding) / 500.0) as bigint) as bar from ticks) group by 1, 2", TICKS_SQL)
def bar_volume(spark, d):
    return _bars(ticks(spark, d).withColumn("bar", B.bar_id("volume", ["k"], 500)), ["k", "bar"])


@query("bar_dollar", f"select k, bar, {_OHLC} from (select *, cast(floor(sum(price * size) over (partition by k order by ts rows unbounded preceding) / 9000.0) as bigint) as bar from ticks) group by 1, 2", TICKS_SQL)
def bar_dollar(spark, d):
    return _bars(ticks(spark, d).withColumn("bar", B.bar_id("dollar", ["k"], 9000)), ["k", "bar"])


@query("bar_tick_sign", "select event_id, cast(coalesce(sign(price - lag(price) over (partition by k order by ts)), 0) as int) as b from ticks", TICKS_SQL)
def tick_sign(spark, d):
    return ticks(spark, d).select("event_id", B.tick_sign("price", Window.partitionBy("k").orderBy("ts")).alias("b"))


@query("bar_vwap_rows", "select event_id, round(sum(price * size) over (partition by k, cast(ts as date)) / nullif(sum(size) over (partition by k, cast(ts as date)), 0), 9) as vwap from ticks", TICKS_SQL)
def vwap_rows(spark, d):
    w = Window.partitionBy("k", F.to_date("ts"))
    return ticks(spark, d).select("event_id", F.round(F.try_divide(F.sum(F.col("price") * F.col("size")).over(w), F.sum("size").over(w)), 9).alias("vwap"))


@query("bar_weekly_count", "select cast(date_trunc('week', ts) + interval 6 day as date) as week_end, count(distinct k) as n from ticks group by 1", TICKS_SQL)
def weekly_count(spark, d):
    return ticks(spark, d).groupBy(F.date_add(F.to_date(F.date_trunc("week", "ts")), 6).alias("week_end")).agg(F.count_distinct("k").alias("n"))


@query("bar_resample_last", "select k, cast(date_trunc('week', ts) as date) as week, arg_max(price, ts) as last from ticks group by 1, 2", TICKS_SQL)
def resample_last(spark, d):
    return ticks(spark, d).groupBy("k", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.max_by("price", "ts").alias("last"))


_RESET = """+ recursive o as (select k, ts, size as x, row_number() over (partition by k order by ts, size) as i from ticks),
 s(k, i, ts, a, hit) as (select k, i, ts, case when x >= 400 then 0 else x end, x >= 400 from o where i = 1
 union all select o.k, o.i, o.ts, case when s.a + o.x >= 400 then 0 else s.a + o.x end, s.a + o.x >= 400 from s join o on o.k = s.k and o.i = s.i + 1)
 select k, ts as time_close from s where hit"""


@query("bar_reset", _RESET, TICKS_SQL)
def bar_reset(spark, d):
    return B.reset_bars(ticks(spark, d), ["k"], "size", 400)


_CUSUM = """ o as (select k, ts, d, h, row_number() over (partition by k order by ts) as i from c where d is not null),
 s(k, i, ts, p, n, hit) as (select k, i, ts, case when least(0.0, d) >= -h and greatest(0.0, d) > h then 0.0 else greatest(0.0, d) end, case when least(0.0, d) < -h then 0.0 else least(0.0, d) end, least(0.0, d) < -h or greatest(0.0, d) > h from o where i = 1
 union all select o.k, o.i, o.ts, case when least(0.0, s.n + o.d) >= -o.h and greatest(0.0, s.p + o.d) > o.h then 0.0 else greatest(0.0, s.p + o.d) end, case when least(0.0, s.n + o.d) < -o.h then 0.0 else least(0.0, s.n + o.d) end,
 least(0.0, s.n + o.d) < -o.h or greatest(0.0, s.p + o.d) > o.h from s join o on o.k = s.k and o.i = s.i + 1)
 select k, ts as event_time from s where hit"""


@query("evt_cusum", "+ recursive c as (select k, ts, price - lag(price) over (partition by k order by ts) as d, cast(15 as double) as h from ticks)," + _CUSUM, TICKS_SQL)
def cusum(spark, d):
    w = Window.partitionBy("k").orderBy("ts")
    t = ticks(spark, d).withColumns({"d": F.col("price") - F.lag("price").over(w), "h": F.lit(15.0)})
    return B.cusum(t, ["k"], "d", "h")


@query("evt_cusum_log_threshold", "+ recursive l as (select k, ts, ln(price) - ln(lag(price) over (partition by k order by ts)) as d from ticks where price > 0), c as (select k, ts, d, coalesce(stddev_samp(d) over (partition by k order by ts rows between 19 preceding and current row), 1.0) as h from l)," + _CUSUM, TICKS_SQL)
def cusum_log(spark, d):
    """Log changes against a per-row threshold, the rolling deviation."""
    w = Window.partitionBy("k").orderBy("ts")
    t = ticks(spark, d).where("price > 0").withColumn("d", F.log("price") - F.log(F.lag("price").over(w)))
    return B.cusum(t.withColumn("h", F.coalesce(F.stddev_samp("d").over(w.rowsBetween(-19, 0)), F.lit(1.0))), ["k"], "d", "h")


_IMBALANCE = """+ recursive o as (select k, ts, cast(coalesce(sign(price - lag(price) over (partition by k order by ts)), 0) * {amount} as double) as x, row_number() over (partition by k order by ts) as i from ticks),
 s(k, i, ts, opened, theta, cnt, length, mean, hit) as (select k, i, ts, ts, x, 1, cast(0 as double), cast(0 as double), abs(x) >= {first} from o where i = 1
 union all select k, i, ts, opened, theta, cnt, length, mean, abs(theta) >= greatest(length * abs(mean), {first}) from
 (select o.k, o.i, o.ts, case when s.hit then o.ts else s.opened end as opened, case when s.hit then o.x else s.theta + o.x end as theta, case when s.hit then 1 else s.cnt + 1 end as cnt,
 case when not s.hit then s.length when s.length = 0 then s.cnt else s.cnt / 3.0 + (1 - 1 / 3.0) * s.length end as length,
 case when not s.hit then s.mean when s.length = 0 then s.theta / s.cnt else s.theta / s.cnt / 3.0 + (1 - 1 / 3.0) * s.mean end as mean from s join o on o.k = s.k and o.i = s.i + 1))
 select k, opened as time_open, ts as time_close, cast(cnt as bigint) as n_ticks, round(theta, 6) as theta from s where hit"""


@query("bar_imbalance_tick", _IMBALANCE.format(amount="1", first="3.0"), TICKS_SQL)
def imbalance_tick(spark, d):
    return B.imbalance_bars(ticks(spark, d), ["k"], "tick", first=3.0).withColumn("theta", F.round("theta", 6))


@query("bar_imbalance_volume", _IMBALANCE.format(amount="size", first="150.0"), TICKS_SQL)
def imbalance_volume(spark, d):
    return B.imbalance_bars(ticks(spark, d), ["k"], "volume", first=150.0).withColumn("theta", F.round("theta", 6))


@query("cv_folds", """+ o as (select event_id, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from ticks)
 select event_id, cast(case when i < (n % 7) * (n // 7 + 1) then i // (n // 7 + 1) else n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) end as int) as fold from o""", TICKS_SQL)
def cv_folds(spark, d):
    return L.folds(ticks(spark, d).select("event_id", "ts"), ["ts", "event_id"], 7).select("event_id", "fold")


@query("cv_embargo", "select event_id, lead(ts, 3, max_ts) over (order by ts, event_id) as until from (select *, max(ts) over () as max_ts from ticks)", TICKS_SQL)
def cv_embargo(spark, d):
    return L.embargo(ticks(spark, d).select("event_id", "ts"), ["ts", "event_id"], 3, "ts").select("event_id", "until")


@query("pf_bet_size", f"""+ p as (select event_id, price, greatest(0.005, least(0.995, 0.5 + size / 200)) as p from ticks), z as (select event_id, case when price > 10 then 1 else -1 end as side, (p - 0.5) / sqrt(p * (1 - p)) as z from p)
 select event_id, round(greatest(-1.0, least(1.0, round(side * (2 * {S.normal_cdf_sql("z")} - 1) / 0.1) * 0.1)), 6) + 0.0 as bet from z""", TICKS_SQL)
def bet_size(spark, d):
    """Every tick; a probability is kept within 0.005 of 0 and 1, where the size has no limit."""
    t = ticks(spark, d)
    p = F.greatest(F.lit(0.005), F.least(F.lit(0.995), 0.5 + F.col("size") / 200))
    return t.select("event_id", S.discretise(S.bet_size(p, F.when(F.col("price") > 10, 1).otherwise(-1)), 0.1).alias("bet")).withColumn("bet", F.round("bet", 6) + 0.0)


@query("pf_position_size", "select event_id, round((price - 10) / sqrt(4 + (price - 10) * (price - 10)), 6) as position, cast(floor(round((price - 10) / sqrt(4 + (price - 10) * (price - 10)), 6) * 100) as bigint) as units from ticks", TICKS_SQL)
def position_size(spark, d):
    x = F.round(S.position_size(F.col("price") - 10, F.lit(4.0)), 6)
    return ticks(spark, d).select("event_id", x.alias("position"), F.floor(x * 100).alias("units"))


@query("txt_clean", r"""select item_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '[!-/:-@\[-`{-~]', '', 'g')), '\s+', ' ', 'g')) as cleaned from benchmark""", "b0 as (select 1)")
def txt_clean(spark, d):
    return read(spark, d, "benchmark").select("item_id", S.clean_text(F.col("text")).alias("cleaned"))


@query("txt_first_group", r"select page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) as lang, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages", "b0 as (select 1)")
def txt_first_group(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("txt_sections", r"""+ s as (select page_id, regexp_extract_all(html, '(<p>[^<]*)</p>', 1) as s from pages) select page_id, array_to_string(s, ' ') as joined, len(s) as n,
 list_sort(list_transform(s, lambda x: length(x)), 'desc')[1] as longest from s""", "b0 as (select 1)")
def txt_sections(spark, d):
    s = read(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit("(<p>[^<]*)</p>"), F.lit(1)).alias("s"))
    return s.select("page_id", F.array_join("s", " ").alias("joined"), F.size("s").cast("long").alias("n"), F.length(S.longest(F.col("s"))).cast("long").alias("longest"))


@query("txt_scores", "select event_id, greatest(0.0, least(1.0, price / 20.0)) as score from ticks", TICKS_SQL)
def txt_scores(spark, d):
    return ticks(spark, d).select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("price") / 20.0)).alias("score"))


@query("graph_reachable", """+ recursive c as (select a.entity as a, b.entity as b, corr(a.ret, b.ret) as c from panel a join panel b on a.month = b.month and a.entity < b.entity group by 1, 2),
 e as (select a, b from c where c > 0.15 union select b, a from c where c > 0.15), r(n) as (select cast(1 as bigint) union select e.b from r join e on e.a = r.n) select n as node from r""", PANEL_SQL)
def graph_reachable(spark, d):
    """Nodes reachable from node 1 over edges of correlation above a threshold."""
    return P.reachable(panel(spark, d), "entity", "month", "ret", 1, 0.15)


@query("graph_reachable_all")
def graph_reachable_all(spark, d):
    """The same query by the name it had when graph_reachable stopped at entity 30."""
    return P.reachable(panel(spark, d), "entity", "month", "ret", 1, 0.15)
