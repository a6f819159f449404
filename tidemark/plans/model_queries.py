"""Queries that need numeric kernels or MLlib: unit roots, portfolios, state models, importance. Checked by tests, not SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import numeric as N
from ..operators import pairs as P
from ..operators import selection as T
from ..operators import windows as W
from ..operators.lineage import durable
from .registry import market, panel, query, ticks

FEATURES = ["px", "qty", "disc", "tax"]


def per_entity(spark, d):
    return panel(spark, d).where("ret is not null").select("entity", "month", "px", "ret")


@query("sta_adf")
def adf(spark, d):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.log(g.sort_values("month")["px"].to_numpy())
        return pd.DataFrame({"entity": [g["entity"].iloc[0]], "statistic": [N.adf_statistic(x)], "least_d": [N.least_difference(x)]})

    return per_entity(spark, d).groupBy("entity").applyInPandas(run, "entity long, statistic double, least_d double")


@query("sta_sup_adf")
def sup_adf(spark, d):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("month")
        return pd.DataFrame({"entity": g["entity"], "month": g["month"], "sadf": N.sup_adf(np.log(g["px"].to_numpy()))})

    return per_entity(spark, d).groupBy("entity").applyInPandas(run, "entity long, month date, sadf double")


@query("sta_expanding_frac_diff")
def expanding(spark, d):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("month")
        return pd.DataFrame({"entity": g["entity"], "month": g["month"], "fd": N.expanding_frac_diff(np.log(g["px"].to_numpy()), 0.4)})

    return per_entity(spark, d).groupBy("entity").applyInPandas(run, "entity long, month date, fd double")


@query("sta_market_states")
def market_states(spark, d):
    """States of a hidden Markov model on the rolling deviation of the market return (one row a month, one group)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("month")
        return pd.DataFrame({"month": g["month"], "state": N.gaussian_states(g["vol"].to_numpy())})

    m = market(spark, d).where("mret is not null").select(F.lit(1).alias("one"), F.col("month").cast("timestamp").alias("month"), "mret")
    vol = W.ewm(m, ["one"], "month", "mret", 12).where("ewm_std is not null").select("one", F.col("month").cast("date").alias("month"), F.col("ewm_std").alias("vol"))
    return vol.groupBy("one").applyInPandas(run, "month date, state int")


@query("sta_principal_components")
def principal_components(spark, d):
    """Standardised features on as many components as explain 85 % of the variance."""
    p = panel(spark, d).select("entity", "month", *FEATURES)
    x = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(p)
    x = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(x).transform(x)
    model = PCA(k=len(FEATURES), inputCol="x", outputCol="pc").fit(x)
    keep = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), 0.85) + 1)
    pc = vector_to_array(F.col("pc"))
    return model.transform(x).select("entity", "month", *[pc[i].alias(f"pc{i}") for i in range(keep)])


@query("sta_loadings_top")
def loadings_top(spark, d):
    x = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(panel(spark, d))
    x = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(x).transform(x)
    model = PCA(k=len(FEATURES), inputCol="x", outputCol="pc").fit(x)
    load = np.abs(model.pc.toArray()) @ model.explainedVariance.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, load, strict=True)], "feature string, loading double").orderBy(F.desc("loading"), "feature").limit(3)


@query("sta_covariance", """select a.entity, b.entity as other, round(covar_samp(a.ret, b.ret), 9) + 0.0 as cov, case when count(*) > 1 then round(corr(a.ret, b.ret), 6) + 0.0 end as corr
 from panel a join panel b on a.month = b.month and a.entity <= b.entity where a.ret is not null and b.ret is not null group by 1, 2""")
def covariance(spark, d):
    """Long-form covariance of monthly returns, a block of entities against another."""
    c = P.covariance(per_entity(spark, d), "entity", "month", "ret")
    return c.select("entity", "other", (F.round("cov", 9) + 0.0).alias("cov"), (F.round("corr", 6) + 0.0).alias("corr"))


def _rebalance(spark, d):
    """Per month, each one a rebalance, the selected entities with their last 24 returns."""
    w = Window.partitionBy("entity").orderBy("month").rowsBetween(-24, -1)
    past = panel(spark, d).where("ret is not null").withColumns({"past": F.collect_list("ret").over(w), "cap": F.col("qty")})
    ready = past.where("size(past) = 24")
    return T.top_k(ready, ["month"], F.col("ret"), 20, ["entity"]).select("month", "entity", "past", "ret", "cap")


def _weights(how):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("entity")
        x = np.stack(g["past"].to_numpy()).T
        return pd.DataFrame({"month": g["month"], "entity": g["entity"], "weight": how(x, g)})

    return run


def _portfolio(name, how):
    @query(name)
    def made(spark, d):
        return _rebalance(spark, d).groupBy("month").applyInPandas(_weights(how), "month date, entity long, weight double")

    return made


def _posterior(x, g):
    cov = N.psd_repair(N.ledoit_wolf(x))
    cap = g["cap"].to_numpy() / g["cap"].sum()
    return N.black_litterman(cov, cap, np.tanh(g["ret"].to_numpy()), x.mean(0))


_portfolio("pf_hrp", lambda x, g: N.hrp_weights(N.ledoit_wolf(x)))
_portfolio("pf_hrp_sharpe", lambda x, g: N.hrp_weights(N.ledoit_wolf(x), N.ewm_moments(x, 12)[0]))
_portfolio("pf_black_litterman_hrp", lambda x, g: N.hrp_weights(N.ledoit_wolf(x), _posterior(x, g)[0]))
_portfolio("pf_min_variance_capped", lambda x, g: N.capped_min_variance(N.ledoit_wolf(x), 0.1))
_portfolio("pf_ewm_covariance_hrp", lambda x, g: N.hrp_weights(N.psd_repair(N.ewm_moments(x, 12)[1]) + 1e-8 * np.eye(x.shape[1])))


@query("pf_backtest")
def backtest(spark, d):
    """Weights of each month multiplied with its returns; a month without weights keeps those before it."""
    w = _rebalance(spark, d).groupBy("month").applyInPandas(_weights(lambda x, g: N.hrp_weights(N.ledoit_wolf(x))), "month date, entity long, weight double")
    w = w.withColumnRenamed("month", "since")
    r = panel(spark, d).select("entity", "month", "ret")
    since = r.select("month").distinct().join(F.broadcast(w.select("since").distinct()), F.col("since") <= F.col("month")).groupBy("month").agg(F.max("since").alias("since"))
    held = w.join(since, "since").select("entity", "weight", "month")
    return held.join(r, ["entity", "month"]).groupBy("month").agg(F.sum(F.coalesce(F.col("weight") * F.col("ret"), F.lit(0.0))).alias("portfolio"))


def _rows(spark, d):
    """Features, a probe dealt by arithmetic (the same in every pass) and whether the next return is up."""
    w = Window.partitionBy("entity").orderBy("month")
    p = panel(spark, d).withColumn("y", F.when(F.lead("ret").over(w) >= 0, 1).otherwise(0)).where("ret is not null")
    probe = (F.col("entity") * 7919 + (F.year("month") * 12 + F.month("month")) * 10473) % 1009 / 1009.0
    return p.select("entity", "month", "y", *FEATURES, probe.alias("probe"))


def _set(spark, d):
    """The rows with their vectors, written once: fitting passes over them many times."""
    return durable(VectorAssembler(inputCols=[*FEATURES, "probe"], outputCol="features").transform(_rows(spark, d)))


def _forest():
    return RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=20, maxDepth=4, impurity="entropy", seed=42)


@query("ml_predictions")
def predictions(spark, d):
    """Class and probability from a forest trained before a date and applied after it."""
    s = _set(spark, d)
    model = _forest().fit(s.where("month < date'1999-01-01'"))
    p = vector_to_array("probability")
    return model.transform(s.where("month >= date'1999-01-01'")).select("entity", "month", F.col("prediction").cast("int").alias("prediction"), F.array_max(p).alias("probability"))


@query("ml_impurity_importance")
def impurity_importance(spark, d):
    """Mean over trees of each feature's importance (0 counts as missing), over the sum of means."""
    model = _forest().fit(_set(spark, d))
    rows = [(t, f, float(v)) for t, tree in enumerate(model.trees) for f, v in zip([*FEATURES, "probe"], tree.featureImportances.toArray(), strict=True) if v > 0]
    each = spark.createDataFrame(rows, "tree int, feature string, v double").groupBy("feature").agg(F.avg("v").alias("m"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("e"))
    total = F.sum("m").over(Window.partitionBy())
    return each.select("feature", (F.col("m") / total).alias("importance"), (F.col("e") / total).alias("error"))


@query("ml_permutation_importance")
def permutation_importance(spark, d):
    """Loss of accuracy when one column is dealt anew among the test rows."""
    s = _set(spark, d).drop("features").withColumn("i", F.row_number().over(Window.partitionBy("month").orderBy("entity")))
    cols = [*FEATURES, "probe"]
    assemble = VectorAssembler(inputCols=cols, outputCol="features")
    model = _forest().fit(assemble.transform(s.where("month < date'1999-01-01'")))
    test = s.where("month >= date'1999-01-01'")
    rate = lambda t, f: model.transform(assemble.transform(t)).agg(F.lit(f).alias("feature"), F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"))
    out = rate(test, "")
    for c in cols:
        dealt = test.select("month", F.col(c).alias("__c"), F.row_number().over(Window.partitionBy("month").orderBy(F.xxhash64("entity", F.lit(c)))).alias("i"))
        out = out.union(rate(test.join(dealt, ["month", "i"]).withColumn(c, F.col("__c")).drop("__c"), c))
    base = F.max(F.when(F.col("feature") == "", F.col("accuracy"))).over(Window.partitionBy())
    return out.withColumn("drop", base - F.col("accuracy")).where("feature <> ''").select("feature", "drop")


@query("ml_linear_models")
def linear_models(spark, d):
    """Ridge, lasso and elastic net without intercept on centred targets; out-of-sample R² against zero."""
    w = Window.partitionBy("entity").orderBy("month")
    p = panel(spark, d).withColumn("t", F.lead("ret").over(w)).where("t is not null and ret is not null")
    s = durable(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(p).select("month", "t", "features"))  # written once: each fit passes over it
    train, test = s.where("month < date'1999-01-01'"), s.where("month >= date'1999-01-01'")
    centre = train.agg(F.avg("t")).first()[0] or 0.0
    train = train.withColumn("label", F.col("t") - centre)
    scores = []
    for name, mix in (("ridge", 0.0), ("lasso", 1.0), ("elastic_net", 0.5)):
        model = LinearRegression(fitIntercept=False, regParam=0.01, elasticNetParam=mix, standardization=False, predictionCol=name).fit(train)
        test = model.transform(test)
        e = F.col("t") - F.col(name) - centre
        scores.append(F.struct(F.lit(name).alias("model"), (1 - F.sum(e * e) / F.sum(F.col("t") * F.col("t"))).alias("oos_r2")))
    return test.agg(F.array(*scores).alias("s")).select(F.explode("s").alias("s")).select("s.*")


_MOMENTS = " union all ".join(f"select '{c}' as feature, round(avg({c}), 6) as mean, round(var_samp({c}), 6) as variance from s" for c in [*FEATURES, "probe"])


@query("ml_feature_moments", "+ s as (select *, ((entity * 7919 + (year(month) * 12 + month(month)) * 10473) % 1009) / 1009.0 as probe from panel where ret is not null) " + _MOMENTS)
def feature_moments(spark, d):
    """Mean and variance of each feature and of the probe, in one pass."""
    s = _rows(spark, d)
    names = [*FEATURES, "probe"]
    both = s.agg(*[F.struct(F.round(F.avg(c), 6).alias("mean"), F.round(F.var_samp(c), 6).alias("variance")).alias(c) for c in names])
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean"), F.col(f"{c}.variance")) for c in names])).alias("r")).select("r.*")


@query("wgt_sequential_bootstrap")
def sequential(spark, d):
    """Per key, draws of all its events, spans of 36 hours, in proportion to their uniqueness."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts", "event_id"])
        ids, ts = g["event_id"].tolist(), g["ts"].to_numpy()
        ends = ts.searchsorted(ts + pd.Timedelta(hours=36).to_timedelta64(), side="right") - 1
        spans = list(zip(range(len(ids)), ends.tolist(), strict=True))
        return pd.DataFrame({"k": g["k"].iloc[0], "event_id": [ids[i] for i in N.sequential_bootstrap(spans, len(ids), seed=int(g["k"].iloc[0]))]})

    return ticks(spark, d).select("k", "event_id", "ts").groupBy("k").applyInPandas(run, "k long, event_id long")
