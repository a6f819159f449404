"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalog

HEADLINE = (
    "panel_composite prj_alpha_target imp_month_median jn_as_of_backward jn_range jn_purge win_ewm win_technical win_rank_scaled top_long_only top_capped_turnover agg_return_statistics agg_decile_returns "
    "bar_dollar bar_reset evt_cusum lbl_triple_barrier wgt_uniqueness cv_folds sta_frac_diff sta_adf pf_hrp pf_backtest ml_predictions"
).split()


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    made, took = catalog.queries(), {}
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for name in HEADLINE:
        began = time.time()
        made[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
