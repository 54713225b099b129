"""What is shuffled where many runs are at hand."""

import re

from pyspark.sql import functions as F

from ratemill.plans import evaluate as E
from ratemill.schema import KEY

RATED = ", ".join(f"{k} string" for k in KEY) + ", rater_id string, value double"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rated(spark, rows):
    return spark.createDataFrame([("d0", e, "en", None if e is None else f"a{e}", "1", "m", "r", v) for e, v in rows], RATED)


def test_runs_are_shuffled_once_and_missing_keys_match(spark):
    gold = _rated(spark, [("1", 0.0), ("1", 1.0), (None, 0.25), ("3", 0.5)])
    runs = _rated(spark, [("1", 0.2), ("1", 0.4), (None, 0.6), ("2", 0.9)]).withColumn("run", F.explode(F.array(F.lit("x"), F.lit(None))))
    pairs = E.pair_runs(gold, runs, ["run"])
    found = sorted((str(r["run"]), round(r["value_x"], 6), round(r["value_y"], 6)) for r in pairs.collect())
    assert found == sorted((run, x, y) for run in ("x", "None") for x, y in ((0.5, 0.3), (0.25, 0.6)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(re.findall(r"Exchange hashpartitioning", _plan(E.pair_runs(gold, runs, ["run"])))) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_missing_data_set_counts_in_all_only(spark):
    gold = _rated(spark, [(str(i), i / 5) for i in range(6)]).withColumn("dataset", F.lit(None).cast("string"))
    scores = E.run_scores(gold, gold.withColumn("run", F.lit(1)), ["run"], {"en": ["m"]}, ["d0"])
    found = {(r["scope"], r["stat"]): r["value"] for r in scores.filter("metric = 'm'").select("scope", "stat", F.nanvl("value", F.lit(None)).alias("value")).collect()}
    assert round(found[("ALL", "pearson")], 9) == 1.0 and found[("d0", "pearson")] is None
