"""Sources checked and cut to one row per key without a shuffle by source."""

import re

from pyspark.sql import functions as F

from ratemill.plans import report as P
from ratemill.schema import KEY

RATED = ", ".join(f"{k} string" for k in KEY) + ", rater_id string, value double"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rated(spark, rows):
    return spark.createDataFrame([("d0", e, "en", None if e is None else f"a{e}", "1", "m", "r", v) for e, v in rows], RATED)


def test_sources_are_normalised_without_a_shuffle_by_source(spark):
    rows = _rated(spark, [("1", 0.1), (None, 0.2), ("2", 0.3)]).select(
        F.lit("c").alias("context"), F.lit("dev").alias("split"), F.explode(F.array(F.lit("good"), F.lit("bad"))).alias("method"), "*")
    rows = rows.withColumn("_pos", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = rows.withColumn("value", F.when((F.col("method") == "bad") & F.col("encounter_id").isNull(), F.col("_pos") / 10).otherwise(F.col("value")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, problems = P.normalize_sources(rows)
        plan = re.sub(r"#\d+L?", "", _plan(kept))
        assert "Sort [_row ASC" in plan
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [(r["method"], r["problem"], r["n"]) for r in problems.collect()] == [("bad", "conflicting values", 1)]
    assert sorted((r["method"], str(r["encounter_id"]), r["value"]) for r in kept.collect()) == [("good", "1", 0.1), ("good", "2", 0.3), ("good", "None", 0.2)]
