"""Runs side by side in a row: one row a key is shuffled, and the pairs stay what they were."""

import re

from pyspark.sql import functions as F

from ratemill.plans import evaluate as E
from ratemill.plans import report as P
from ratemill.schema import KEY

RATED = ", ".join(f"{k} string" for k in KEY) + ", rater_id string, value double"


def _rated(spark, rows):
    return spark.createDataFrame([("d0", e, "en", f"a{e}", "1", "m", "r", v) for e, v in rows], RATED)


def _runs(spark):
    rows = _rated(spark, [("1", 0.2), ("1", 0.4), ("1", float("nan")), ("2", None), (None, 0.6), ("4", 0.9)])
    return rows.withColumn("run", F.explode(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(None)))).filter("NOT (encounter_id <=> '4' AND run <=> 1)")


def _pairs(df):
    return sorted(str((r["run"], r["dataset"], r["lang"], r["metric"], round(r["value_x"], 6), r["value_y"] if r["value_y"] is None else round(r["value_y"], 6))) for r in df.collect())


def test_packed_runs_are_paired_as_rows_of_their_own_are(spark, monkeypatch):
    """Runs named null and NaN, repeated keys, ratings without a number, a key that one run lacks."""
    gold = _rated(spark, [("1", 0.0), ("1", 1.0), ("2", 0.5), (None, 0.25), ("4", 1.0), ("5", 1.0)])
    packed = _pairs(E.pair_runs(gold, _runs(spark), ["run"]))
    assert len(packed) == 11 and sum(", None)" in p for p in packed) == 3
    monkeypatch.setattr(E, "RUN_SLOTS", 2)
    assert _pairs(E.pair_runs(gold, _runs(spark), ["run"])) == packed


def test_a_key_is_one_row_in_the_shuffle_whatever_the_number_of_runs(spark):
    """Before, a row for every key and run: 12 runs of 300 keys were 3,600 rows to shuffle, sort and join."""
    gold = _rated(spark, [(str(i), i % 7 / 7) for i in range(300)]).repartition(2, "encounter_id")
    runs = gold.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("method", F.lit("x"))
    pairs = E.pair_runs(gold, runs, ["run", "method"])
    assert pairs.count() == 3600
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert shuffled and not any("run#" in line or "method#" in line for line in shuffled)
    packed = [line for line in plan.splitlines() if "HashAggregate" in line and "bit_or" in line]
    assert len(packed) == 2


def test_no_runs_give_no_pairs(spark):
    gold = _rated(spark, [("1", 0.0)])
    assert E.pair_runs(gold, gold.withColumn("run", F.lit(1)).filter("run = 2"), ["run"]).count() == 0


def test_sources_listed_elsewhere_need_not_have_rows(spark):
    gold = _rated(spark, [(str(i), i / 5) for i in range(6)])
    sources = gold.withColumns({"context": F.lit("c"), "split": F.lit("dev"), "method": F.lit("a")})
    listed = sources.unionByName(sources.withColumn("method", F.lit("b"))).select(*P.SOURCE)
    direct, wider = (P.score_sources(sources, gold, {"en": ["m"]}, ["d0"], one) for one in (None, listed))
    assert direct.count() == 9 and sorted(map(str, direct.collect())) == sorted(map(str, wider.collect()))


def test_human_ratings_are_dealt_before_they_are_averaged(spark):
    """Before, a task added up nearly all keys of its file split first, which filled its memory and then its disk."""
    gold = _rated(spark, [("1", 0.0), ("1", 1.0), ("1", float("nan")), (None, 0.25), (None, None), ("3", None)])
    means = E.mean_ratings(gold)
    assert sorted(str(r["value"]) for r in means.collect()) == ["0.25", "0.5", "None"]
    lines = [line for line in means._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in line or "Exchange" in line]
    last = max(i for i, line in enumerate(lines) if "Exchange" in line)
    assert not any("HashAggregate" in line for line in lines[last + 1:])
