import math

from pyspark.sql import functions as F

from ratemill.operators import aggregate as A
from ratemill.operators import relational as R
from ratemill.operators import validate as V
from ratemill.plans import evaluate as E
from ratemill.plans import report as P
from ratemill.schema import KEY, RATINGS

NAN = float("nan")
DOMAIN = {"en": ["overall", "relevance"]}


def ratings(spark, rows):
    return spark.createDataFrame([(d, e, "en", c, "S", m, r, v) for d, e, c, m, r, v in rows], RATINGS)


def table(scores):
    return {(r["scope"], r["metric"], r["stat"]): r["value"] for r in scores.collect()}


def test_scores_with_nan_missing_metric_and_foreign_dataset(spark):
    gold = [("a", "1", "c", "overall", "r1", 1.0), ("a", "1", "c", "overall", "r2", NAN), ("a", "2", "c", "overall", "r1", 0.0),
            ("x", "3", "c", "overall", "r1", 0.5), ("a", "4", None, "overall", "r1", 0.2)]
    auto = [("a", "1", "c", "overall", "p", 0.9), ("a", "2", "c", "overall", "p", 0.1), ("x", "3", "c", "overall", "p", 0.4),
            ("a", "4", None, "overall", "p", 0.2), ("a", "9", "c", "overall", "p", 0.7)]
    out = table(E.evaluate(ratings(spark, gold), ratings(spark, auto), DOMAIN, ["a", "b"]))
    assert abs(out[("ALL", "overall", "kendalltau")] - 1.0) < 1e-12  # 4 rows: the foreign data set and the null key count
    assert abs(out[("a", "overall", "kendalltau")] - 1.0) < 1e-12
    assert math.isnan(out[("b", "overall", "mean")]) and math.isnan(out[("ALL", "relevance", "mean")])
    assert out[("ALL", "ALL", "mean")] == out[("ALL", "overall", "mean")]
    assert ("x", "overall", "mean") not in out


def test_key_with_only_nan_makes_the_group_nan(spark):
    gold = [("a", "1", "c", "overall", "r1", NAN), ("a", "2", "c", "overall", "r1", 0.0), ("a", "3", "c", "overall", "r1", 1.0)]
    auto = [("a", str(i), "c", "overall", "p", i / 10) for i in (1, 2, 3)]
    out = table(E.evaluate(ratings(spark, gold), ratings(spark, auto), DOMAIN, ["a"]))
    assert math.isnan(out[("ALL", "overall", "mean")])


def test_first_prediction_counts(spark):
    gold = [("a", str(i), "c", "overall", "r", float(i)) for i in range(4)]
    auto = [("a", str(i), "c", "overall", "p", float(i)) for i in range(4)] + [("a", str(i), "c", "overall", "p", float(-i)) for i in range(4)]
    preds = ratings(spark, auto).withColumn("_pos", F.when(F.col("value") < 0, 2).otherwise(1))
    assert table(E.evaluate(ratings(spark, gold), preds, DOMAIN, ["a"]))[("ALL", "overall", "pearson")] > 0.99


def test_long_answers_stay_apart(spark):
    gold = [("a", "1", "x" * 100 + str(i), "overall", "r", float(i)) for i in range(5)]
    out = E.evaluate(ratings(spark, gold), ratings(spark, gold), DOMAIN, ["a"])
    assert abs(table(out)[("ALL", "overall", "kendalltau")] - 1.0) < 1e-12


def test_null_keys_match(spark):
    left = spark.createDataFrame([(None, 1.0), ("k", 2.0)], "k string, value double")
    assert R.join_gold_auto(left, left, ["k"]).count() == 2


def test_conflicts_ignore_nan_and_equal_values(spark):
    rows = [("a", "1", "c", "m", "r", 1.0), ("a", "1", "c", "m", "r", 1.0), ("a", "2", "c", "m", "r", NAN), ("a", "2", "c", "m", "r", 1.0), ("a", "3", "c", "m", "r", 0.0), ("a", "3", "c", "m", "r", 1.0)]
    assert [r["encounter_id"] for r in V.find_conflicts(ratings(spark, rows)).collect()] == ["3"]


def test_tie_goes_to_the_first_source_and_nan_loses(spark):
    rows = [("c", "m", "one", NAN, 1), ("c", "m", "two", 0.5, 2), ("c", "m", "three", 0.5, 3)]
    df = spark.createDataFrame(rows, "context string, metric string, method string, value double, source_order int")
    assert A.best_source(df).first()["method"] == "two"


def test_select_prefix_tie_and_nan(spark):
    rows = [(1, NAN), (1, NAN), (2, 0.4), (2, NAN), (3, 0.4), (3, 0.4)]
    assert A.select_prefix(spark.createDataFrame(rows, "x int, value double")).first()["x"] == 2


def test_prefix_average_with_gaps(spark):
    rows = [("k", 0, 1.0), ("k", 2, 4.0)]
    out = {r["x"]: r["value"] for r in A.prefix_average(spark.createDataFrame(rows, "k string, bootstrap_id int, value double"), 3).collect()}
    assert out == {1: 1.0, 2: 1.0, 3: 2.5}


def test_strict_overlap(spark):
    import pytest

    gold = ratings(spark, [("a", "1", "c", "m", "r", 1.0)])
    other = ratings(spark, [("a", "2", "c", "m", "r", 1.0)])
    with pytest.raises(ValueError):
        V.assert_overlap(gold, other)
    both = gold.unionByName(other)
    assert V.assert_overlap(both, gold)["gold_only"] == 1
    with pytest.raises(ValueError):
        V.assert_overlap(both, gold, strict=True)
    with pytest.raises(ValueError):
        V.assert_unique(gold.unionByName(gold), KEY)
    with pytest.raises(ValueError):
        V.require_columns(gold, ["nowhere"])


def test_ensemble_uses_the_dev_choice_on_test(spark):
    rows = []
    for split in ("dev", "test"):
        for i in range(6):
            good, bad = float(i), float(i % 2)
            if split == "test":
                good, bad = bad, good
            rows += [("c", split, "a", "d", f"{split}{i}", "en", "t", "S", "overall", "p", good),
                     ("c", split, "b", "d", f"{split}{i}", "en", "t", "S", "overall", "p", bad)]
    stacked = spark.createDataFrame(rows, "context string, split string, method string, dataset string, encounter_id string, lang string, candidate string, candidate_author_id string, metric string, rater_id string, value double")
    gold = ratings(spark, [("d", f"{s}{i}", "t", "overall", "r", float(i)) for s in ("dev", "test") for i in range(6)])
    out = P.main_results(stacked, gold, ["a", "b"], {"en": ["overall"]}, ["d"])
    assert [r["method"] for r in out["source_map"].collect()] == ["a"]
    board = {(r["split"], r["method"]): r["all_mean"] for r in out["leaderboard"].collect()}
    assert board[("test", P.ENSEMBLE)] == board[("test", "a")] < board[("test", "b")]
