"""Readers by header, and operators that must not lose rows."""

import pytest
from pyspark.sql import functions as F

from ratemill.operators.crossfit import cross_fit
from ratemill.operators.sample import oversample
from ratemill.plans.evaluate import short_candidate
from ratemill.sources.readers import read_ratings
from ratemill.sources.writers import write_failures


def test_ratings_are_read_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('encounter_id,extra,dataset,lang,candidate_author_id,candidate,metric,value,rater_id\ne1,x,iiyi,en,a1,"one, ""two""",m,0.5,r1\n')
    row = read_ratings(spark, str(tmp_path / "a.csv"), with_position=False).first()
    assert (row["dataset"], row["encounter_id"], row["candidate"], row["value"], row["rater_id"]) == ("iiyi", "e1", 'one, "two"', 0.5, "r1") and "extra" not in row.asDict()
    (tmp_path / "b.csv").write_text("encounter_id,dataset\ne1,iiyi\n")
    with pytest.raises(ValueError, match="metric"):
        read_ratings(spark, str(tmp_path / "b.csv"))


def test_all_failures_are_written(spark, tmp_path):
    assert write_failures(spark.range(1200).withColumn("error", F.lit("x")), str(tmp_path / "f")) == 1200
    assert spark.read.json(str(tmp_path / "f")).count() == 1200


@pytest.mark.parametrize("scheme", ["adaptive", "fixed"])
def test_oversampling_keeps_rows_with_nulls(spark, scheme):
    df = spark.createDataFrame([("d", "m", 1)] * 8 + [("d", "m", 0), ("d", "m", None), ("d", None, 1), ("wound", "completeness", 0)], "dataset string, metric string, label int")
    out = oversample(df, scheme)
    assert out.filter("copy = 1").count() == 12
    assert out.filter("metric = 'm' and label = 0").count() == (8 if scheme == "adaptive" else 1)
    assert out.filter("metric = 'completeness'").count() == (1 if scheme == "adaptive" else 11)


def test_every_row_comes_back_from_cross_fitting(spark):
    df = spark.createDataFrame([("a b", 1, "m", 0), ("a c", None, "m", 1), ("a d", 1, "other", 0), ("a e", 1, "m", None), ("f", 1, None, 0)], "text string, label int, metric string, fold int")
    out = {r["text"]: r["prediction"] for r in cross_fit(df, ["m"], [0, 1]).collect()}
    assert out == {"a b": None, "a c": 1.0, "a d": None, "a e": None, "f": None}


def test_cross_fitting_after_an_observation(spark, tmp_path):
    """A session that has seen one cannot be sent to tasks; a fitted model must not carry it along."""
    write_failures(spark.range(3).withColumn("error", F.lit("x")), str(tmp_path / "f"))
    df = spark.createDataFrame([("bad awful" if i % 2 else "good fine", i % 2, "m", i // 2 % 2) for i in range(40)], "text string, label int, metric string, fold int")
    out = cross_fit(df, ["m"], [0, 1])
    assert out.count() == 40 and out.filter("prediction = label").count() == 40


def test_answers_of_any_length_are_digests(spark):
    out = short_candidate(spark.createDataFrame([("x",), ("y" * 100,), (None,)], "candidate string")).collect()
    assert [r[0] and len(r[0]) for r in out] == [64, 64, None]
