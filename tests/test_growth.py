"""What a task groups, what is compared and what is written where tables grow."""

import os

from pyspark.sql import functions as F

from ratemill.llm import setsketch
from ratemill.schema import KEY, RAW_OUTPUT
from ratemill.streaming import outputs as ST

LINES = "l_orderkey long, l_linenumber int, l_quantity double, l_tax double, l_discount double, l_returnflag string, l_linestatus string, l_extendedprice double"


def test_items_are_dealt_over_more_tasks_as_rows_grow(spark, tmp_path, monkeypatch):
    from workload import views as W

    rows = [(None if i == 0 else i // 3, i % 3, None if i == 5 else i % 50 + 0.5, (i % 9) / 100, 0.05, "A", "F", 1.0) for i in range(200)] * 2
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(W, "TASK_ROWS", 20)
    labels = [F.min(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in W.METRICS]
    wanted = W.ratings(spark, str(tmp_path)).groupBy(*KEY[:-1]).agg(*labels)
    items = W.items(spark, str(tmp_path))
    assert items.rdd.getNumPartitions() == W.predictions(spark, str(tmp_path)).rdd.getNumPartitions() == 20
    found = items.select(*wanted.columns)
    assert found.count() == 200 and found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


def test_a_task_groups_few_enough_rows_of_many_sources(spark, tmp_path):
    """Before, 250,000 rows of lineitem, which as 24 rows each did not fit into a task's memory."""
    from workload import views as W

    line = "id DIV 4 AS l_orderkey, CAST(id % 4 AS INT) AS l_linenumber, 1.0D AS l_quantity, 0.01D AS l_tax, 0.05D AS l_discount"
    spark.range(600_000).selectExpr(*line.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert W.sources(spark, str(tmp_path)).rdd.getNumPartitions() >= 12


def test_agreeing_items_are_joined_once(spark):
    """What follows reads them from scratch; before, counts and picks each joined them anew."""
    from ratemill.operators import select as X

    items = spark.createDataFrame([(f"e{i}", "d0", i % 2, (i % 3) / 2) for i in range(12)], "encounter_id string, dataset string, fold int, m double")
    agreeing = items.filter("encounter_id <> 'e3'").select("encounter_id")
    out = X.agreement_score_balanced(items, agreeing, ["encounter_id"], ["m"], 3, unique=True)
    assert "LeftSemi" not in out._jdf.queryExecution().executedPlan().toString()
    direct = X.score_balanced(items.filter("encounter_id <> 'e3'"), ["encounter_id"], ["m"], 3, unique=True)
    assert out.count() == 6 and out.exceptAll(direct).isEmpty() and direct.exceptAll(out).isEmpty()


def test_buckets_of_the_same_vertices_give_the_same_pairs(spark):
    rows = [(bucket, v, 10, v, -1) for bucket in range(12) for v in range(40)]
    open_ = spark.createDataFrame(rows, "bucket long, vertex long, n_shingles long, component long, main long")
    assert 0 < setsketch.next_pairs(open_, 0.8).count() <= 40 * setsketch.NEXT


def test_outputs_arrive_packed(spark, tmp_path):
    from workload import texts

    rows = [([("user", "x", [("d", "1", "en", "S", None, i, None)])], ["text " * 100]) for i in range(50)]
    path = str(tmp_path / "in")
    assert texts.arrive(spark.createDataFrame(rows, RAW_OUTPUT).repartition(3), path) == 3
    assert sum(e.stat().st_size for e in os.scandir(path) if e.name.endswith(".json.gz")) < 50 * 100
    assert ST.flatten_outputs(spark.read.schema(RAW_OUTPUT).json(path)).count() == 50


def test_deliveries_are_remembered_as_digests(spark, tmp_path):
    keys = [(None, "1"), ("1", None), ("1", "1"), (None, "1")]
    rows = [([("user", "x", [(d, e, "en", "S", None, 0, None)])], ['{"overall": 1}']) for d, e in keys]
    spark.createDataFrame(rows, RAW_OUTPUT).write.json(str(tmp_path / "in"))
    means = ST.stream_bootstrap_means(ST.read_output_stream(spark, str(tmp_path / "in")), ["overall"])
    assert "Deduplicate [_delivered" in means._jdf.queryExecution().analyzed().toString()
    means.writeStream.outputMode("complete").format("memory").queryName("delivered").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["runs"] for r in spark.sql("select * from delivered").collect()) == [1, 1, 1]


def test_labels_are_sent_once_and_reach_every_vertex(spark, tmp_path):
    from ratemill.llm.components import components

    edges = [(0, i) for i in range(1, 30)] + [(100 + (i * 7) % 20, 100 + (i * 7 + 7) % 20) for i in range(20)] + [(29, 200), (200, 119)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    assert found == {v: 0 for v in [*range(30), *range(100, 120), 200]}
    labels = spark.read.parquet(str(tmp_path / "labels-0"))
    assert labels.columns == ["id", "before", "component"] and labels.filter("before = component").count() > 0
