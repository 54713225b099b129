import json

from pyspark.sql import functions as F

from ratemill.operators import prompt as PR
from ratemill.operators import relational as R
from ratemill.schema import KEY, RAW_OUTPUT
from ratemill.sources import readers, writers
from ratemill.streaming import outputs as ST

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert "WindowGroupLimit" in plan(R.first_rows(df, ["k"], ["id"], 2))


def test_no_pair_joins_in_plans(spark):
    from workload import QUERIES

    for name in ("join_gold_auto", "average_raters", "check_overlap", "fill_template", "expand_to_template", "group_items", "prefix_average",
                 "metricwise_ensemble", "score_balanced", "parse_response", "render_prompt_gold"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scan_reads_only_what_is_needed(spark):
    from workload import QUERIES

    text = plan(QUERIES["filter_metrics"](spark, SF))
    assert "l_suppkey" not in text and "l_shipdate" not in text
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(QUERIES["semi_join_keys"](spark, SF))


def test_csv_keeps_line_breaks_quotes_and_blanks(spark, tmp_path):
    rows = [("d", "1", "en", ' say "hi",\nline two ', "S", "m", "r", 0.5), ("d", "2", "en", "中文 😀", "S", "m", None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in KEY) + ", rater_id string, value double")
    path = str(tmp_path / "p")
    writers.write_predictions(df, path)
    assert sorted(map(tuple, readers.read_ratings(spark, path, with_position=False).collect())) == sorted(rows, key=lambda r: r[1])
    assert "_pos" in readers.read_ratings(spark, path).columns


def test_scores_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ALL", "en", "factual-accuracy", "mean", 0.25), ("ALL", "en", "overall", "mean", float("nan"))],
                               "scope string, lang string, metric string, stat string, value double")
    path = str(tmp_path / "s")
    writers.write_scores(df, path)
    text = spark.read.text(path).first()[0]
    assert json.loads(text) == {"ALL-en-factual-accuracy-mean": 0.25, "ALL-en-overall-mean": None}
    back = {r["metric"]: r["value"] for r in readers.read_scores(spark, [path, str(tmp_path / "absent")]).collect()}
    assert back == {"factual-accuracy": 0.25, "overall": None}


def test_progress_later_file_wins(spark, tmp_path):
    for name, lines in (("a", ['{"node_id": "1", "translated_text": "x"}', "", '{"node_id": "1", "translated_text": "y"}']), ("b", ['{"node_id": "2", "translated_text": "z"}', ""])):
        (tmp_path / name).write_text("\n".join(lines))
    out = readers.read_progress(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c")])
    assert {r["node_id"]: r["translated_text"] for r in out.collect()} == {"1": "y", "2": "z"}


def test_documents_last_wins_and_languages(spark, tmp_path):
    docs = [{"encounter_id": "1", "query_title_en": "old", "query_content_en": "c", "image_ids": ["i"], "responses": [{"content_en": "x", "content_zh": "y"}]},
            {"encounter_id": "1", "query_title_en": "new", "query_content_en": None, "image_ids": [], "responses": []}]
    (tmp_path / "d.json").write_text(json.dumps(docs))
    schema = "encounter_id string, query_title_en string, query_content_en string, query_title_zh string, query_content_zh string, image_ids array<string>, responses array<struct<content_en: string, content_zh: string>>"
    out = readers.unpivot_languages(readers.read_documents(spark, str(tmp_path / "d.json"), schema), ["en", "zh"])
    rows = {r["lang"]: r for r in out.collect()}
    assert rows["en"]["query_title"] == "new" and rows["zh"]["query_title"] is None and rows["en"]["answers"] == []


def test_single_file_node_map(spark, tmp_path):
    store = {"docstore/data": {"n1": {"__data__": {"text": "t", "metadata": {"file_name": "f", "page_label": "3"}}}, "n2": {"__data__": {"text": "u"}}}}
    (tmp_path / "n.json").write_text(json.dumps(store, indent=1))
    rows = {r["node_id"]: r for r in readers.read_nodes(spark, str(tmp_path / "n.json")).collect()}
    assert rows["n1"]["page"] == "3" and rows["n2"]["file_name"] is None


def test_prompt_without_examples(spark):
    targets = spark.createDataFrame([("q", "c", "g", 1)], "query_text string, candidate string, gold string, fold int")
    blocks = spark.createDataFrame([], "fold int, shots string")
    out = PR.attach_shots(targets, blocks, ["fold"]).select(PR.render_prompt(["overall"], "gold").alias("p")).collect()
    assert len(out) == 1 and "Sample" not in out[0]["p"].split("The sample you need")[0] and out[0]["p"].endswith("gold responses:g\n")
    text = out[0]["p"]
    bare = spark.createDataFrame([(text,)], "p string").select(PR.prompt_item("p", F.struct(F.lit("d").alias("dataset"))).alias("i")).first()["i"]
    assert bare["role"] == "user" and bare["content"] == text


def test_stream_resumes_and_counts_runs_once(spark, tmp_path):
    def deliver(name, boots):
        rows = [([("user", "x", [("d", "1", "en", "S", None, b, None)])], [text]) for b, text in boots]
        spark.createDataFrame(rows, RAW_OUTPUT).write.json(str(tmp_path / "in" / name))

    def run():
        src = ST.read_output_stream(spark, str(tmp_path / "in" / "*"))
        ST.stream_outputs(src, ["overall"], str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()

    deliver("a", [(0, '{"overall": 1}'), (1, "nothing")])
    run()
    deliver("b", [(2, '{"overall": 0}')])
    run()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 1

    deliver("c", [(0, '{"overall": 1}')])
    means = ST.stream_bootstrap_means(ST.read_output_stream(spark, str(tmp_path / "in" / "*")), ["overall"])
    query = means.writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.sql("select * from means").first()
    assert (row["value"], row["runs"]) == (0.5, 2)
