"""Sources and sinks, filters, checks, dedupe, sets, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F


from ratemill.functions import values as FV
from ratemill.operators import aggregate as A
from ratemill.operators import relational as R
from ratemill.operators import validate as V
from ratemill.plans import report as P
from ratemill.schema import ITEM_KEY, KEY, OUTPUT_COLUMNS
from ratemill.session import scratch_path
from ratemill.sources import readers, writers
from workload import views as W
from workload.registry import query
from workload.views import KEY_SQL, with_views

ITEM_SQL = ", ".join(ITEM_KEY)
OUT_SQL = ", ".join(OUTPUT_COLUMNS)

# ---------------------------------------------------------------- sources and sinks

DOC_RATINGS = """SELECT d.source AS dataset, CAST(d.doc_id AS VARCHAR) AS encounter_id, d.lang, d.text AS candidate, 'a' AS candidate_author_id,
 'quality' AS metric, 'r1' AS rater_id, CAST(l.quality AS DOUBLE) AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def doc_ratings(spark, sf):
    docs, labels = W.table(spark, sf, "documents"), W.table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("encounter_id"), "lang", F.col("text").alias("candidate"),
        F.lit("a").alias("candidate_author_id"), F.lit("quality").alias("metric"), F.lit("r1").alias("rater_id"),
        F.col("quality").cast("double").alias("value"))


@query("read_ratings", DOC_RATINGS)
def read_ratings(spark, sf):
    """Texts with line breaks and quotes to CSV and back."""
    path = scratch_path(spark, "ratings")
    writers.write_predictions(doc_ratings(spark, sf), path)
    return readers.read_ratings(spark, path, with_position=False)


@query("read_documents", """SELECT doc_id % 400 AS encounter_id, max(doc_id) AS doc_id, arg_max(text, doc_id) AS query_content_en, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1""")
def read_documents(spark, sf):
    """Repeated ids: the last one written counts."""
    path = scratch_path(spark, "documents")
    docs = W.table(spark, sf, "documents").select((F.col("doc_id") % 400).alias("encounter_id"), "doc_id", F.col("text").alias("query_content_en"), "lang")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.json(path)
    return readers.read_documents(spark, path, docs.schema, multi_line=False)


@query("read_progress", """SELECT CAST(doc_id AS VARCHAR) AS node_id, length(text) AS original_len, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE length(text) END AS translated_len,
 CASE WHEN doc_id % 2 = 0 THEN 'redone' ELSE text END AS translated_text FROM documents""")
def read_progress(spark, sf):
    """Two logs and one that does not exist; the later log wins."""
    docs = W.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("node_id"), F.length("text").cast("long").alias("original_len"),
        F.length("text").cast("long").alias("translated_len"), F.col("text").alias("translated_text"))
    first, second = scratch_path(spark, "progress"), scratch_path(spark, "progress")
    docs.write.json(first)
    docs.filter(F.col("node_id").cast("long") % 2 == 0).withColumn("translated_len", F.lit(0).cast("long")).withColumn(
        "translated_text", F.lit("redone")).write.json(second)
    return readers.read_progress(spark, [first, second, scratch_path(spark, "absent")])


@query("read_scores", with_views("predictions", """SELECT dataset AS scope, lang, metric, 'mean' AS stat, round(avg(value), 6) AS value FROM predictions GROUP BY ALL"""))
def read_scores(spark, sf):
    """A score table to a flat JSON map and back."""
    path = scratch_path(spark, "scores")
    scores = W.predictions(spark, sf).groupBy(F.col("dataset").alias("scope"), "lang", "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    writers.write_scores(scores.withColumn("stat", F.lit("mean")), path)
    return readers.read_scores(spark, [path, scratch_path(spark, "absent")]).drop("file")


@query("parse_score_keys", """SELECT scope || '-' || lang || '-' || metric || '-' || stat AS key, scope, lang, metric, stat FROM
 (SELECT DISTINCT l_returnflag AS scope FROM lineitem), (SELECT unnest(['en','zh']) AS lang), (SELECT unnest(['factual-accuracy','overall','factual-consistency-wgold']) AS metric), (SELECT unnest(['mean','kendalltau']) AS stat)
 UNION ALL SELECT 'writing-style', 'ALL', 'en', 'writing-style', 'mean' UNION ALL SELECT 'ALL_en_ALL_mean', 'ALL', 'en', 'ALL', 'mean'""")
def parse_score_keys(spark, sf):
    arr = lambda *v: F.explode(F.array(*[F.lit(x) for x in v]))
    scopes = W.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a")).distinct()
    keys = scopes.select("a", arr("en", "zh").alias("b")).select("a", "b", arr("factual-accuracy", "overall", "factual-consistency-wgold").alias("c")).select(
        "a", "b", "c", arr("mean", "kendalltau").alias("d")).select(F.concat_ws("-", "a", "b", "c", "d").alias("key"))
    bare = scopes.limit(1).select(arr("writing-style", "ALL_en_ALL_mean").alias("key"))
    return readers.parse_score_keys(keys.unionByName(bare).withColumn("value", F.lit(0.0))).drop("value")


@query("write_predictions", with_views("predictions", f"SELECT {OUT_SQL} FROM predictions"))
def write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(R.select_output_columns(W.predictions(spark, sf)), path)
    return readers.read_ratings(spark, path, with_position=False)


@query("write_prompts", "SELECT conv_id, turn, role, text AS content FROM conversations")
def write_prompts(spark, sf):
    path = scratch_path(spark, "prompts")
    rows = W.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    writers.write_prompts(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("write_failures", "SELECT count(*) AS failures, count(*) AS written FROM documents WHERE doc_id % 3 = 0")
def write_failures(spark, sf):
    """All failures written and counted."""
    path = scratch_path(spark, "failures")
    bad = W.table(spark, sf, "documents").filter(F.col("doc_id") % 3 == 0).select("doc_id", F.lit("no JSON found").alias("error"))
    count = writers.write_failures(bad, path)
    return spark.read.schema(bad.schema).json(path).agg(F.lit(count).cast("long").alias("failures"), F.count("*").alias("written"))


@query("write_splits", with_views("items", "SELECT k AS val_fold, count(*) FILTER (fold <> k) AS train_rows, count(*) FILTER (fold = k) AS val_rows FROM items, (SELECT CAST(unnest(range(5)) AS INTEGER) AS k) GROUP BY k"))
def write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(W.items(spark, sf), path)
    per_fold = spark.read.parquet(path).groupBy("fold").agg(F.count("*").alias("val_rows"))
    total = per_fold.agg(F.sum("val_rows")).scalar()
    return per_fold.withColumn("_t", total).select(F.col("fold").alias("val_fold"), (F.col("_t") - F.col("val_rows")).alias("train_rows"), "val_rows")


@query("union_fold_files", with_views("items", "SELECT fold, encounter_id, candidate_author_id, completeness FROM items"))
def union_fold_files(spark, sf):
    """One folder per fold, the fold read from the folder name."""
    root = scratch_path(spark, "folds")
    rows = W.items(spark, sf).select("fold", "encounter_id", "candidate_author_id", "completeness")
    for fold in range(5):
        rows.filter(F.col("fold") == fold).drop("fold").write.parquet(f"{root}/fold_{fold}")
    return readers.union_fold_files(spark, [f"{root}/fold_{k}" for k in range(5)], rows.drop("fold").schema, "parquet")


# ---------------------------------------------------------------- filters and projections


@query("filter_lang", with_views("ratings", f"SELECT {KEY_SQL}, rater_id, value FROM ratings WHERE lang = 'zh'"))
def filter_lang(spark, sf):
    return R.filter_lang(W.ratings(spark, sf).drop("pos"), "zh")


@query("filter_metrics", with_views("ratings", f"SELECT {KEY_SQL}, rater_id, value FROM ratings WHERE metric IN ('relevance', 'overall')"))
def filter_metrics(spark, sf):
    return R.filter_metrics(W.ratings(spark, sf).drop("pos"), ["relevance", "overall"])


@query("filter_raters", with_views("ratings", "SELECT rater_id, metric, count(*) AS n FROM ratings WHERE rater_id IN ('AF', 'RF', 'NO') AND rater_id <> 'RF' GROUP BY ALL"))
def filter_raters(spark, sf):
    return A.value_counts(R.filter_raters(W.ratings(spark, sf), ["AF", "RF", "NO"], ["RF"]), "metric", ["rater_id"])


@query("filter_systems", with_views("ratings", f"SELECT {KEY_SQL}, rater_id, value FROM ratings WHERE candidate_author_id IN ('1', '3')"))
def filter_systems(spark, sf):
    return R.filter_systems(W.ratings(spark, sf).drop("pos"), ["1", "3"], prefix="")


@query("filter_dataset", with_views("ratings", f"SELECT {KEY_SQL}, rater_id, value FROM ratings WHERE dataset = 'd1'"))
def filter_dataset(spark, sf):
    return R.filter_dataset(W.ratings(spark, sf).drop("pos"), "d1")


@query("split_fold", with_views("items", f"SELECT CASE WHEN fold = 2 THEN 'val' ELSE 'train' END AS part, {ITEM_SQL}, fold FROM items"))
def split_fold(spark, sf):
    train, val = R.split_fold(W.items(spark, sf), 2)
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return both.select("part", *ITEM_KEY, "fold")


@query("select_output_columns", with_views("ratings", f"SELECT {OUT_SQL} FROM ratings"))
def select_output_columns(spark, sf):
    return R.select_output_columns(W.ratings(spark, sf))


@query("fill_missing", with_views("aligned_items", "SELECT encounter_id, coalesce(image_path, '') AS image_path FROM aligned_items"))
def fill_missing(spark, sf):
    return R.fill_missing(W.aligned_items(spark, sf).select("encounter_id", "image_path"))


@query("to_numeric", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events")
def to_numeric(spark, sf):
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return W.table(spark, sf, "events").select("event_id", FV.to_numeric(mixed).alias("number"))


@query("headline_scores", with_views("predictions", "SELECT 'ALL' AS scope, lang, metric, 'mean' AS stat, round(avg(value), 6) AS value FROM predictions GROUP BY lang, metric"))
def headline_scores(spark, sf):
    preds = W.predictions(spark, sf)
    mean = lambda scope: preds.groupBy(scope.alias("scope"), "lang", "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    table = mean(F.col("dataset")).unionByName(mean(F.lit("ALL"))).withColumn("stat", F.explode(F.array(F.lit("mean"), F.lit("pearson"))))
    return R.headline_scores(table)


@query("identity", with_views("items", "SELECT DISTINCT dataset || '|' || encounter_id || '|' || lang || '|' || candidate_author_id || '|' || CAST(fold AS VARCHAR) AS key FROM items"))
def identity(spark, sf):
    key = R.identity("fold")
    keyed = W.items(spark, sf).select(key.alias("k"))
    return keyed.select(F.concat_ws("|", "k.dataset", "k.encounter_id", "k.lang", "k.candidate_author_id", F.col("k.fold").cast("string")).alias("key")).distinct()


# ---------------------------------------------------------------- checks


@query("find_conflicts", with_views("ratings", f"SELECT {KEY_SQL}, min(value) AS min_value, max(value) AS max_value, count(*) AS rows FROM ratings GROUP BY ALL HAVING count(DISTINCT value) > 1"))
def find_conflicts(spark, sf):
    return V.find_conflicts(W.ratings(spark, sf))


@query("check_counts", with_views("predictions", """SELECT coalesce(p.metric, e.metric) AS metric, coalesce(actual, 0) AS actual, CAST(coalesce(expected, 0) AS BIGINT) AS expected, coalesce(actual, 0) = coalesce(expected, 0) AS ok
 FROM (SELECT metric, count(*) AS actual FROM predictions GROUP BY 1) p FULL JOIN (VALUES ('relevance', 5), ('overall', 7)) e(metric, expected) ON p.metric = e.metric"""))
def check_counts(spark, sf):
    return V.check_counts(W.predictions(spark, sf), {"relevance": 5, "overall": 7})


@query("find_duplicates", with_views("ratings", f"SELECT {KEY_SQL}, count(*) AS rows FROM ratings GROUP BY ALL HAVING count(*) > 1"))
def find_duplicates(spark, sf):
    return V.find_duplicates(W.ratings(spark, sf))


@query("check_metric_set", with_views("ratings", "SELECT 'overall' AS metric, 'missing' AS problem UNION ALL SELECT DISTINCT metric, 'unexpected' FROM ratings WHERE metric = 'disagree_flag'"))
def check_metric_set(spark, sf):
    return V.check_metric_set(W.ratings(spark, sf), ["relevance", "completeness", "overall"])


@query("check_overlap", with_views("ratings predictions", f"""SELECT count(*) FILTER (g AND NOT a) AS gold_only, count(*) FILTER (a AND NOT g) AS auto_only, count(*) FILTER (a AND g) AS both FROM (
 SELECT {KEY_SQL}, bool_or(side = 'g') AS g, bool_or(side = 'a') AS a FROM (SELECT {KEY_SQL}, 'g' AS side FROM ratings WHERE lang = 'en' UNION ALL SELECT {KEY_SQL}, 'a' FROM predictions WHERE metric <> 'relevance') GROUP BY ALL)"""))
def check_overlap(spark, sf):
    return V.check_overlap(R.filter_lang(W.ratings(spark, sf), "en"), W.predictions(spark, sf).filter(F.col("metric") != "relevance"))


@query("find_marker", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')")
def find_marker(spark, sf):
    return V.find_marker(W.table(spark, sf, "documents"), "text", ["License", "COPYRIGHT"]).select("doc_id")


@query("flag_unfilled", with_views("predictions", "SELECT count(*) FILTER (value - 0.5 < 0) AS unfilled, count(*) AS rows FROM predictions"))
def flag_unfilled(spark, sf):
    return V.flag_unfilled(W.predictions(spark, sf).withColumn("value", F.col("value") - 0.5))


# ---------------------------------------------------------------- joins, dedupe, sort


@query("align", with_views("ratings", """SELECT r.dataset, r.encounter_id, r.lang, r.candidate_author_id, r.metric, r.value AS label, d.text AS query_text FROM ratings r
 JOIN (SELECT CASE WHEN doc_id % 10 < 5 THEN 'd0' ELSE 'd1' END AS dataset, CAST(doc_id AS VARCHAR) AS encounter_id, CASE WHEN doc_id % 4 = 3 THEN 'zh' ELSE 'en' END AS lang, text FROM documents) d
 ON r.dataset = d.dataset AND r.encounter_id = d.encounter_id AND r.lang = d.lang"""))
def align(spark, sf):
    return R.align(W.ratings(spark, sf), source_docs(spark, sf))[0].select("dataset", "encounter_id", "lang", "candidate_author_id", "metric", "label", "query_text")


def source_docs(spark, sf):
    i = F.col("doc_id")
    return W.table(spark, sf, "documents").select(
        F.when(i % 10 < 5, "d0").otherwise("d1").alias("dataset"), i.cast("string").alias("encounter_id"),
        F.when(i % 4 == 3, "zh").otherwise("en").alias("lang"), F.col("text").alias("query_text"))


@query("align_missing", with_views("ratings", "SELECT count(*) AS rows, count(DISTINCT encounter_id) AS encounters FROM ratings WHERE CAST(encounter_id AS BIGINT) NOT IN (SELECT doc_id FROM documents)"))
def align_missing(spark, sf):
    return R.align(W.ratings(spark, sf), source_docs(spark, sf))[1].agg(F.count("*").alias("rows"), F.countDistinct("encounter_id").alias("encounters"))


TEMPLATE_ON = "t.dataset = p.dataset AND t.encounter_id = p.encounter_id AND t.lang = p.lang AND t.candidate_author_id = p.candidate_author_id AND t.metric = p.metric"


@query("fill_template", with_views("ratings predictions", f"""SELECT t.dataset, t.encounter_id, t.lang, t.candidate, t.candidate_author_id, t.metric, 'run1' AS rater_id, coalesce(p.value, -1.0) AS value, p.value IS NOT NULL AS hit
 FROM ratings t LEFT JOIN (SELECT * FROM predictions WHERE metric <> 'relevance') p ON {TEMPLATE_ON}"""))
def fill_template(spark, sf):
    preds = W.predictions(spark, sf).filter(F.col("metric") != "relevance")
    return R.fill_template(W.ratings(spark, sf).drop("pos"), preds, rater_id="run1", order=["value"])


@query("expand_to_template", with_views("ratings predictions", f"""SELECT t.dataset, t.encounter_id, t.lang, t.candidate_author_id, t.metric, t.candidate, t.rater_id, p.value FROM ratings t JOIN predictions p ON {TEMPLATE_ON}"""))
def expand_to_template(spark, sf):
    parsed = W.predictions(spark, sf).drop("candidate", "rater_id")
    return R.expand_to_template(parsed, W.ratings(spark, sf).drop("pos"))[0]


@query("semi_join_keys", with_views("ratings", f"SELECT {KEY_SQL}, rater_id, value FROM ratings WHERE encounter_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')"))
def semi_join_keys(spark, sf):
    picked = W.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("encounter_id"))
    return R.semi_join_keys(W.ratings(spark, sf).drop("pos"), picked.union(picked), ["encounter_id"])


@query("filter_by_keyset", with_views("ratings items", f"SELECT r.* EXCLUDE (pos) FROM ratings r SEMI JOIN (SELECT {ITEM_SQL} FROM items WHERE completeness = 1.0) k USING ({ITEM_SQL})"))
def filter_by_keyset(spark, sf):
    return R.filter_by_keyset(W.ratings(spark, sf).drop("pos"), W.items(spark, sf).filter("completeness = 1.0").select(*ITEM_KEY))


@query("dedupe_first", with_views("ratings", f"SELECT {KEY_SQL}, arg_min(value, (pos, rater_id)) AS value FROM ratings GROUP BY ALL"))
def dedupe_first(spark, sf):
    return R.dedupe_first(W.ratings(spark, sf), KEY, ["pos", "rater_id"]).select(*KEY, "value")


@query("dedupe_last", with_views("ratings", f"SELECT {KEY_SQL}, arg_max(value, (pos, rater_id)) AS value FROM ratings GROUP BY ALL"))
def dedupe_last(spark, sf):
    return R.dedupe_last(W.ratings(spark, sf), KEY, ["pos", "rater_id"]).select(*KEY, "value")


@query("anti_join_done", f"SELECT CAST(doc_id AS VARCHAR) AS node_id FROM documents WHERE {W.u_sql('CAST(doc_id AS VARCHAR)')} >= 0.5")
def anti_join_done(spark, sf):
    nodes = W.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("node_id"))
    done = nodes.filter(FV.uniform(F.col("node_id")) < 0.5)
    return R.anti_join_done(nodes, done.union(done))


@query("merge_overlay", f"SELECT doc_id, lang, CASE WHEN {W.u_sql('CAST(doc_id AS VARCHAR)')} < 0.5 THEN upper(source) ELSE text END AS text FROM documents")
def merge_overlay(spark, sf):
    docs = W.table(spark, sf, "documents").select("doc_id", "lang", "text", "source")
    new = docs.filter(FV.uniform(F.col("doc_id")) < 0.5).select("doc_id", F.upper("source").alias("text"))
    unknown = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("unknown").alias("text"))
    return R.merge_overlay(docs.drop("source"), new.union(unknown), ["doc_id"], "text")


@query("sort_keys", with_views("predictions", f"SELECT {KEY_SQL}, value FROM predictions"))
def sort_keys(spark, sf):
    return R.sort_keys(W.predictions(spark, sf)).select(*KEY, "value")


@query("limit_items", with_views("ratings", f"SELECT {KEY_SQL}, rater_id, value FROM ratings SEMI JOIN (SELECT DISTINCT {ITEM_SQL} FROM ratings ORDER BY {ITEM_SQL} LIMIT 25) k USING ({ITEM_SQL})"))
def limit_items(spark, sf):
    return R.limit_items(W.ratings(spark, sf).drop("pos"), 25)


# ---------------------------------------------------------------- sets


@query("union_all", with_views("ratings predictions", "SELECT metric, rater_id, pos IS NULL AS no_pos, count(*) AS n FROM (SELECT * FROM ratings UNION ALL BY NAME SELECT * FROM predictions) GROUP BY ALL"))
def union_all(spark, sf):
    both = R.union_all([W.ratings(spark, sf), W.predictions(spark, sf)])
    return both.groupBy("metric", "rater_id", F.col("pos").isNull().alias("no_pos")).agg(F.count("*").alias("n"))


@query("except_ids", "SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def except_ids(spark, sf):
    taken = W.table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.except_ids(W.table(spark, sf, "lineitem"), taken, ["l_orderkey"])


@query("intersect_bins", with_views("items", f"SELECT {ITEM_SQL}, CAST(CAST(completeness <= 0 AS INTEGER) + CAST(relevance <= 0 AS INTEGER) AS INTEGER) AS shared FROM items"))
def intersect_bins(spark, sf):
    bins = F.array(*[F.concat(F.lit(m + "|"), FV.metric_bin(m)) for m in ("completeness", "relevance")])
    wanted = F.array(F.lit("completeness|low"), F.lit("relevance|low"))
    return W.items(spark, sf).select(*ITEM_KEY, F.size(R.intersect_bins(bins, wanted)).alias("shared"))


@query("pad_language", with_views("ratings predictions", f"SELECT {KEY_SQL}, rater_id, value FROM predictions WHERE lang = 'en' UNION ALL SELECT {KEY_SQL}, rater_id, value FROM ratings WHERE lang = 'zh'"))
def pad_language(spark, sf):
    return R.pad_language(R.filter_lang(W.predictions(spark, sf), "en"), W.ratings(spark, sf).drop("pos"), "zh").select(*KEY, "rater_id", "value")


@query("shard", f"SELECT doc_id FROM documents WHERE floor({W.u_sql('CAST(doc_id AS VARCHAR)')} * 4) = 2")
def shard(spark, sf):
    return R.shard(W.table(spark, sf, "documents"), 4, 2, "doc_id").select("doc_id")


# ---------------------------------------------------------------- aggregates


@query("group_items", with_views("ratings", f"SELECT {ITEM_SQL}, string_agg(metric || '=' || CAST(v AS VARCHAR), ',' ORDER BY metric) AS labels FROM (SELECT {KEY_SQL}, arg_min(value, (pos, value)) AS v FROM ratings GROUP BY ALL) GROUP BY ALL"))
def group_items(spark, sf):
    out = A.group_items(W.ratings(spark, sf), label="value", order=["pos"])
    text = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select(*ITEM_KEY, F.array_join(text, ",").alias("labels"))


@query("labels_by_metric", with_views("ratings", f"""SELECT {ITEM_SQL}, arg_min(value, (pos, value)) FILTER (metric = 'completeness') AS completeness, arg_min(value, (pos, value)) FILTER (metric = 'relevance') AS relevance
 FROM ratings WHERE NOT (metric = 'relevance' AND candidate_author_id = '2') GROUP BY ALL HAVING count(*) FILTER (metric = 'relevance') > 0"""))
def labels_by_metric(spark, sf):
    some = W.ratings(spark, sf).filter(~((F.col("metric") == "relevance") & (F.col("candidate_author_id") == "2")))
    return A.labels_by_metric(some, ["completeness", "relevance"], label="value", order="pos")[0]


@query("labels_missing", with_views("ratings", f"SELECT DISTINCT {ITEM_SQL}, 'relevance' AS missing FROM ratings WHERE candidate_author_id = '2'"))
def labels_missing(spark, sf):
    some = W.ratings(spark, sf).filter(~((F.col("metric") == "relevance") & (F.col("candidate_author_id") == "2")))
    out = A.labels_by_metric(some, ["completeness", "relevance"], label="value", order="pos")[1]
    return out.select(*ITEM_KEY, F.array_join("missing_metrics", ",").alias("missing"))


@query("agreement_keys", with_views("ratings", f"""SELECT {ITEM_SQL} FROM (SELECT {KEY_SQL}, count(value) AS n, max(value) - min(value) AS gap FROM ratings WHERE metric IN ('completeness','relevance') GROUP BY ALL)
 GROUP BY ALL HAVING bool_and(n <= 1 OR (n = 2 AND gap <= 0.5))"""))
def agreement_keys(spark, sf):
    return A.agreement_keys(W.ratings(spark, sf), ["completeness", "relevance"], 0.5)


@query("value_counts", with_views("ratings", "SELECT metric, value, count(*) AS n FROM ratings GROUP BY ALL"))
def value_counts(spark, sf):
    return A.value_counts(W.ratings(spark, sf), "value", ["metric"])


@query("distinct_keys", with_views("ratings", "SELECT DISTINCT dataset, encounter_id FROM ratings"))
def distinct_keys(spark, sf):
    return A.distinct_keys(W.ratings(spark, sf), ["dataset", "encounter_id"])


@query("nunique", with_views("ratings", "SELECT dataset, count(DISTINCT encounter_id) AS n FROM ratings GROUP BY ALL"))
def nunique(spark, sf):
    return A.nunique(W.ratings(spark, sf), "encounter_id", ["dataset"])


@query("first_per_combo", with_views("items", f"""SELECT {ITEM_SQL}, completeness, relevance FROM (SELECT *, row_number() OVER (PARTITION BY dataset, completeness, relevance ORDER BY encounter_id, candidate_author_id) AS r FROM items
 WHERE completeness IN (0, 0.5, 1) AND relevance IN (0, 0.5, 1)) WHERE r = 1"""))
def first_per_combo(spark, sf):
    return A.first_per_combo(W.items(spark, sf), ["completeness", "relevance"]).select(*ITEM_KEY, "completeness", "relevance")


@query("combo_shots", with_views("items", f"""SELECT {ITEM_SQL}, completeness, relevance FROM (SELECT *, row_number() OVER (PARTITION BY dataset, completeness, relevance ORDER BY encounter_id, candidate_author_id) AS r FROM items)
 WHERE r = 1 ORDER BY dataset DESC, completeness, relevance LIMIT 12"""))
def combo_shots(spark, sf):
    return A.combo_shots(W.items(spark, sf), 12, ["completeness", "relevance"], datasets=["d1", "d0"]).select(*ITEM_KEY, "completeness", "relevance")


@query("bin_coverage", with_views("ratings", "SELECT metric, CASE WHEN value <= 0 THEN 'low' WHEN value >= 1 THEN 'high' ELSE 'mid' END AS bin, count(*) AS n FROM ratings GROUP BY ALL"))
def bin_coverage(spark, sf):
    return A.bin_coverage(W.ratings(spark, sf).withColumn("bin", FV.metric_bin("value")))


@query("missing_bins", with_views("ratings", "SELECT DISTINCT metric, CASE WHEN value <= 0 THEN 'low' WHEN value >= 1 THEN 'high' ELSE 'mid' END AS bin FROM ratings WHERE value = 0.5 OR metric = 'relevance'"))
def missing_bins(spark, sf):
    pool = W.ratings(spark, sf).withColumn("bin", FV.metric_bin("value"))
    return A.missing_bins(pool.filter((F.col("value") != 0.5) & (F.col("metric") != "relevance")), pool)


@query("classification_report", """WITH t AS (SELECT quality AS label, CAST(length(d.text) % 3 AS INTEGER) AS prediction FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
 c AS (SELECT DISTINCT label AS cls FROM t UNION SELECT DISTINCT prediction FROM t),
 f AS (SELECT cls, coalesce(2.0 * count(*) FILTER (label = cls AND prediction = cls) / nullif(count(*) FILTER (label = cls) + count(*) FILTER (prediction = cls), 0), 0) AS f1 FROM t, c GROUP BY cls)
 SELECT (SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) FROM t) AS accuracy, round(avg(f1), 6) AS f1_macro, (SELECT count(*) FROM t) AS rows FROM f""")
def classification_report(spark, sf):
    docs = W.table(spark, sf, "documents").select("doc_id", (F.length("text") % 3).alias("prediction"))
    rows = W.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")
    out = A.classification_report(rows)
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"), "rows")


@query("pool_sizes", with_views("items", "SELECT fold, count(*) AS infer_items, CAST((SELECT count(*) FROM items) - count(*) AS BIGINT) AS shot_items FROM items GROUP BY fold"))
def pool_sizes(spark, sf):
    return P.pool_sizes(W.items(spark, sf), ITEM_KEY)


# ---------------------------------------------------------------- column functions


@query("metric_bin", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax * 20 - 0.3 <= 0 THEN 'low' WHEN l_tax * 20 - 0.3 >= 1 THEN 'high' ELSE 'mid' END AS bin FROM lineitem")
def metric_bin(spark, sf):
    return W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", FV.metric_bin(F.col("l_tax") * 20 - 0.3).alias("bin"))


@query("label_class", "SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 0 WHEN value < 0.25 THEN 0 WHEN value < 0.75 THEN 1 ELSE 2 END AS INTEGER) AS cls FROM events")
def label_class(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit("none")).otherwise(F.col("value").cast("string"))
    return W.table(spark, sf, "events").select("event_id", FV.label_class(text, missing_class=2).alias("cls"))


@query("flip_metric", with_views("predictions", f"SELECT {KEY_SQL}, greatest(0.0, least(1.0, CASE WHEN metric = 'disagree_flag' THEN 1 - value ELSE value END)) AS value FROM predictions"))
def flip_metric(spark, sf):
    return W.predictions(spark, sf).select(*KEY, FV.clip01(FV.flip_metric("metric", "value")).alias("value"))


@query("expected_value", """WITH t AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE) * 9, CAST(embedding[2] AS DOUBLE) * 9, CAST(embedding[3] AS DOUBLE) * 9] AS z FROM embeddings)
 SELECT vec_id, round((0.5 * exp(z[2]) + exp(z[3])) / (exp(z[1]) + exp(z[2]) + exp(z[3])), 6) AS expected,
 CASE WHEN z[1] >= z[2] AND z[1] >= z[3] THEN 0.0::DOUBLE WHEN z[2] >= z[3] THEN 0.5 ELSE 1.0 END AS likely FROM t""")
def expected_value(spark, sf):
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 9)
    return W.table(spark, sf, "embeddings").select(
        "vec_id", F.round(FV.expected_value(logits), 6).alias("expected"), FV.argmax_value(logits).alias("likely"))


@query("l2_normalize", """SELECT vec_id, CAST(u.i AS INTEGER) AS pos, round(u.v / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) + 0 AS value
 FROM (SELECT vec_id, embedding, unnest(list_transform(embedding, lambda x, i: struct_pack(i := i - 1, v := CAST(x AS DOUBLE)))) AS u FROM embeddings)""")
def l2_normalize(spark, sf):
    return W.table(spark, sf, "embeddings").select("vec_id", F.posexplode(FV.l2_normalize("embedding")).alias("pos", "v")).select(
        "vec_id", "pos", (F.round("v", 6) + 0.0).alias("value"))


@query("mean_pool", """SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) + 0 AS first, round(avg(CAST(embedding[64] AS DOUBLE)), 6) + 0 AS last FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label""")
def mean_pool(spark, sf):
    """The vectors of one block of ten play the tokens of one text; odd ones are masked."""
    block = F.floor(F.col("vec_id") / 10)
    tokens = W.table(spark, sf, "embeddings").groupBy("label", block.alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t"))
    mask = F.transform("t", lambda x: F.when(x["vec_id"] % 2 == 0, 1).otherwise(0))
    pooled = tokens.select("label", FV.mean_pool(F.transform("t", lambda x: x["embedding"]), mask).alias("p"),
                           F.aggregate(mask, F.lit(0), lambda a, m: a + m).alias("w")).filter("w > 0")
    part = lambda i: F.round(F.sum(F.col("p")[i] * F.col("w")) / F.sum("w"), 6) + 0.0
    return pooled.groupBy("label").agg(part(0).alias("first"), part(63).alias("last"))


@query("format_value", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.3f', l_extendedprice) AS shown FROM lineitem")
def format_value(spark, sf):
    return W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", FV.format_value("l_extendedprice").alias("shown"))
