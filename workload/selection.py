"""Folds, samples, neighbours and example selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratemill.operators import aggregate as A
from ratemill.operators import relational as R
from ratemill.operators import sample as S
from ratemill.operators import select as X
from ratemill.operators import similar as N
from ratemill.operators.crossfit import cross_fit as fit_folds
from ratemill.operators.crossfit import text_classifier
from ratemill.schema import ITEM_KEY
from workload import views as W
from workload.basics import ITEM_SQL
from workload.registry import query
from workload.views import u_sql, with_views

SEED = f"'{S.SEED}'"
ITEM_TEXT = "concat_ws('|', dataset, encounter_id, lang, candidate, candidate_author_id)"
FOLDS = 5

# ---------------------------------------------------------------- samples


@query("dense_index", "SELECT dataset, encounter_id, row_number() OVER (PARTITION BY dataset ORDER BY substr(md5(encounter_id), 1, 3), encounter_id) - 1 AS idx FROM (SELECT DISTINCT CASE WHEN l_orderkey % 10 < 5 THEN 'd0' ELSE 'd1' END AS dataset, CAST(l_orderkey AS VARCHAR) AS encounter_id FROM lineitem)")
def dense_index(spark, sf):
    return S.dense_index(W.ratings(spark, sf).select("dataset", "encounter_id").distinct(), ["encounter_id"], ["dataset"])


def digest_sql(*parts: str) -> str:
    """SQL text of ratemill.operators.sample.digest."""
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def number_sql(*parts: str) -> str:
    """SQL text of the 60 bits of a draw."""
    return f"CAST('0x' || substr({digest_sql(*parts)}, 1, 15) AS BIGINT)"


@query("bootstrap_groups", with_views("items", f"""SELECT b AS bootstrap_id, c AS copy_id, {ITEM_SQL} FROM (SELECT CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, {number_sql(SEED, 'CAST(b AS VARCHAR)', 'CAST(c AS VARCHAR)')} % (SELECT count(*) FROM items) AS idx
 FROM (SELECT unnest(range(7)) AS b), (SELECT unnest(range(20)) AS c)) d JOIN (SELECT {ITEM_SQL}, row_number() OVER (ORDER BY md5({ITEM_TEXT}), {ITEM_SQL}) - 1 AS idx FROM items) i ON d.idx = i.idx"""))
def bootstrap_groups(spark, sf):
    """Seven bootstraps of twenty items, with replacement, copies numbered."""
    return S.bootstrap_groups(W.items(spark, sf), ITEM_KEY, 20, 7).select("bootstrap_id", "copy_id", *ITEM_KEY)


@query("bootstrap_groups_per_fold", with_views("items", f"""SELECT fold, b AS bootstrap_id, c AS copy_id, {ITEM_SQL} FROM (SELECT n.fold, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, {number_sql(SEED, 'CAST(b AS VARCHAR)', 'CAST(n.fold AS VARCHAR)', 'CAST(c AS VARCHAR)')} % n.n AS idx
 FROM (SELECT fold, count(*) AS n FROM items GROUP BY fold) n, (SELECT unnest(range(3)) AS b), (SELECT unnest(range(20)) AS c)) d
 JOIN (SELECT {ITEM_SQL}, fold, row_number() OVER (PARTITION BY fold ORDER BY md5({ITEM_TEXT}), {ITEM_SQL}) - 1 AS idx FROM items) i USING (fold, idx)"""))
def bootstrap_groups_per_fold(spark, sf):
    return S.bootstrap_groups(W.items(spark, sf), ITEM_KEY, 20, 3, by=["fold"]).select("fold", "bootstrap_id", "copy_id", *ITEM_KEY)


@query("bootstrap_groups_distinct", with_views("items", f"""SELECT b AS bootstrap_id, CAST(r - 1 AS INTEGER) AS copy_id, {ITEM_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY {digest_sql(SEED, 'CAST(b AS VARCHAR)', ITEM_TEXT)}, {ITEM_SQL}) AS r
 FROM items, (SELECT CAST(unnest(range(3)) AS INTEGER) AS b)) WHERE r <= 20"""))
def bootstrap_groups_distinct(spark, sf):
    return S.bootstrap_groups(W.items(spark, sf), ITEM_KEY, 20, 3, replace=False).select("bootstrap_id", "copy_id", *ITEM_KEY)


@query("sample_groups", with_views("items", f"SELECT {ITEM_SQL} FROM items ORDER BY {digest_sql(SEED, ITEM_TEXT)}, {ITEM_SQL} LIMIT 20"))
def sample_groups(spark, sf):
    return S.sample_groups(W.items(spark, sf), ITEM_KEY, 20)


@query("sample_groups_per_fold", with_views("items", f"SELECT fold, {ITEM_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {digest_sql(SEED, 'CAST(fold AS VARCHAR)', ITEM_TEXT)}, {ITEM_SQL}) AS r FROM items) WHERE r <= 20"))
def sample_groups_per_fold(spark, sf):
    return S.sample_groups(W.items(spark, sf), ITEM_KEY, 20, by=["fold"])


@query("sample_ids_split", with_views("ratings", f"""SELECT part, metric, count(*) AS n FROM (SELECT metric, CASE WHEN encounter_id IN (SELECT encounter_id FROM (SELECT DISTINCT encounter_id FROM ratings) ORDER BY {digest_sql(SEED, 'encounter_id')}, encounter_id LIMIT 100) THEN 'train' ELSE 'val' END AS part FROM ratings) GROUP BY ALL"""))
def sample_ids_split(spark, sf):
    train, val = S.sample_ids_split(W.ratings(spark, sf), 100)
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return A.value_counts(both, "metric", ["part"])


@query("stratified_sample", with_views("items", f"SELECT {ITEM_SQL}, completeness FROM (SELECT *, row_number() OVER (PARTITION BY completeness ORDER BY {digest_sql(SEED, ITEM_TEXT)}, {ITEM_SQL}) AS r FROM items) WHERE r <= 10"))
def stratified_sample(spark, sf):
    return S.stratified_sample(W.items(spark, sf), ["completeness"], 10, ITEM_KEY).select(*ITEM_KEY, "completeness")


@query("sample_rows", f"SELECT doc_id, lang FROM documents ORDER BY {digest_sql(SEED, 'CAST(doc_id AS VARCHAR)')}, doc_id LIMIT 50")
def sample_rows(spark, sf):
    return S.sample_rows(W.table(spark, sf, "documents").select("doc_id", "lang"), 50, ["doc_id"])


@query("bootstrap_groups_null_fold", with_views("items", f"""SELECT CAST(nullif(fold, 0) AS INTEGER) AS fold, b AS bootstrap_id, count(*) AS draws, count(DISTINCT ({ITEM_SQL})) AS items FROM (SELECT n.fold, CAST(b AS INTEGER) AS b, {number_sql(SEED, 'CAST(b AS VARCHAR)', 'CAST(nullif(n.fold, 0) AS VARCHAR)', 'CAST(c AS VARCHAR)')} % n.n AS idx
 FROM (SELECT fold, count(*) AS n FROM items GROUP BY fold) n, (SELECT unnest(range(2)) AS b), (SELECT unnest(range(3000)) AS c)) d
 JOIN (SELECT {ITEM_SQL}, fold, row_number() OVER (PARTITION BY fold ORDER BY md5({ITEM_TEXT}), {ITEM_SQL}) - 1 AS idx FROM items) i USING (fold, idx) GROUP BY ALL"""))
def bootstrap_groups_null_fold(spark, sf):
    """Items without a fold are a group too; more draws than one task makes."""
    pool = W.items(spark, sf).withColumn("fold", F.when(F.col("fold") != 0, F.col("fold")))
    drawn = S.bootstrap_groups(pool, ITEM_KEY, 3000, 2, by=["fold"])
    return drawn.groupBy("fold", "bootstrap_id").agg(F.count("*").alias("draws"), F.countDistinct(*ITEM_KEY).alias("items"))


@query("sample_rows_many", f"SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY {digest_sql(SEED, 'concat_ws($$|$$, CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))')}, l_orderkey, l_linenumber LIMIT 5000")
def sample_rows_many(spark, sf):
    return S.sample_rows(W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 5000, ["l_orderkey", "l_linenumber"])


@query("sample_groups_many", f"SELECT * FROM (SELECT DISTINCT l_partkey FROM lineitem) ORDER BY {digest_sql(SEED, 'CAST(l_partkey AS VARCHAR)')}, l_partkey LIMIT 1500")
def sample_groups_many(spark, sf):
    return S.sample_groups(W.table(spark, sf, "lineitem"), ["l_partkey"], 1500)


@query("stratified_sample_many", f"SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {digest_sql(SEED, 'concat_ws($$|$$, CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))')}, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 2000")
def stratified_sample_many(spark, sf):
    rows = W.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return S.stratified_sample(rows, ["l_returnflag"], 2000, ["l_orderkey", "l_linenumber"])


_LIST5 = "[1, 2, 3, 4, 5]"


@query("group_kfold", f"""WITH RECURSIVE grp AS MATERIALIZED (SELECT CAST(l_orderkey AS VARCHAR) AS encounter_id, count(*) AS size FROM lineitem GROUP BY ALL),
cls AS MATERIALIZED (SELECT size, count(*) AS c, row_number() OVER (ORDER BY size DESC) AS rn FROM grp GROUP BY size),
st AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS size, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST([] AS BIGINT[]) AS counts
 UNION ALL SELECT rn, size, list_transform({_LIST5}, lambda i: loads[i] + size * len(list_filter(picked, lambda z: z[2] = i))), list_transform({_LIST5}, lambda i: len(list_filter(picked, lambda z: z[2] = i)))
 FROM (SELECT cls.rn, cls.size, st.loads, list_slice(list_sort(flatten(list_transform(range(0, cls.c), lambda j: list_transform({_LIST5}, lambda i: [st.loads[i] + j * cls.size, i])))), 1, cls.c) AS picked
  FROM st JOIN cls ON cls.rn = st.rn + 1)),
quota AS (SELECT size, f - 1 AS fold, coalesce(list_sum(list_slice(counts, 1, f - 1)), 0) AS first, list_sum(list_slice(counts, 1, f)) - 1 AS last FROM st, (SELECT unnest({_LIST5}) AS f) WHERE rn > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY substr(md5(encounter_id), 1, 3), encounter_id) - 1 AS idx FROM grp)
SELECT encounter_id, p.size, CAST(fold AS INTEGER) AS fold FROM placed p JOIN quota q ON p.size = q.size AND p.idx BETWEEN q.first AND q.last""")
def group_kfold(spark, sf):
    """Encounters in five folds of equal size, largest encounters first."""
    li = W.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("encounter_id"))
    return S.group_kfold(li, ["encounter_id"], FOLDS)


@query("with_folds", "SELECT count(DISTINCT l_orderkey) AS groups, count(*) AS rows, CAST(0 AS BIGINT) AS straddling, CAST(5 AS BIGINT) AS folds FROM lineitem")
def with_folds(spark, sf):
    """Rows keep their number, no encounter is in two folds."""
    li = W.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("encounter_id"))
    per = S.with_folds(li, ["encounter_id"], FOLDS).groupBy("encounter_id").agg(F.count("*").alias("n"), F.min("fold").alias("a"), F.max("fold").alias("b"))
    return per.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("straddling"), F.countDistinct("a").alias("folds"))


def _classes(spark, sf):
    return W.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linestatus").alias("metric"), F.when(F.col("l_quantity") < 3, 0).when(F.col("l_quantity") < 10, 1).otherwise(2).alias("label"))


_CLASSES = "SELECT l_orderkey, l_linestatus AS metric, CASE WHEN l_quantity < 3 THEN 0 WHEN l_quantity < 10 THEN 1 ELSE 2 END AS label FROM lineitem"


@query("oversample_adaptive", f"""WITH t AS ({_CLASSES}), c AS (SELECT metric, label, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT metric, label, CASE WHEN n * 3 < max(n) OVER (PARTITION BY metric) THEN least(max(n) OVER (PARTITION BY metric) // n, 10) ELSE 1 END AS f FROM c)
 SELECT metric, label, CAST(unnest(range(1, f + 1)) AS INTEGER) AS copy, n FROM f JOIN c USING (metric, label)""")
def oversample_adaptive(spark, sf):
    return S.oversample(_classes(spark, sf), "adaptive").groupBy("metric", "label", "copy").agg(F.count("*").alias("n"))


@query("oversample_fixed", with_views("ratings", """SELECT dataset, metric, label, CAST(unnest(range(1, f + 1)) AS INTEGER) AS copy, n FROM (
 SELECT 'wound ' || dataset AS dataset, metric, CAST(value * 2 AS INTEGER) AS label, CASE WHEN metric = 'disagree_flag' THEN CASE WHEN value = 1 THEN 4 ELSE 1 END WHEN value < 1 THEN 11 ELSE 1 END AS f, count(*) AS n FROM ratings GROUP BY ALL)"""))
def oversample_fixed(spark, sf):
    rows = W.ratings(spark, sf).select(F.concat(F.lit("wound "), "dataset").alias("dataset"), "metric", (F.col("value") * 2).cast("int").alias("label"))
    return S.oversample(rows, "fixed").groupBy("dataset", "metric", "label", "copy").agg(F.count("*").alias("n"))


@query("cross_fit")
def cross_fit(spark, sf):
    """Out-of-fold class predictions from texts, one model per metric and fold."""
    docs = W.table(spark, sf, "documents").select("doc_id", "text")
    rows = W.table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "text", F.inline(F.array(
        F.struct(F.lit("quality").alias("metric"), F.col("quality").alias("label")),
        F.struct(F.lit("toxic").alias("metric"), F.col("toxic").alias("label")))))
    folded = rows.withColumn("fold", (F.col("doc_id") % 2).cast("int"))
    return fit_folds(folded, ["quality", "toxic"], [0, 1], text_classifier(1024, 5)).select("doc_id", "metric", "fold", "label", "prediction")


# ---------------------------------------------------------------- neighbours

K = 5
_SIMS = "sims AS MATERIALIZED (SELECT t.item_id AS target_id, p.item_id, round(list_dot_product(CAST(t.vector AS DOUBLE[]), CAST(p.vector AS DOUBLE[])), 12) AS similarity FROM vectors t JOIN vectors p ON t.fold <> p.fold)"
_NEAR = lambda k: f"near AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM sims) WHERE rank <= {k})"


def _targets(spark, sf):
    return W.vectors(spark, sf).select(F.col("item_id").alias("target_id"), "vector", "fold")


def _r(df, *columns):
    for c in columns or ("similarity",):
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))
    return df


@query("topk_similar", with_views("vectors", "SELECT target_id, item_id, rank, round(similarity, 6) + 0 AS similarity FROM near", f"{_SIMS},\n{_NEAR(K)}"))
def topk_similar(spark, sf):
    """Nearest items outside the target's own fold."""
    return _r(N.topk_similar(_targets(spark, sf), W.vectors(spark, sf), K, exclude_same_fold=True))


@query("topk", with_views("predictions", "SELECT target_id, item_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT dataset || metric AS target_id, encounter_id || '/' || candidate_author_id AS item_id, value AS similarity, row_number() OVER (PARTITION BY dataset || metric ORDER BY value DESC, encounter_id || '/' || candidate_author_id) AS rank FROM predictions) WHERE rank <= 10"))
def topk(spark, sf):
    rows = W.predictions(spark, sf).select(F.concat("dataset", "metric").alias("target_id"), F.concat_ws("/", "encounter_id", "candidate_author_id").alias("item_id"), F.col("value").alias("similarity"))
    return R.topk(rows, 10)


@query("similarity_join", with_views("vectors", "SELECT target_id, round(avg(similarity), 6) + 0 AS mean_similarity, count(*) AS n FROM near GROUP BY ALL", f"{_SIMS},\n{_NEAR(20)}"))
def similarity_join(spark, sf):
    near = N.similarity_join(_targets(spark, sf), W.vectors(spark, sf), 20, exclude_same_fold=True)
    return _r(near.groupBy("target_id").agg(F.avg("similarity").alias("mean_similarity"), F.count("*").alias("n")), "mean_similarity")


@query("two_stage_topk", with_views("vectors", """SELECT target_id, item_id, CAST(r AS INTEGER) AS rank, first_rank FROM (SELECT target_id, item_id, rank AS first_rank, row_number() OVER (PARTITION BY target_id ORDER BY item_id % 10 DESC, item_id) AS r FROM near) WHERE r <= 2""", f"{_SIMS},\n{_NEAR(10)}"))
def two_stage_topk(spark, sf):
    """Ten nearest, rescored by a stub, two kept."""
    stub = lambda df: df.withColumn("score", (F.col("item_id") % 10).cast("double"))
    out = N.two_stage_topk(_targets(spark, sf), W.vectors(spark, sf), 10, 2, stub, exclude_same_fold=True)
    return out.select("target_id", "item_id", "rank", "first_rank")


@query("topk_similar_approx", with_views("vectors", "SELECT target_id, item_id, rank, round(similarity, 6) + 0 AS similarity FROM near", f"{_SIMS},\n{_NEAR(K)}"))
def topk_similar_approx(spark, sf):
    """Neighbours by the inverted file; its bounds leave out only what cannot be among them."""
    near = N.topk_similar_approx(_targets(spark, sf), W.vectors(spark, sf), K, exclude_same_fold=True)
    return _r(near.select("target_id", "item_id", "rank", "similarity"))


_WEIGHTED = lambda k: f"weighted AS MATERIALIZED (SELECT *, CASE WHEN sum(greatest(similarity, 0)) OVER w > 0 THEN greatest(similarity, 0) / sum(greatest(similarity, 0)) OVER w ELSE 1.0 / count(*) OVER w END AS weight FROM near WINDOW w AS (PARTITION BY target_id))"


@query("normalize_weights", with_views("vectors", "SELECT target_id, item_id, round(weight, 6) + 0 AS weight FROM weighted", f"{_SIMS},\n{_NEAR(K)},\n{_WEIGHTED(K)}"))
def normalize_weights(spark, sf):
    near = N.topk_similar(_targets(spark, sf), W.vectors(spark, sf), K, exclude_same_fold=True)
    return _r(X.normalize_weights(near).select("target_id", "item_id", "weight"), "weight")


@query("minmax", with_views("predictions", "SELECT encounter_id, candidate_author_id, metric, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 6) AS scaled FROM predictions WINDOW w AS (PARTITION BY encounter_id)"))
def minmax(spark, sf):
    out = X.minmax(W.predictions(spark, sf), ["encounter_id"], "value")
    return out.select("encounter_id", "candidate_author_id", "metric", F.round("scaled", 6).alias("scaled"))


@query("rank_shots", with_views("predictions", "SELECT encounter_id, candidate_author_id, metric, CAST(row_number() OVER (PARTITION BY encounter_id, metric ORDER BY value DESC, candidate_author_id) AS INTEGER) AS rank FROM predictions"))
def rank_shots(spark, sf):
    return X.rank_shots(W.predictions(spark, sf), ["encounter_id", "metric"], "value", "candidate_author_id").select("encounter_id", "candidate_author_id", "metric", "rank")


@query("weighted_sample", with_views("vectors", f"""SELECT target_id, bootstrap_id, item_id, CAST(r AS INTEGER) AS rank, near_rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id, bootstrap_id ORDER BY race, near_rank) AS r FROM (
 SELECT target_id, b AS bootstrap_id, item_id, rank AS near_rank, CASE WHEN b = 0 THEN rank WHEN weight > 0 THEN -ln({u_sql(SEED, 'CAST(target_id AS VARCHAR)', 'CAST(b AS VARCHAR)', 'CAST(item_id AS VARCHAR)')}) / weight ELSE 'infinity'::DOUBLE END AS race
 FROM weighted, (SELECT CAST(unnest(range(3)) AS INTEGER) AS b))) WHERE r <= {K}""", f"{_SIMS},\n{_NEAR(K * 4)},\n{_WEIGHTED(K)}"))
def weighted_sample(spark, sf):
    out = X.weighted_sample(_targets(spark, sf), W.vectors(spark, sf), K, 4, bootstraps=3, exclude_same_fold=True)
    return out.select("target_id", "bootstrap_id", "item_id", "rank", "near_rank")


_WARM = """warm AS (SELECT *, CASE WHEN sum(greatest(similarity, 0)) OVER w > 0 THEN greatest(similarity, 0) / sum(greatest(similarity, 0)) OVER w ELSE 1.0 / count(*) OVER w END AS weight FROM near WHERE rank <= 5 WINDOW w AS (PARTITION BY target_id))"""


@query("mmr", with_views("vectors", """SELECT target_id, bootstrap_id, CAST(i AS INTEGER) AS rank, picked[i] AS item_id FROM st, (SELECT unnest(range(1, 6)) AS i) WHERE len(picked) = 5""",
    f"""{_SIMS},
{_NEAR(15)},
{_WARM},
firsts AS (SELECT target_id, 0 AS bootstrap_id, item_id FROM near WHERE rank = 1 UNION ALL
 SELECT target_id, 1, arg_min(item_id, -ln({u_sql(SEED, 'CAST(target_id AS VARCHAR)', "'1'", 'CAST(item_id AS VARCHAR)')}) / weight) FROM warm WHERE weight > 0 GROUP BY target_id),
cand AS MATERIALIZED (SELECT n.target_id, n.item_id, n.rank, n.similarity, CAST(v.vector AS DOUBLE[]) AS vec FROM near n JOIN vectors v USING (item_id)),
st AS (SELECT f.target_id, f.bootstrap_id, [f.item_id] AS picked, [c.vec] AS vecs FROM firsts f JOIN cand c ON f.target_id = c.target_id AND f.item_id = c.item_id
 UNION ALL SELECT target_id, bootstrap_id, list_append(any_value(picked), arg_max(item_id, (score, -rank))), list_append(any_value(vecs), arg_max(vec, (score, -rank))) FROM (
  SELECT s.target_id, s.bootstrap_id, s.picked, s.vecs, c.item_id, c.rank, c.vec, 0.7 * c.similarity - 0.3 * list_max(list_transform(s.vecs, lambda v: list_dot_product(v, c.vec))) AS score
  FROM st s JOIN cand c ON s.target_id = c.target_id WHERE len(s.picked) < 5 AND NOT list_contains(s.picked, c.item_id)) GROUP BY target_id, bootstrap_id)""", recursive=True))
def mmr(spark, sf):
    """Bootstrap 0 starts from the nearest item, bootstrap 1 from a drawn one."""
    out = X.mmr(_targets(spark, sf), W.vectors(spark, sf), K, 3, 0.7, bootstraps=2, exclude_same_fold=True)
    return out.select("target_id", "bootstrap_id", "rank", "item_id")


# ---------------------------------------------------------------- label balance

SHOTS, BOOTS = 12, 2
_BIN = lambda m: f"CASE WHEN {m} <= 0 THEN 'low' WHEN {m} >= 1 THEN 'high' ELSE 'mid' END"
_RARITY = "(" + " + ".join(f"1.0 / (1 + len(list_filter(s.bins_seen, lambda b: b[{i}] = p.bins[{i}])))" for i in (1, 2, 3)) + ")"
_GAIN = "(" + " + ".join(f"CASE WHEN len(list_filter(s.bins_seen, lambda b: b[{i}] = p.bins[{i}])) = 0 THEN 1 ELSE 0 END" for i in (1, 2, 3)) + ")"


def balanced_sql(strategy: str, source: str = "items") -> str:
    """Greedy choice over classes as a recursive query, then members by draw."""
    if strategy == "bin_coverage":
        rank = "CASE WHEN s.open > 0 THEN [gain, round(rarity, 9), bonus] ELSE [0.0, round(rarity, 9), bonus] END"
    else:
        rank = "[round(rarity + bonus, 9)]"
    weight = "CAST(left_over AS DOUBLE) * exp(((rarity + bonus) - best[1]) / 1.0)" if strategy == "softmax" else "CASE WHEN rk = best THEN CAST(left_over AS DOUBLE) ELSE 0.0 END"
    u = u_sql(SEED, "CAST(target_fold AS VARCHAR)", "CAST(bootstrap_id AS VARCHAR)", "CAST(step AS VARCHAR)")
    um = u_sql(SEED, "CAST(p.target_fold AS VARCHAR)", "CAST(p.bootstrap_id AS VARCHAR)", ITEM_TEXT.replace("dataset,", "b.dataset,"))
    ctes = f"""binned AS MATERIALIZED (SELECT *, [{_BIN('completeness')}, {_BIN('relevance')}, {_BIN('disagree_flag')}] AS bins FROM {source}),
pools AS MATERIALIZED (SELECT t.target_fold, dataset, bins, count(*) AS n, row_number() OVER (PARTITION BY t.target_fold ORDER BY dataset, bins) AS cls
 FROM binned JOIN (SELECT DISTINCT fold AS target_fold FROM binned) t ON fold <> t.target_fold GROUP BY t.target_fold, dataset, bins),
bincount AS (SELECT target_fold, count(DISTINCT bins[1]) + count(DISTINCT bins[2]) + count(DISTINCT bins[3]) AS wanted FROM pools GROUP BY target_fold),
st AS (SELECT w.target_fold, CAST(b AS INTEGER) AS bootstrap_id, 0 AS step, CAST([] AS BIGINT[]) AS picked, CAST([] AS VARCHAR[][]) AS bins_seen, CAST([] AS VARCHAR[]) AS sets, w.wanted AS open, w.wanted FROM bincount w, (SELECT unnest(range({BOOTS})) AS b)
 UNION ALL SELECT target_fold, bootstrap_id, step + 1, list_append(picked, cls), list_append(bins_seen, bins), list_append(sets, dataset),
  open - gain, wanted FROM (
  SELECT *, row_number() OVER (PARTITION BY target_fold, bootstrap_id ORDER BY cls) AS pos FROM (
   SELECT *, sum(weight) OVER (PARTITION BY target_fold, bootstrap_id ORDER BY cls) AS run, sum(weight) OVER (PARTITION BY target_fold, bootstrap_id) AS total FROM (
    SELECT *, {weight} AS weight FROM (
     SELECT *, max(rk) OVER (PARTITION BY target_fold, bootstrap_id) AS best FROM (
      SELECT *, {rank.replace('s.open', 'open')} AS rk FROM (
       SELECT s.*, p.cls, p.dataset, p.bins, p.n - len(list_filter(s.picked, lambda c: c = p.cls)) AS left_over, {_RARITY} AS rarity, CAST({_GAIN} AS DOUBLE) AS gain,
        CASE WHEN s.step > 0 AND NOT list_contains(s.sets, p.dataset) THEN 0.25 ELSE 0.0 END AS bonus
       FROM st s JOIN pools p ON s.target_fold = p.target_fold WHERE s.step < {SHOTS}) WHERE left_over > 0))) ) WHERE weight > 0 AND {u} * total <= run) WHERE pos = 1),
picks AS (SELECT target_fold, bootstrap_id, i AS rank, picked[i] AS cls, len(list_filter(list_slice(picked, 1, i), lambda c: c = picked[i])) AS nth FROM st, (SELECT unnest(range(1, {SHOTS + 1})) AS i) WHERE step = {SHOTS}),
members AS (SELECT p.target_fold, p.bootstrap_id, p.cls, {', '.join('b.' + k for k in ITEM_KEY)}, row_number() OVER (PARTITION BY p.target_fold, p.bootstrap_id, p.cls ORDER BY {um}, {', '.join('b.' + k for k in ITEM_KEY)}) AS nth
 FROM (SELECT DISTINCT target_fold, bootstrap_id, cls FROM picks) p JOIN pools c ON p.target_fold = c.target_fold AND p.cls = c.cls JOIN binned b ON b.dataset = c.dataset AND b.bins = c.bins AND b.fold <> p.target_fold)"""
    body = f"SELECT target_fold, bootstrap_id, CAST(k.rank AS INTEGER) AS rank, {ITEM_SQL} FROM picks k JOIN members m USING (target_fold, bootstrap_id, cls, nth)"
    return with_views("items", body, ctes, recursive=True)


def _picked(df):
    return df.select("target_fold", "bootstrap_id", "rank", *ITEM_KEY)


@query("score_balanced", balanced_sql("balanced"))
def score_balanced(spark, sf):
    return _picked(X.score_balanced(W.items(spark, sf), ITEM_KEY, W.METRICS, SHOTS, bootstraps=BOOTS, unique=True))


@query("score_balanced_softmax", balanced_sql("softmax"))
def score_balanced_softmax(spark, sf):
    return _picked(X.score_balanced_softmax(W.items(spark, sf), ITEM_KEY, W.METRICS, SHOTS, 1.0, bootstraps=BOOTS, unique=True))


@query("metric_bin_coverage", balanced_sql("bin_coverage"))
def metric_bin_coverage(spark, sf):
    return _picked(X.metric_bin_coverage(W.items(spark, sf), ITEM_KEY, W.METRICS, SHOTS, bootstraps=BOOTS, unique=True))


_AGREE = f"""agree AS (SELECT {ITEM_SQL} FROM (SELECT {ITEM_SQL}, metric, count(value) AS n, max(value) - min(value) AS gap FROM ratings WHERE metric IN ('completeness','relevance','disagree_flag') GROUP BY ALL)
 GROUP BY ALL HAVING bool_and(n <= 1 OR (n = 2 AND gap <= 0.0))),
agreed AS MATERIALIZED (SELECT * FROM items SEMI JOIN agree USING ({ITEM_SQL})),
binned AS"""


@query("agreement_score_balanced", balanced_sql("balanced", "agreed").replace("binned AS", _AGREE, 1))
def agreement_score_balanced(spark, sf):
    agree = A.agreement_keys(W.ratings(spark, sf), W.METRICS, 0.0)
    return _picked(X.agreement_score_balanced(W.items(spark, sf), agree, ITEM_KEY, W.METRICS, SHOTS, bootstraps=BOOTS, unique=True))


_VM = ["completeness", "relevance", "overall"]


@query("coverage_similarity", with_views("vectors", """SELECT target_id, CAST(i AS INTEGER) AS rank, picked[i] AS item_id FROM st, (SELECT unnest(range(1, 6)) AS i) WHERE step = 5""",
    f"""{_SIMS},
cand AS MATERIALIZED (SELECT s.target_id, s.item_id, v.dataset, [{_BIN('completeness')}, {_BIN('relevance')}, {_BIN('overall')}] AS bins,
 coalesce((similarity - min(similarity) OVER w) / nullif(max(similarity) OVER w - min(similarity) OVER w, 0), 0) AS scaled, {u_sql(SEED, 'CAST(s.target_id AS VARCHAR)', "'0'", 'CAST(s.item_id AS VARCHAR)')} AS noise
 FROM sims s JOIN vectors v ON s.item_id = v.item_id WINDOW w AS (PARTITION BY s.target_id)),
st AS (SELECT item_id AS target_id, 0 AS step, CAST([] AS BIGINT[]) AS picked, CAST([] AS VARCHAR[][]) AS bins_seen, CAST([] AS VARCHAR[]) AS sets FROM vectors
 UNION ALL SELECT target_id, step + 1, list_append(any_value(picked), arg_max(item_id, k)), list_append(any_value(bins_seen), arg_max(bins, k)), list_append(any_value(sets), arg_max(dataset, k)) FROM (
  SELECT s.*, p.item_id, p.bins, p.dataset, [round(0.7 * {_RARITY} / 3 + 0.3 * p.scaled, 12), CASE WHEN s.step > 0 AND NOT list_contains(s.sets, p.dataset) THEN 0.25 ELSE 0.0 END, p.noise] AS k
  FROM st s JOIN cand p ON s.target_id = p.target_id WHERE s.step < 5 AND NOT list_contains(s.picked, p.item_id)) GROUP BY target_id, step)""", recursive=True))
def coverage_similarity(spark, sf):
    """Per target: rare bins and similarity together."""
    out = X.coverage_similarity(_targets(spark, sf), W.vectors(spark, sf), _VM, K, exclude_same_fold=True)
    return out.select("target_id", "rank", "item_id")


@query("cross_fit_pairs", with_views("items", """SELECT t.fold AS target_fold, i.dataset, i.completeness AS label, count(*) AS n FROM items i JOIN (SELECT DISTINCT fold FROM items) t ON i.fold <> t.fold GROUP BY ALL"""))
def cross_fit_pairs(spark, sf):
    """Pool of every fold by class: never a table of pairs, only counts."""
    items = W.items(spark, sf).withColumn("bins", F.array("completeness"))
    pools = X.class_pools(items, cross_fit=True)
    return pools.select("target_fold", "dataset", F.col("bins")[0].alias("label"), "n")
