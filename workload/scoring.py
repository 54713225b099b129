"""Evaluation, correlations, bootstraps, sources and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratemill.functions.values import no_nan
from ratemill.operators import aggregate as A
from ratemill.operators import correlate as C
from ratemill.operators import relational as R
from ratemill.operators import validate as V
from ratemill.plans import evaluate as E
from ratemill.plans import report as P
from ratemill.schema import KEY
from workload import views as W
from workload.registry import query
from workload.scores_sql import correlation_ctes, domain_sql, r6, rollup_ctes
from workload.views import KEY_SQL, with_views

DOMAIN = domain_sql(W.LANG_METRICS)
ON_KEY = " AND ".join(f"g.{k} IS NOT DISTINCT FROM p.{k}" for k in KEY)
GOLD = f"gold AS MATERIALIZED (SELECT {KEY_SQL}, avg(value) AS value FROM ratings GROUP BY ALL)"
PAIRS = f"{GOLD},\npairs AS MATERIALIZED (SELECT g.dataset, g.lang, g.metric, g.value AS x, p.value AS y FROM gold g JOIN predictions p ON {ON_KEY})"


def rounded(df, *columns):
    """Six decimals; NaN as null, as a score file writes it."""
    for c in columns or ("value",):
        df = df.withColumn(c, F.round(no_nan(c), 6) + F.lit(0.0))
    return df


@query("evaluate", with_views("ratings predictions", f"SELECT scope, lang, metric, stat, {r6('value')} FROM s_scores",
                              PAIRS + "," + rollup_ctes("pairs", DOMAIN)))
def evaluate(spark, sf):
    return rounded(E.evaluate(W.ratings(spark, sf), W.predictions(spark, sf), W.LANG_METRICS, W.DATASETS))


@query("evaluate_expand", with_views(
    "ratings predictions", f"SELECT scope, lang, metric, stat, {r6('value')} FROM s_scores",
    f"pairs AS MATERIALIZED (SELECT g.dataset, g.lang, g.metric, g.value AS x, p.value AS y FROM ratings g JOIN predictions p ON {ON_KEY}),"
    + rollup_ctes("pairs", DOMAIN)))
def evaluate_expand(spark, sf):
    """Every rater paired with the prediction, as the strict evaluation does."""
    return rounded(E.evaluate(W.ratings(spark, sf), W.predictions(spark, sf), W.LANG_METRICS, W.DATASETS, multi_rater="expand"))


@query("simple_scores", with_views(
    "ratings predictions",
    f"SELECT metric, {r6('value')} FROM (SELECT * FROM per_metric UNION ALL SELECT 'ALL_en_ALL_mean', sum(value) / 3.0 FROM per_metric)",
    PAIRS + "," + correlation_ctes("pairs", ["metric"]) + ",\nper_metric AS (SELECT metric, (kendalltau + pearson + spearman) / 3 AS value FROM s_stats)"))
def simple_scores(spark, sf):
    gold = A.average_raters(W.ratings(spark, sf))
    return rounded(E.simple_scores(gold, W.predictions(spark, sf), W.METRICS))


@query("correlations_by_rater", with_views(
    "ratings predictions", f"SELECT rater_id, metric, n, {r6('kendalltau')}, {r6('pearson')}, {r6('spearman')} FROM s_stats",
    f"pairs AS MATERIALIZED (SELECT g.rater_id, g.metric, g.value AS x, p.value AS y FROM ratings g JOIN predictions p ON {ON_KEY}),"
    + correlation_ctes("pairs", ["rater_id", "metric"])))
def correlations_by_rater(spark, sf):
    pairs = R.join_gold_auto(W.ratings(spark, sf).drop("pos"), W.predictions(spark, sf).select(*KEY, "value"))
    stats = C.correlations(pairs, ["rater_id", "metric"], "value_x", "value_y")
    return rounded(stats.select("rater_id", "metric", "n", "kendalltau", "pearson", "spearman"), "kendalltau", "pearson", "spearman")


CORR_SOURCE = "raw AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),"


@query("pearson", "WITH " + CORR_SOURCE + correlation_ctes("raw", ["g"]).replace("raw GROUP", "raw GROUP")
       + f" SELECT g, n, {r6('pearson')} FROM s_stats")
def pearson(spark, sf):
    li = W.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    return rounded(C.pearson(li, ["g"], "l_quantity", "l_extendedprice"), "pearson")


@query("spearman", "WITH " + CORR_SOURCE + correlation_ctes("raw", ["g"]) + f" SELECT g, n, {r6('spearman')} FROM s_stats")
def spearman(spark, sf):
    """Almost every price is distinct, so ranks run over as many values as rows."""
    li = W.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    return rounded(C.spearman(li, ["g"], "l_quantity", "l_extendedprice"), "spearman")


@query("kendall_tau_b", "WITH " + CORR_SOURCE + correlation_ctes("raw", ["g"]) + f" SELECT g, n, {r6('kendalltau')} FROM s_stats")
def kendall_tau_b(spark, sf):
    li = W.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    return rounded(C.kendall_tau_b(li, ["g"], "l_quantity", "l_extendedprice"), "kendalltau")


@query("average_rank", """SELECT l_returnflag, l_extendedprice, CAST(n AS BIGINT) AS n, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - n + (n + 1) / 2 AS rank
 FROM (SELECT l_returnflag, l_extendedprice, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)""")
def average_rank(spark, sf):
    li = W.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return C.average_rank(li, ["l_returnflag"], "l_extendedprice")


@query("correlation_guards", with_views("predictions", f"SELECT encounter_id, n, {r6('kendalltau')}, {r6('pearson')}, {r6('spearman')} FROM s_stats",
       """pairs AS MATERIALIZED (SELECT encounter_id, CASE WHEN metric = 'relevance' AND CAST(encounter_id AS BIGINT) % 11 = 0 THEN NULL ELSE value END AS x, CAST(candidate_author_id AS DOUBLE) AS y FROM predictions),"""
       + correlation_ctes("pairs", ["encounter_id"])))
def correlation_guards(spark, sf):
    """Many small groups: single rows, constant sides and missing values."""
    gap = (F.col("metric") == "relevance") & (F.col("encounter_id").cast("long") % 11 == 0)
    pairs = W.predictions(spark, sf).select("encounter_id", F.when(~gap, F.col("value")).alias("x"), F.col("candidate_author_id").cast("double").alias("y"))
    stats = C.correlations(pairs, ["encounter_id"])
    return rounded(stats.select("encounter_id", "n", "kendalltau", "pearson", "spearman"), "kendalltau", "pearson", "spearman")


def _simpson(f: str, low: str, high: str, steps: int = 2000) -> str:
    """SQL text of an integral of ``f`` over ``t``."""
    at = f"({low}) + k * (({high}) - ({low})) / {steps}"
    weighted = f"list_transform(range(0, {steps + 1}), lambda k: (CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {f.replace('$t', '(' + at + ')')})"
    return f"(list_sum({weighted}) * (({high}) - ({low})) / {3 * steps})"


def _tail_sql(r: str) -> str:
    angle = f"asin(abs({r}))"
    area = _simpson("exp((n - 3) * ln(greatest(cos($t), 1e-300)))", angle, f"least(pi() / 2, {angle} + 16 / sqrt(n - 2))")
    return f"2 * {area} / exp(lgamma(0.5) + lgamma(n / 2.0 - 1) - lgamma(n / 2.0 - 0.5))"


_TIED = lambda v: f"(SELECT g, sum(n{v} * (n{v} - 1) * (n{v} - 2)) AS z, sum(n{v} * (n{v} - 1) * (2 * n{v} + 5)) AS o FROM s_r{v} GROUP BY g)"


@query("correlation_pvalues", "WITH raw AS (SELECT l_returnflag AS g, l_quantity AS x, l_tax AS y FROM lineitem)," + correlation_ctes("raw", ["g"])
       + f""", kendall AS (SELECT a.g, a.n, s.pearson, s.spearman, abs(s.kendalltau) * sqrt(n0 - tx) * sqrt(n0 - ty)
  / sqrt((2 * n0 * (2 * a.n + 5) - t.o - u.o) / 18 + tx * ty / n0 + t.z * u.z / (18 * n0 * (a.n - 2))) AS z FROM s_all a JOIN s_stats s USING (g) JOIN {_TIED('x')} t USING (g) JOIN {_TIED('y')} u USING (g))
 SELECT g, CAST(n AS BIGINT) AS n, round(2 * {_simpson('exp(-$t * $t / 2)', 'z', 'z + 10')} / sqrt(2 * pi()), 6) + 0 AS kendall_pvalue,
  round({_tail_sql('pearson')}, 6) + 0 AS pearson_pvalue, round({_tail_sql('spearman')}, 6) + 0 AS spearman_pvalue FROM kendall""")
def correlation_pvalues(spark, sf):
    li = W.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    names = ["kendall_pvalue", "pearson_pvalue", "spearman_pvalue"]
    return rounded(C.correlation_pvalues(C.correlations(li, ["g"])).select("g", "n", *names), *names)


@query("correlations_by_range", "WITH " + CORR_SOURCE + correlation_ctes("raw", ["g"]) + f" SELECT g, n, {r6('kendalltau')}, {r6('pearson')}, {r6('spearman')} FROM s_stats")
def correlations_by_range(spark, sf):
    """Groups of many ranges: no task has more than about 2,000 cells."""
    li = W.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    stats = C.correlations(li, ["g"], task_cells=2000)
    return rounded(stats.select("g", "n", "kendalltau", "pearson", "spearman"), "kendalltau", "pearson", "spearman")


_MATRIX = ", ".join(
    f"struct_pack(metric_a := '{a}', metric_b := '{b}', n := count_if({a} IS NOT NULL AND {b} IS NOT NULL), pearson := corr({a}, {b}))"
    for a in W.METRICS for b in W.METRICS)


@query("correlation_matrix", with_views("items", f"""SELECT lang, m.metric_a AS metric_a, m.metric_b AS metric_b, CAST(m.n AS BIGINT) AS n, round(m.pearson, 6) + 0 AS pearson
 FROM (SELECT lang, unnest([{_MATRIX}]) AS m FROM items GROUP BY lang)"""))
def correlation_matrix(spark, sf):
    out = C.correlation_matrix(W.ratings(spark, sf), W.METRICS, [k for k in KEY if k not in ("metric", "lang")])
    return rounded(out, "pearson")


@query("correlation_matrix_many", """WITH cells AS MATERIALIZED (SELECT l_returnflag AS lang, l_partkey % 400 AS item, l_suppkey % 100 AS metric, min(l_quantity) AS v FROM lineitem GROUP BY ALL),
 pairs AS (SELECT a.lang, a.metric AS a, b.metric AS b, count(*) AS n, covar_pop(a.v, b.v) AS c, stddev_pop(a.v) * stddev_pop(b.v) AS d FROM cells a JOIN cells b USING (lang, item) GROUP BY ALL)
 SELECT l.lang, 'm' || x.a AS metric_a, 'm' || y.b AS metric_b, coalesce(n, 0) AS n, CASE WHEN n >= 2 THEN round(c / nullif(d, 0), 6) + 0 END AS pearson
 FROM (SELECT DISTINCT lang FROM cells) l CROSS JOIN (SELECT unnest(range(100)) AS a) x CROSS JOIN (SELECT unnest(range(100)) AS b) y LEFT JOIN pairs p ON p.lang = l.lang AND p.a = x.a AND p.b = y.b""")
def correlation_matrix_many(spark, sf):
    """A hundred metrics, each item with some of them."""
    rows = W.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("lang"), (F.col("l_partkey") % 400).alias("item"), F.concat(F.lit("m"), (F.col("l_suppkey") % 100).cast("string")).alias("metric"), F.col("l_quantity").cast("double").alias("value"))
    return rounded(C.correlation_matrix(rows, [f"m{i}" for i in range(100)], ["item"]), "pearson")


# ---------------------------------------------------------------- raters and runs


@query("average_raters", with_views("ratings", f"SELECT {KEY_SQL}, avg(value) AS value FROM ratings GROUP BY ALL"))
def average_raters(spark, sf):
    return A.average_raters(W.ratings(spark, sf))


@query("join_gold_auto", with_views("ratings predictions", f"SELECT g.*, p.value AS value_y FROM (SELECT {KEY_SQL}, value AS value_x FROM gold) g JOIN predictions p ON {ON_KEY}", GOLD))
def join_gold_auto(spark, sf):
    return R.join_gold_auto(A.average_raters(W.ratings(spark, sf)), W.predictions(spark, sf).select(*KEY, "value"))


@query("average_bootstraps", with_views("bootstraps", f"SELECT {KEY_SQL}, rater_id, round(avg(value), 6) AS value FROM bootstraps GROUP BY ALL"))
def average_bootstraps(spark, sf):
    return rounded(A.average_bootstraps(W.bootstraps(spark, sf)))


@query("prefix_average", with_views("bootstraps", f"""SELECT {KEY_SQL}, rater_id, CAST(x AS INTEGER) AS x, round(avg(value), 6) AS value
 FROM bootstraps JOIN (SELECT unnest(range(1, 8)) AS x) ON bootstrap_id < x GROUP BY ALL"""))
def prefix_average(spark, sf):
    return rounded(A.prefix_average(W.bootstraps(spark, sf), W.BOOTSTRAPS))


_BY_RUN = f"SELECT b, scope, lang, metric FROM (SELECT DISTINCT b FROM pairs) CROSS JOIN ({DOMAIN})"
_BOOT_PAIRS = f"{GOLD},\npairs AS MATERIALIZED (SELECT p.bootstrap_id AS b, g.dataset, g.lang, g.metric, g.value AS x, p.value AS y FROM gold g JOIN bootstraps p ON {ON_KEY})"


@query("per_bootstrap_scores", with_views("ratings bootstraps", f"SELECT b AS bootstrap_id, scope, lang, metric, stat, {r6('value')} FROM s_scores",
                                          _BOOT_PAIRS + "," + rollup_ctes("pairs", _BY_RUN, ["b"])))
def per_bootstrap_scores(spark, sf):
    return rounded(E.per_bootstrap_scores(W.ratings(spark, sf), W.bootstraps(spark, sf), lang_metrics=W.LANG_METRICS, datasets=W.DATASETS))


PREFIX_X = W.BOOTSTRAPS
_PREFIX_PAIRS = f"""{GOLD},
averaged AS MATERIALIZED (SELECT {KEY_SQL}, CAST(x AS INTEGER) AS b, list_reduce(list(value ORDER BY bootstrap_id), lambda s, v: s + v) / count(*) AS value FROM bootstraps JOIN (SELECT unnest(range(1, {PREFIX_X + 1})) AS x) ON bootstrap_id < x GROUP BY ALL),
pairs AS MATERIALIZED (SELECT p.b, g.dataset, g.lang, g.metric, g.value AS x, p.value AS y FROM gold g JOIN averaged p ON {ON_KEY})"""


def _prefix(spark, sf):
    return E.prefix_scores(W.ratings(spark, sf), W.bootstraps(spark, sf), PREFIX_X, lang_metrics=W.LANG_METRICS, datasets=W.DATASETS)


@query("prefix_scores", with_views("ratings bootstraps", f"SELECT b AS x, scope, lang, metric, stat, {r6('value')} FROM s_scores",
                                   _PREFIX_PAIRS + "," + rollup_ctes("pairs", _BY_RUN, ["b"])))
def prefix_scores(spark, sf):
    return rounded(_prefix(spark, sf))


@query("select_prefix", with_views("ratings bootstraps", f"SELECT b AS x, round(avg(value), 6) AS average FROM s_scores WHERE scope = 'ALL' AND metric = 'ALL' GROUP BY b ORDER BY avg(value) DESC, b LIMIT 1",
                                   _PREFIX_PAIRS + "," + rollup_ctes("pairs", _BY_RUN, ["b"])))
def select_prefix(spark, sf):
    """Number of runs worth keeping; the two languages play the two contexts."""
    totals = R.headline_scores(_prefix(spark, sf)).filter(F.col("metric") == "ALL")
    return rounded(A.select_prefix(totals), "average")


@query("mean_of_fold_scores", with_views("bootstraps", "SELECT metric, round(avg(v), 6) AS value FROM (SELECT metric, bootstrap_id, avg(value) AS v FROM bootstraps GROUP BY ALL) GROUP BY metric"))
def mean_of_fold_scores(spark, sf):
    per_fold = W.bootstraps(spark, sf).groupBy("metric", F.col("bootstrap_id").alias("fold")).agg(F.avg("value").alias("value"))
    return rounded(A.mean_of_fold_scores(per_fold))


@query("average_folds", with_views("bootstraps", f"SELECT {KEY_SQL}, round(avg(value), 6) AS value, count(value) AS folds FROM bootstraps GROUP BY ALL"))
def average_folds(spark, sf):
    return rounded(A.average_folds(W.bootstraps(spark, sf).withColumnRenamed("bootstrap_id", "fold")))


# ---------------------------------------------------------------- sources, ensembles, tables

METHODS = ["plain", "square", "mixed"]
SRC = "context, split, method"
_SRC_PAIRS = f"{GOLD},\npairs AS MATERIALIZED (SELECT p.context, p.split, p.method, g.dataset, g.lang, g.metric, g.value AS x, p.value AS y FROM gold g JOIN sources p ON {ON_KEY})"
_SRC_DOMAIN = f"SELECT {SRC}, scope, lang, metric FROM (SELECT DISTINCT {SRC} FROM pairs) CROSS JOIN ({DOMAIN})"
_SRC_SCORES = _SRC_PAIRS + "," + rollup_ctes("pairs", _SRC_DOMAIN, ["context", "split", "method"])
_MAP = """source_map AS (SELECT context, metric, method FROM (SELECT context, metric, method, row_number() OVER (PARTITION BY context, metric
 ORDER BY coalesce(value, '-infinity'::DOUBLE) DESC, list_position(['plain','square','mixed'], method)) AS r FROM s_scores
 WHERE split = 'dev' AND scope = 'ALL' AND stat = 'mean' AND lang = 'en' AND metric <> 'ALL') WHERE r = 1)"""


def _scores(spark, sf):
    return P.score_sources(W.sources(spark, sf), W.ratings(spark, sf), W.LANG_METRICS, W.DATASETS)


@query("score_sources", with_views("ratings sources", f"SELECT {SRC}, scope, lang, metric, stat, {r6('value')} FROM s_scores", _SRC_SCORES))
def score_sources(spark, sf):
    """All sources scored in one plan."""
    return rounded(_scores(spark, sf))


@query("best_source", with_views("ratings sources", "SELECT * FROM source_map", _SRC_SCORES + ",\n" + _MAP))
def best_source(spark, sf):
    return P.dev_source_map(_scores(spark, sf), METHODS)


@query("metricwise_ensemble", with_views("ratings sources", f"""SELECT p.context, p.split, 'metricwise_ensemble' AS method, {', '.join('p.' + k for k in KEY)},
 'dev_selected_metricwise_' || p.context AS rater_id, p.value FROM sources p JOIN source_map s ON p.context = s.context AND p.metric = s.metric AND p.method = s.method WHERE p.lang = 'en'""",
                                         _SRC_SCORES + ",\n" + _MAP))
def metricwise_ensemble(spark, sf):
    chosen = P.dev_source_map(_scores(spark, sf), METHODS)
    return P.metricwise_ensemble(W.sources(spark, sf).filter(F.col("lang") == "en"), chosen).select(*P.SOURCE, *KEY, "rater_id", "value")


@query("leaderboard", with_views("ratings sources", f"""SELECT {SRC}, round(max(value) FILTER (metric = 'ALL'), 6) + 0 AS all_mean, round(max(value) FILTER (metric = 'completeness'), 6) + 0 AS completeness,
 round(max(value) FILTER (metric = 'relevance'), 6) + 0 AS relevance, round(max(value) FILTER (metric = 'disagree_flag'), 6) + 0 AS disagree_flag,
 CAST(list_position(['square','plain'], method) AS BIGINT) AS p FROM s_scores WHERE scope = 'ALL' AND stat = 'mean' AND lang = 'en' GROUP BY ALL""", _SRC_SCORES).replace(
    "CAST(list_position(['square','plain'], method) AS BIGINT) AS p", "CAST(CASE method WHEN 'square' THEN 0 WHEN 'plain' THEN 1 ELSE 999 END AS BIGINT) AS method_order"))
def leaderboard(spark, sf):
    board = P.leaderboard(_scores(spark, sf), W.METRICS)
    return rounded(P.order_methods(board, ["square", "plain"]), "all_mean", *W.METRICS)


@query("mark_best", with_views("ratings sources", f"""SELECT t.context, t.split, t.method, t.metric, {r6('value')}, abs(value - top) < 1e-12 AS is_best, s.method IS NOT NULL AS is_selected
 FROM (SELECT *, max(value) OVER (PARTITION BY context, split, metric) AS top FROM s_scores WHERE scope = 'ALL' AND stat = 'mean' AND lang = 'en') t
 LEFT JOIN source_map s ON t.context = s.context AND t.metric = s.metric AND t.method = s.method""", _SRC_SCORES + ",\n" + _MAP))
def mark_best(spark, sf):
    scores = _scores(spark, sf)
    rows = R.headline_scores(scores).filter(F.col("lang") == "en").drop("scope", "stat", "lang")
    return rounded(P.mark_best(rows, P.dev_source_map(scores, METHODS)))


@query("main_results", with_views("ratings sources", f"""SELECT {SRC}, round(max(value) FILTER (metric = 'ALL'), 6) + 0 AS all_mean, round(max(value) FILTER (metric = 'completeness'), 6) + 0 AS completeness,
 round(max(value) FILTER (metric = 'relevance'), 6) + 0 AS relevance, round(max(value) FILTER (metric = 'disagree_flag'), 6) + 0 AS disagree_flag
 FROM (SELECT * FROM s_scores UNION ALL SELECT * FROM e_scores) WHERE scope = 'ALL' AND stat = 'mean' AND lang = 'en' GROUP BY ALL""",
    _SRC_SCORES + ",\n" + _MAP + f""",
epairs AS MATERIALIZED (SELECT p.context, p.split, 'metricwise_ensemble' AS method, g.dataset, g.lang, g.metric, g.value AS x, p.value AS y FROM gold g JOIN sources p ON {ON_KEY}
  JOIN source_map s ON p.context = s.context AND p.metric = s.metric AND p.method = s.method WHERE p.lang = 'en'),"""
    + rollup_ctes("epairs", f"SELECT {SRC}, scope, lang, metric FROM (SELECT DISTINCT {SRC} FROM epairs) CROSS JOIN ({domain_sql({'en': W.METRICS})})", ["context", "split", "method"], "e")))
def main_results(spark, sf):
    """Normalise, score, choose on dev, ensemble, score again, one table."""
    out = P.main_results(W.sources(spark, sf), W.ratings(spark, sf), METHODS, W.LANG_METRICS, W.DATASETS)
    return rounded(out["leaderboard"], "all_mean", *W.METRICS)


@query("normalize_sources", with_views("sources", f"SELECT {SRC}, {KEY_SQL}, rater_id, value FROM sources"))
def normalize_sources(spark, sf):
    """Every row delivered twice comes back once."""
    twice = W.sources(spark, sf).withColumn("_pos", F.explode(F.array(F.lit(1), F.lit(2))))
    return P.normalize_sources(twice)[0]


@query("source_problems", with_views("sources", f"SELECT {SRC}, 'conflicting values' AS problem, count(DISTINCT encounter_id || '/' || candidate_author_id || metric) AS n FROM sources WHERE method = 'mixed' AND value <> 0 GROUP BY ALL"))
def source_problems(spark, sf):
    """One method comes with a second, different value wherever it is not 0."""
    both = W.sources(spark, sf)
    other = both.filter((F.col("method") == "mixed") & (F.col("value") != 0)).withColumn("value", -F.col("value"))
    return P.normalize_sources(both.unionByName(other))[1]


@query("ablation_table", with_views("ratings sources", f"""SELECT {SRC}, round(max(value) FILTER (metric = 'ALL'), 6) + 0 AS all_mean, round(max(value) FILTER (metric = 'completeness'), 6) + 0 AS completeness,
 round(max(value) FILTER (metric = 'relevance'), 6) + 0 AS relevance, round(max(value) FILTER (metric = 'disagree_flag'), 6) + 0 AS disagree_flag,
 CAST(CASE method WHEN 'mixed' THEN 0 ELSE 1 END AS BIGINT) AS method_order FROM s_scores WHERE scope = 'ALL' AND stat = 'mean' AND lang = 'en' AND method IN ('mixed','plain') GROUP BY ALL""", _SRC_SCORES))
def ablation_table(spark, sf):
    return rounded(P.ablation_table(W.sources(spark, sf), W.ratings(spark, sf), ["mixed", "plain"], W.LANG_METRICS, W.DATASETS), "all_mean", *W.METRICS)


@query("provenance", with_views("sources", f"SELECT {SRC}, CAST(sum(count(*)) OVER (PARTITION BY {SRC}) AS BIGINT) AS rows, metric, count(*) AS n FROM sources GROUP BY {SRC}, metric"))
def provenance(spark, sf):
    out = P.provenance(W.sources(spark, sf))
    return out.select(*P.SOURCE, "rows", F.explode("metric_counts").alias("metric", "n"))


@query("apply_overrides", with_views("sources", """SELECT context, split, method, CASE WHEN context = 'with_gold' AND split = 'dev' AND method = 'plain' THEN 'new/path' ELSE context || '/' || split || '/' || method END AS path,
 CASE WHEN context = 'with_gold' AND split = 'dev' AND method = 'plain' THEN 'New' WHEN method = 'mixed' AND split = 'test' AND context = 'without_gold' THEN 'Mixed' ELSE method END AS label
 FROM (SELECT DISTINCT context, split, method FROM sources)"""))
def apply_overrides(spark, sf):
    specs = W.sources(spark, sf).select(*P.SOURCE).distinct().withColumn("path", F.concat_ws("/", *P.SOURCE)).withColumn("label", F.col("method"))
    config = {"with_gold": {"dev": {"plain": {"path": "new/path", "label": "New"}}}, "without_gold": {"test": {"mixed": {"label": "Mixed"}}}}
    return P.apply_overrides(specs, P.overrides_table(spark, config))


@query("check_complete", "SELECT 'without_gold' AS context, 'test' AS split, 'extra' AS method, 'missing' AS problem")
def check_complete(spark, sf):
    have = W.sources(spark, sf).select(*P.SOURCE).distinct()
    return V.check_complete(have, have.unionByName(spark.createDataFrame([("without_gold", "test", "extra")], have.schema)))


@query("complete_contexts", "SELECT * FROM (VALUES ('with_gold', true), ('without_gold', false)) v(context, complete)")
def complete_contexts(spark, sf):
    return V.complete_contexts(W.sources(spark, sf).select(*P.SOURCE).distinct(), {"with_gold": METHODS, "without_gold": [*METHODS, "fourth"]})
