"""From many prediction sources to ensembles, leaderboards and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.functions.values import no_nan
from ratemill.operators.aggregate import best_source
from ratemill.operators.relational import first_rows
from ratemill.operators.validate import find_conflicts, require_columns
from ratemill.plans.evaluate import run_scores
from ratemill.schema import DATASETS, KEY, LANG_METRICS, OUTPUT_COLUMNS
from ratemill.session import cut_lineage

SOURCE = ["context", "split", "method"]
ENSEMBLE = "metricwise_ensemble"
TOLERANCE = 1e-12
UNKNOWN_ORDER = 999


def apply_overrides(specs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Spec rows with path and label replaced where an override gives one."""
    values = [c for c in overrides.columns if c not in SOURCE]
    new = overrides.select(*SOURCE, *[F.col(c).alias(f"_{c}") for c in values])
    out = specs.join(new, SOURCE, "left")
    for c in values:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*specs.columns)


def overrides_table(spark, config: Mapping) -> DataFrame:
    """Nested context -> split -> method -> {path, label} as rows."""
    rows = [(c, s, m, o.get("path"), o.get("label")) for c, splits in config.items() for s, methods in splits.items()
            for m, o in methods.items()]
    return spark.createDataFrame(rows, "context string, split string, method string, path string, label string")


def normalize_sources(stacked: DataFrame, expected: DataFrame | None = None, order: str | Column = "_pos") -> tuple[DataFrame, DataFrame]:
    """Checked and deduplicated predictions of all sources at once, and one report
    row per problem. Sources with a problem are left out of the first result.

    ``stacked`` has context, split, method and the output columns; ``expected``
    has split, metric, expected.
    """
    require_columns(stacked, [*SOURCE, *OUTPUT_COLUMNS])
    # A digest goes first in the sort: its leading bytes tell rows apart, those of ten texts do not. Source and
    # key stay beside it, so that rows already dealt by some of them are not shuffled.
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in [*SOURCE, *KEY]]
    keyed = stacked.withColumn("_row", F.unhex(F.md5(F.concat_ws("\x1f", *parts))))
    conflicts = find_conflicts(stacked, [*SOURCE, *KEY]).groupBy(*SOURCE).agg(F.count("*").alias("n")).select(
        *SOURCE, F.lit("conflicting values").alias("problem"), "n")
    place = [F.col(order) if isinstance(order, str) and order in stacked.columns else
             (order if isinstance(order, Column) else F.col("value"))]
    first = first_rows(keyed, ["_row", *SOURCE, *KEY], place).select(*SOURCE, *OUTPUT_COLUMNS)
    problems = conflicts
    if expected is not None:
        got = first.groupBy(*SOURCE, "metric").agg(F.count("*").alias("actual"))
        wanted = stacked.select(*SOURCE).distinct().join(expected, "split")
        off = got.join(wanted, [*SOURCE, "metric"], "full_outer").filter(
            F.coalesce("actual", F.lit(0)) != F.coalesce("expected", F.lit(0)))
        problems = problems.unionByName(off.groupBy(*SOURCE).agg(F.count("*").alias("n")).select(
            *SOURCE, F.lit("wrong row count").alias("problem"), "n"))
    # As many rows as sources; a join by source would deal all predictions to a few tasks.
    return first.join(F.broadcast(problems.select(*SOURCE).distinct()), SOURCE, "left_anti"), problems


def score_sources(predictions: DataFrame, gold: DataFrame, lang_metrics: Mapping[str, Sequence[str]] = LANG_METRICS,
                  datasets: Sequence[str] = tuple(DATASETS), listed: DataFrame | None = None) -> DataFrame:
    """Score tables of all sources in one plan. The gold keys of another split
    match nothing, so one gold table serves all splits. ``listed`` may name a table with all sources."""
    return run_scores(gold, predictions, SOURCE, lang_metrics, datasets, listed)


def dev_source_map(scores: DataFrame, methods: Sequence[str], lang: str = "en") -> DataFrame:
    """Best method per context and metric on the dev split; the earlier one in
    ``methods`` on ties."""
    listed = F.array(*[F.lit(m) for m in methods])
    dev = scores.filter((F.col("split") == "dev") & (F.col("scope") == "ALL") & (F.col("stat") == "mean")
                        & (F.col("lang") == lang) & (F.col("metric") != "ALL") & F.col("method").isin(list(methods)))
    ranked = dev.withColumn("source_order", F.array_position(listed, F.col("method")))
    return best_source(ranked, ["context", "metric"]).select("context", "metric", "method")


def metricwise_ensemble(predictions: DataFrame, source_map: DataFrame, prefix: str = "dev_selected_metricwise_") -> DataFrame:
    """For each metric the rows of its chosen source, on every split. The map has
    one row per context and metric and is sent to all tasks."""
    chosen = predictions.join(F.broadcast(source_map), ["context", "metric", "method"])
    return chosen.withColumn("rater_id", F.concat(F.lit(prefix), F.col("context"))).withColumn("method", F.lit(ENSEMBLE))


def order_methods(df: DataFrame, order: Sequence[str], column: str = "method") -> DataFrame:
    """Adds ``method_order``: place in the display order, 999 for others."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(column))
    return df.withColumn("method_order", F.when(place > 0, place - 1).otherwise(UNKNOWN_ORDER).cast("long"))


def leaderboard(scores: DataFrame, metrics: Sequence[str], lang: str = "en", by: Sequence[str] = tuple(SOURCE)) -> DataFrame:
    """One row per method, one column per metric mean and ``all_mean``."""
    rows = scores.filter((F.col("scope") == "ALL") & (F.col("stat") == "mean") & (F.col("lang") == lang))
    pick = [F.max(F.when(F.col("metric") == m, no_nan("value"))).alias(m.replace("-", "_")) for m in metrics]
    return rows.groupBy(*by).agg(F.max(F.when(F.col("metric") == "ALL", no_nan("value"))).alias("all_mean"), *pick)


def mark_best(scores: DataFrame, source_map: DataFrame | None = None, by: Sequence[str] = ("context", "split", "metric")) -> DataFrame:
    """Adds ``is_best`` (within 1e-12 of the best single source) and ``is_selected``."""
    single = F.col("method") != ENSEMBLE
    value = no_nan("value")
    top = F.max(F.when(single, value)).over(Window.partitionBy(*by))
    out = scores.withColumn("is_best", F.coalesce(single & (F.abs(value - top) < TOLERANCE), F.lit(False)))
    if source_map is None:
        return out
    chosen = source_map.select("context", "metric", "method", F.lit(True).alias("_chosen"))
    return out.join(F.broadcast(chosen), ["context", "metric", "method"], "left").withColumn(
        "is_selected", F.coalesce("_chosen", F.lit(False))).drop("_chosen")


def provenance(predictions: DataFrame, by: Sequence[str] = tuple(SOURCE)) -> DataFrame:
    """Rows and rows per metric of every source."""
    counts = predictions.groupBy(*by, "metric").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "n")))).alias("metric_counts"))


def pool_sizes(pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Example items (outside) and target items (inside) of every fold."""
    per_fold = pool.select(*keys, "fold").distinct().groupBy("fold").agg(F.count("*").alias("infer_items"))
    total = F.sum("infer_items").over(Window.partitionBy())
    return per_fold.withColumn("shot_items", total - F.col("infer_items"))


def main_results(stacked: DataFrame, gold: DataFrame, methods: Sequence[str], lang_metrics: Mapping[str, Sequence[str]] = LANG_METRICS,
                 datasets: Sequence[str] = tuple(DATASETS), lang: str = "en", expected: DataFrame | None = None) -> dict[str, DataFrame]:
    """Normalise, score, select on dev, build the ensemble, score that too."""
    predictions, problems = normalize_sources(stacked, expected)
    # A few rows, read before anything is checked or chosen.
    listed = cut_lineage(stacked.select(*SOURCE).distinct())
    scores = score_sources(predictions, gold, lang_metrics, datasets, listed)
    source_map = dev_source_map(scores, methods, lang)
    ensemble = metricwise_ensemble(predictions.filter(F.col("lang") == lang), source_map)
    all_scores = scores.unionByName(score_sources(ensemble, gold, {lang: lang_metrics[lang]}, datasets, listed.withColumn("method", F.lit(ENSEMBLE))))
    return {"predictions": predictions, "problems": problems, "scores": all_scores, "source_map": source_map,
            "ensemble": ensemble, "leaderboard": leaderboard(all_scores, lang_metrics[lang], lang)}


def ablation_table(stacked: DataFrame, gold: DataFrame, strategies: Sequence[str], lang_metrics: Mapping[str, Sequence[str]] = LANG_METRICS,
                   datasets: Sequence[str] = tuple(DATASETS), lang: str = "en") -> DataFrame:
    """One leaderboard row per selection strategy, in the given order."""
    wanted = stacked.filter(F.col("method").isin(list(strategies)))
    predictions, _ = normalize_sources(wanted)
    board = leaderboard(score_sources(predictions, gold, lang_metrics, datasets, wanted), lang_metrics[lang], lang)
    return order_methods(board, strategies)
