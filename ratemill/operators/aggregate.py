"""Grouped aggregates over ratings and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.functions.values import no_nan
from ratemill.operators.relational import first_rows
from ratemill.schema import ITEM_KEY, KEY

PER_RUN = ["value", "bootstrap_id", "fold", "_pos"]


def average_raters(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean rating per key; missing keys form a group, missing ratings are skipped."""
    return df.groupBy(*keys).agg(F.avg(no_nan("value")).alias("value"))


def average_bootstraps(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean over repeated runs; by default every other column is part of the key."""
    keys = list(keys) if keys else [c for c in df.columns if c not in PER_RUN]
    return df.groupBy(*keys).agg(F.avg(no_nan("value")).alias("value"))


def prefix_means(df: DataFrame, max_x: int, keys: Sequence[str]) -> DataFrame:
    """One row per key with ``means``: an array of (x, value), the mean of the runs with
    ``bootstrap_id < x`` for x = 1..max_x where there are any rows.

    The shuffle carries one sum and two counts per run and key; running sums follow it, added
    in the order of the runs.
    """
    run, v = F.col("bootstrap_id"), no_nan("value")
    per_run = [agg for i in range(max_x) for agg in (
        F.sum(F.when(run == i, v)).alias(f"_s{i}"), F.count(F.when(run == i, v)).alias(f"_n{i}"), F.count_if(run == i).alias(f"_r{i}"))]
    known = df.filter((run >= 0) & (run < max_x)).groupBy(*keys).agg(*per_run)
    total, n, rows, means = F.lit(0.0), F.lit(0), F.lit(0), []
    for i in range(max_x):
        # Columns of their own, so that a later prefix does not add up the earlier ones again.
        known = known.withColumns({f"_s{i}": total + F.coalesce(f"_s{i}", F.lit(0.0)), f"_n{i}": n + F.col(f"_n{i}"), f"_r{i}": rows + F.col(f"_r{i}")})
        total, n, rows = F.col(f"_s{i}"), F.col(f"_n{i}"), F.col(f"_r{i}")
        means.append(F.when(rows > 0, F.struct(F.lit(i + 1).alias("x"), F.try_divide(total, n).alias("value"))))
    return known.select(*keys, F.array_compact(F.array(*means)).alias("means"))


def prefix_average(df: DataFrame, max_x: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean of the runs with ``bootstrap_id < x`` for x = 1..max_x, in one shuffle."""
    keys = list(keys) if keys else [c for c in df.columns if c not in PER_RUN]
    return prefix_means(df, max_x, keys).select(*keys, F.inline("means"))


def average_folds(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean over fold models; a key may be absent from some folds."""
    return df.groupBy(*keys).agg(F.avg(no_nan("value")).alias("value"), F.count("value").alias("folds"))


def mean_of_fold_scores(scores: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Unweighted mean over folds; nothing to average gives null."""
    return scores.groupBy(*by).agg(F.avg(no_nan("value")).alias("value"))


def group_items(df: DataFrame, keys: Sequence[str] = ITEM_KEY, texts: Sequence[str] = (), null_keys: str = "keep",
                order: Sequence[str] = ("metric",), label: str = "label") -> DataFrame:
    """One row per item with its labels as a map from metric to rating.

    An item has few metrics, so the map stays small. Of several rows for one
    metric the first in ``order`` counts; of the texts, the first one overall.
    ``null_keys="drop"`` loses items with a missing key column.
    """
    if null_keys == "drop":
        df = df.na.drop(subset=list(keys))
    elif null_keys != "keep":
        raise ValueError("null_keys is 'keep' or 'drop'")
    place = F.struct(*[F.col(c) for c in order], F.col(label))
    per_metric = df.groupBy(*keys, "metric").agg(
        F.min(place).alias("_first"), F.min_by(F.col(label), place).alias("_label"),
        *[F.min_by(F.col(t), place).alias(t) for t in texts],
    )
    return per_metric.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "_label")))).alias("labels"),
        *[F.min_by(F.col(t), F.struct("_first", "metric")).alias(t) for t in texts],
    )


def group_columns(df: DataFrame, exclude: Sequence[str] = ("metric", "label", "query_text", "gold_texts", "candidate")) -> list[str]:
    """Key = every column but these, for callers that want the loose grouping."""
    return [c for c in df.columns if c not in exclude]


def labels_by_metric(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ITEM_KEY, label: str = "label",
                     order: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items with one column per metric, items that lack a metric)."""
    place = F.struct(F.col(order) if isinstance(order, str) else order, F.col(label)) if order is not None else F.col(label)
    wide = df.groupBy(*keys).agg(
        *[F.min_by(F.when(F.col("metric") == m, F.col(label)), F.when(F.col("metric") == m, place)).alias(m) for m in metrics]
    )
    present = None
    for m in metrics:
        present = F.col(f"`{m}`").isNotNull() if present is None else present & F.col(f"`{m}`").isNotNull()
    absent = F.array_compact(F.array(*[F.when(F.col(f"`{m}`").isNull(), F.lit(m)) for m in metrics]))
    return wide.filter(present), wide.filter(~present).select(*keys, absent.alias("missing_metrics"))


def agreement_keys(df: DataFrame, metrics: Sequence[str], threshold: float, keys: Sequence[str] = ITEM_KEY) -> DataFrame:
    """Items whose every metric has at most one rating, or two that differ by at
    most ``threshold``; three or more ratings rule the item out."""
    v = no_nan("value")
    per_metric = (
        df.filter(F.col("metric").isin(list(metrics)))
        .groupBy(*keys, "metric")
        .agg(F.count(v).alias("n"), (F.max(v) - F.min(v)).alias("gap"))
    )
    fine = (F.col("n") <= 1) | ((F.col("n") == 2) & (F.col("gap") <= threshold))
    return per_metric.groupBy(*keys).agg(F.bool_and(fine).alias("_ok")).filter("_ok").drop("_ok")


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, column).agg(F.count("*").alias("n"))


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def nunique(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(column).alias("n"))


def best_source(scores: DataFrame, by: Sequence[str] = ("context", "metric"), score: str = "value",
                order: str = "source_order") -> DataFrame:
    """Best source per metric; a missing score loses to any number, ties go to
    the source listed first."""
    value = F.coalesce(no_nan(score), F.lit(float("-inf")))
    return first_rows(scores, by, [value.desc(), F.col(order)])


def select_prefix(scores: DataFrame, x: str = "x", score: str = "value") -> DataFrame:
    """The x with the best mean over contexts; the smallest x on ties. One row."""
    mean = F.avg(no_nan(score))
    return (
        scores.groupBy(x).agg(mean.alias("average"))
        .orderBy(F.coalesce("average", F.lit(float("-inf"))).desc(), x)
        .limit(1)
    )


def first_per_combo(items: DataFrame, metrics: Sequence[str], values: Sequence[float] = (0.0, 0.5, 1.0),
                    by: Sequence[str] = ("dataset",), order: Sequence[str] = ("encounter_id", "candidate_author_id")) -> DataFrame:
    """First item for each combination of the label values of these metrics."""
    allowed = items
    for m in metrics:
        allowed = allowed.filter(F.col(f"`{m}`").isin([float(v) for v in values]))
    return first_rows(allowed, [*by, *[f"`{m}`" for m in metrics]], order)


def combo_shots(items: DataFrame, k: int, metrics: Sequence[str], values: Sequence[float] = (0.0, 0.5, 1.0),
                datasets: Sequence[str] = (), order: Sequence[str] = ("encounter_id", "candidate_author_id")) -> DataFrame:
    """The first ``k`` combinations in fixed order (data set, then values).

    At most ``len(datasets) * len(values) ** len(metrics)`` rows exist, so the
    final limit is a small sort. Fewer than ``k`` is an error (runs a job).
    """
    firsts = first_per_combo(items, metrics, values, order=order)
    if datasets:
        firsts = firsts.filter(F.col("dataset").isin(list(datasets))).withColumn(
            "_d", F.array_position(F.array(*[F.lit(d) for d in datasets]), F.col("dataset")))
    else:
        firsts = firsts.withColumn("_d", F.col("dataset"))
    picked = firsts.orderBy("_d", *[f"`{m}`" for m in metrics]).limit(k).drop("_d")
    found = picked.count()
    if found < k:
        raise ValueError(f"only {found} combinations exist, {k} were asked for")
    return picked


def bin_coverage(df: DataFrame, bin_column: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """Observed (metric, bin) pairs with their counts."""
    return df.groupBy(*by, "metric", bin_column).agg(F.count("*").alias("n"))


def missing_bins(picked: DataFrame, pool: DataFrame, bin_column: str = "bin") -> DataFrame:
    """Bins seen in the pool but not among the picked items."""
    keys = ["metric", bin_column]
    return pool.select(*keys).distinct().join(picked.select(*keys).distinct(), keys, "left_anti")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro F1 over the classes seen as label or as prediction."""
    cells = df.groupBy(*by, label, prediction).agg(F.count("*").alias("n"))
    sides = cells.select(*by, "n", F.explode(F.array(
        F.struct(F.col(label).alias("cls"), F.lit(1).alias("is_label"), (F.col(label) == F.col(prediction)).alias("hit")),
        F.struct(F.col(prediction).alias("cls"), F.lit(0).alias("is_label"), F.lit(False).alias("hit")),
    )).alias("s"))
    per_class = sides.groupBy(*by, F.col("s.cls").alias("cls")).agg(
        F.sum(F.when(F.col("s.hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support_and_predicted"),
        F.sum(F.when(F.col("s.is_label") == 1, F.col("n")).otherwise(0)).alias("support"),
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support_and_predicted")), F.lit(0.0))
    return per_class.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("f1_macro"), F.sum("support").alias("rows")
    )
