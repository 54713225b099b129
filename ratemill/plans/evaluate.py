"""Score tables: predictions against human ratings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.functions.values import no_nan
from ratemill.operators.aggregate import average_raters, prefix_means
from ratemill.operators.correlate import correlations
from ratemill.operators.relational import join_gold_auto
from ratemill.schema import DATASETS, KEY, LANG_METRICS


def short_candidate(df: DataFrame) -> DataFrame:
    """Digest in place of the answer text inside keys: equal texts stay equal, and a
    shuffle carries 64 characters instead of the whole answer."""
    return df.withColumn("candidate", F.sha2("candidate", 256))


#: What ratings are paired by: the columns that a score table has, and a digest of the whole key.
#: The digest comes first, so that sorts tell rows apart by its leading bytes.
SHORT_KEY = ["_key", "dataset", "lang", "metric"]


def short_key(df: DataFrame) -> DataFrame:
    """``_key``: 16 bytes for the whole key, answer text included; missing parts are parts of their own.

    No column of SHORT_KEY is null after it, so that plain equality pairs missing keys too.
    """
    parts = [F.coalesce(F.col(c), F.lit("\0")) for c in [*(k for k in KEY if k != "candidate"), "candidate"]]
    named = {c: F.coalesce(F.col(c), F.lit("\0")) for c in SHORT_KEY if c != "_key"}
    return df.withColumns({"_key": F.unhex(F.md5(F.concat_ws("\x1f", *parts))), **named})


def join_short(human: DataFrame, auto: DataFrame) -> DataFrame:
    """Ratings paired by SHORT_KEY, ``value_x`` and ``value_y``. Tables that are dealt by SHORT_KEY already are not shuffled again."""
    return human.select(*SHORT_KEY, F.col("value").alias("value_x")).join(auto.withColumnRenamed("value", "value_y"), SHORT_KEY)


def pair_ratings(gold: DataFrame, auto: DataFrame, order: Column | str | None = None,
                 keys: Sequence[str] = KEY) -> DataFrame:
    """One row per key that both tables hold: mean human rating and first prediction.

    Both tables are stacked and grouped once, so there is a single shuffle with
    partial aggregation; a key that repeats very often cannot pile up in a task,
    and missing keys match each other as group values do.
    """
    if order is None:
        order = F.col("_pos") if "_pos" in auto.columns else F.col("value")
    order = F.col(order) if isinstance(order, str) else order
    human = gold.select(*keys, no_nan("value").alias("_x"), F.lit(None).cast("double").alias("_y"),
                        F.lit(None).alias("_order"), F.lit(True).alias("_human"))
    machine = auto.select(*keys, F.lit(None).cast("double").alias("_x"), no_nan("value").alias("_y"),
                          order.alias("_order"), F.lit(False).alias("_human"))
    return (
        human.unionByName(machine)
        .groupBy(*keys)
        .agg(
            F.avg("_x").alias("value_x"),
            F.min_by("_y", F.col("_order")).alias("value_y"),
            F.bool_or("_human").alias("_has_x"),
            F.bool_or(~F.col("_human")).alias("_has_y"),
        )
        .filter(F.col("_has_x") & F.col("_has_y"))
        .drop("_has_x", "_has_y")
    )


def domain_array(lang_metrics: Mapping[str, Sequence[str]], datasets: Sequence[str]) -> Column:
    return F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit(lang).alias("lang"), F.lit(metric).alias("metric"))
        for lang, metrics in lang_metrics.items() for metric in metrics for scope in ["ALL", *datasets]
    ])


def score_rollup(pairs: DataFrame, lang_metrics: Mapping[str, Sequence[str]] = LANG_METRICS,
                 datasets: Sequence[str] = tuple(DATASETS), by: Sequence[str] = (), nan_policy: str = "omit") -> DataFrame:
    """Long score table (by…, scope, lang, metric, stat, value) from paired ratings.

    Every (scope, language, metric) of the domain appears, with NaN where there
    is nothing to correlate; data sets outside the domain count in ALL only.
    """
    if nan_policy not in ("omit", "propagate"):
        raise ValueError("nan_policy is 'omit' or 'propagate'")
    by = list(by)
    metrics = sorted({m for ms in lang_metrics.values() for m in ms})
    wanted = pairs.filter(F.col("lang").isin(list(lang_metrics)) & F.col("metric").isin(metrics))
    counted = wanted.groupBy(*by, "dataset", "lang", "metric", "value_x", "value_y").agg(F.count("*").alias("n"))
    scopes = F.when(F.col("dataset").isin(list(datasets)), F.array(F.lit("ALL"), F.col("dataset"))).otherwise(
        F.array(F.lit("ALL")))
    scoped = counted.withColumn("scope", F.explode(scopes))
    stats = correlations(scoped, [*by, "scope", "lang", "metric"], "value_x", "value_y", "n")
    # All statistics of a run in one row, so that the domain is looked up and the grouped pass runs once.
    place = F.concat_ws("\x1f", "scope", "lang", "metric")
    table = stats.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(place, F.struct("kendalltau", "pearson", "spearman")))).alias("_m"))
    full = table.select(*by, "_m", F.inline(domain_array(lang_metrics, datasets))).withColumn("_s", F.try_element_at("_m", place))
    three = [F.coalesce(F.col(f"_s.{c}"), F.lit(float("nan"))) for c in ("kendalltau", "pearson", "spearman")]
    mean = nan_mean(three) if nan_policy == "omit" else (three[0] + three[1] + three[2]) / 3.0
    rows = [F.struct(F.col("metric").alias("metric"), F.lit(name).alias("stat"), value.alias("value"))
            for name, value in zip(("kendalltau", "pearson", "spearman", "mean"), [*three, mean])]
    # The mean over metrics is a fifth row of every metric, and all others are groups of one.
    part = F.struct(F.lit("ALL").alias("metric"), F.lit("mean").alias("stat"), (no_nan(mean) if nan_policy == "omit" else mean).alias("value"))
    listed = F.array(*rows)
    spread = full.select(*by, "scope", "lang", F.inline(F.when(F.col("scope") == "ALL", F.concat(listed, F.array(part))).otherwise(listed)))
    return spread.groupBy(*by, "scope", "lang", "metric", "stat").agg(F.coalesce(F.avg("value"), F.lit(float("nan"))).alias("value"))


def nan_mean(values: Sequence[Column]) -> Column:
    kept = F.array_compact(F.array(*[no_nan(v) for v in values]))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(float("nan")))


def evaluate(gold: DataFrame, auto: DataFrame, lang_metrics: Mapping[str, Sequence[str]] = LANG_METRICS,
             datasets: Sequence[str] = tuple(DATASETS), order: Column | str | None = None,
             multi_rater: str = "mean", nan_policy: str = "omit") -> DataFrame:
    """Full score table of one prediction table.

    ``multi_rater="mean"`` averages the raters of a key; "expand" pairs every
    rater with the prediction, as the strict evaluation does.
    """
    gold, auto = short_key(gold), short_key(auto)
    if multi_rater == "mean":
        pairs = pair_ratings(gold, auto, order, SHORT_KEY)
    elif multi_rater == "expand":
        first = average_first(auto, order, SHORT_KEY)
        pairs = join_gold_auto(gold.select(*SHORT_KEY, "value"), first, SHORT_KEY)
    else:
        raise ValueError("multi_rater is 'mean' or 'expand'")
    return score_rollup(pairs, lang_metrics, datasets, nan_policy=nan_policy)


def average_first(auto: DataFrame, order: Column | str | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """First prediction per key, by partial aggregation."""
    if order is None:
        order = F.col("_pos") if "_pos" in auto.columns else F.col("value")
    order = F.col(order) if isinstance(order, str) else order
    return auto.groupBy(*keys).agg(F.min_by(F.col("value"), order).alias("value"))


def simple_scores(gold: DataFrame, auto: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean of the three correlations per metric and their sum over the number of
    requested metrics; NaN is not skipped."""
    by = list(by)
    pairs = join_gold_auto(short_key(gold).select(*SHORT_KEY, "value"), short_key(auto).select(*by, *SHORT_KEY, "value"), SHORT_KEY)
    stats = correlations(pairs.filter(F.col("metric").isin(list(metrics))), [*by, "metric"], "value_x", "value_y")
    wanted = gold.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    if by:
        wanted = auto.select(*by).distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    mean = (F.col("kendalltau") + F.col("pearson") + F.col("spearman")) / 3.0
    per_metric = wanted.join(stats, [*by, "metric"], "left").select(
        *by, "metric", F.coalesce(mean, F.lit(float("nan"))).alias("value"))
    total = per_metric.groupBy(*by).agg((F.sum("value") / F.lit(float(len(metrics)))).alias("value"))
    return per_metric.unionByName(total.select(*by, F.lit("ALL_en_ALL_mean").alias("metric"), "value"))


def run_scores(gold: DataFrame, runs: DataFrame, by: Sequence[str], lang_metrics: Mapping[str, Sequence[str]] = LANG_METRICS,
               datasets: Sequence[str] = tuple(DATASETS), listed: DataFrame | None = None) -> DataFrame:
    """Score tables of many runs at once; ``by`` tells the runs apart."""
    return score_rollup(pair_runs(gold, runs, by, listed), lang_metrics, datasets, by=by)


#: Runs that lie side by side in a row, at most; of more, each keeps rows of its own.
RUN_SLOTS = 32


def mean_ratings(gold: DataFrame) -> DataFrame:
    """Mean human rating of every key. Few rows share a key, so adding them up before the shuffle would save
    little and fill a task's memory with nearly all keys of its file split, and then its disk."""
    return average_raters(short_key(gold).select(*SHORT_KEY, "value").repartition(*SHORT_KEY), SHORT_KEY)


def pair_runs(gold: DataFrame, runs: DataFrame, by: Sequence[str], listed: DataFrame | None = None) -> DataFrame:
    """Mean rating of every run and key beside the mean human one.

    The runs are listed first, which runs a job; ``listed`` names a table that has all of them and is
    quicker to read. A key is one row then, with a sum and a count of every run, which tasks add up before
    the shuffle, so its digest is shuffled, sorted and paired once and not once a run. Many runs are
    shuffled once, dealt by key alone: they are averaged and paired where they are.
    """
    by = list(by)
    human = mean_ratings(gold)
    known = (runs if listed is None else listed).select(*by).distinct().limit(RUN_SLOTS + 1).collect()
    if len(known) > RUN_SLOTS:
        dealt = short_key(runs).select(*by, *SHORT_KEY, "value").repartition(*SHORT_KEY)
        return join_short(human, dealt.groupBy(*by, *SHORT_KEY).agg(F.avg(no_nan("value")).alias("value")))
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    numbers = T.StructType([T.StructField(names[c], runs.schema[c].dataType) for c in by]).add("_run", T.IntegerType()).add("_bit", T.LongType())
    slots = F.broadcast(gold.sparkSession.createDataFrame([(*row, i, 1 << i) for i, row in enumerate(known)], numbers))
    keyed = short_key(runs).select(*by, *SHORT_KEY, no_nan("value").alias("_v"))
    placed = keyed.join(slots, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]))
    # Sums beside sums: the counts, nearly all the same, take little room after them. The bits tell runs without a number from absent ones.
    own = [F.when(F.col("_run") == i, F.col("_v")) for i in range(len(known))]
    packed = placed.groupBy(*SHORT_KEY).agg(
        F.bit_or("_bit").alias("_seen"), *(F.sum(v).alias(f"_s{i}") for i, v in enumerate(own)), *(F.count(v).alias(f"_n{i}") for i, v in enumerate(own)))
    each = [F.when(F.col("_seen").bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(i).alias("_run"), F.try_divide(f"_s{i}", f"_n{i}").alias("value_y"))) for i in range(len(known))]
    unpacked = F.inline(F.array_compact(F.array(*each, F.lit(None).cast("struct<_run: int, value_y: double>"))))
    pairs = human.select(*SHORT_KEY, F.col("value").alias("value_x")).join(packed, SHORT_KEY).select(*SHORT_KEY, "value_x", unpacked)
    return pairs.join(slots, "_run").select(*(F.col(n).alias(c) for c, n in names.items()), *SHORT_KEY, "value_x", "value_y")


def per_bootstrap_scores(gold: DataFrame, runs: DataFrame, **domain) -> DataFrame:
    return run_scores(gold, runs, ["bootstrap_id"], **domain)


def prefix_scores(gold: DataFrame, runs: DataFrame, max_x: int, by: Sequence[str] = (), lang_metrics: Mapping[str, Sequence[str]] = LANG_METRICS,
                  datasets: Sequence[str] = tuple(DATASETS)) -> DataFrame:
    """Scores of the mean of the first x runs, for x = 1..max_x.

    A key is one row, with a running mean per prefix, until it is paired; then it is counted
    into cells.
    """
    by = list(by)
    means = prefix_means(short_key(runs), max_x, [*by, *SHORT_KEY]).withColumnRenamed("means", "value")
    paired = join_short(mean_ratings(gold), means)
    prefixes = paired.select(*by, *SHORT_KEY, "value_x", F.inline("value_y").alias("x", "value_y"))
    return score_rollup(prefixes, lang_metrics, datasets, by=[*by, "x"])
