"""Choosing example items for a target: weighted, diverse and label-balanced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratemill.functions.values import uniform
from ratemill.operators.coverage import DATASET_BONUS, coverage_similarity, item_bins
from ratemill.operators.grouped import map_sorted_groups
from ratemill.operators.relational import first_rows
from ratemill.operators.sample import SEED, key_text
from ratemill.operators.similar import topk_similar
from ratemill.session import scratch_path


def normalize_weights(df: DataFrame, by: Sequence[str] = ("target_id",), score: str = "similarity") -> DataFrame:
    """``weight``: positive part of the similarity over its sum, uniform where
    nothing is positive. The groups are top-k lists."""
    group = Window.partitionBy(*by)
    positive = F.greatest(F.col(score), F.lit(0.0))
    total = F.sum(positive).over(group)
    return df.withColumn("weight", F.when(total > 0, positive / total).otherwise(1.0 / F.count("*").over(group)))


def minmax(df: DataFrame, by: Sequence[str] = ("target_id",), score: str = "similarity", name: str = "scaled") -> DataFrame:
    """Score scaled to 0..1 within the group; a constant group gives 0. The range
    comes from a partial aggregate, so a group may be of any size."""
    limits = df.groupBy(*by).agg(F.min(score).alias("_low"), F.max(score).alias("_high")).select(
        *[F.col(c).alias(f"_{c}") for c in by], "_low", "_high")
    match = F.lit(True)
    for c in by:
        match = match & df[c].eqNullSafe(limits[f"_{c}"])
    scaled = F.coalesce(F.try_divide(F.col(score) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return df.join(limits, match).withColumn(name, scaled).select(*df.columns, name)


def rank_shots(df: DataFrame, by: Sequence[str] = ("target_id", "bootstrap_id"), score: str = "similarity",
               item: str = "item_id") -> DataFrame:
    """1-based rank of the chosen items of each target and bootstrap."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), item)))


def _race(*parts):
    """Exponential race: the smallest values are a weighted draw without replacement."""
    draw = -F.log(uniform(*parts))
    return F.when(F.col("weight") > 0, draw / F.col("weight")).otherwise(F.lit(float("inf")))


def weighted_sample(targets: DataFrame, pool: DataFrame, k: int, multiplier: int = 5, bootstraps: int = 1,
                    seed: int = SEED, **options) -> DataFrame:
    """``k`` items per target and bootstrap, drawn from its ``k * multiplier``
    nearest with probability by similarity; bootstrap 0 is the plain top k.
    Items without weight come last, the more similar one first."""
    near = normalize_weights(topk_similar(targets, pool, k * max(multiplier, 1), **options))
    near = near.withColumnRenamed("rank", "near_rank")
    spread = near.withColumn("bootstrap_id", F.explode(F.sequence(F.lit(0), F.lit(bootstraps - 1))))
    race = F.when(F.col("bootstrap_id") == 0, F.col("near_rank").cast("double")).otherwise(
        _race(seed, F.col("target_id"), F.col("bootstrap_id"), F.col("item_id")))
    picked = first_rows(spread.withColumn("_race", race), ["target_id", "bootstrap_id"], ["_race", "near_rank"], k, rank="rank")
    return picked.drop("_race")


def mmr(targets: DataFrame, pool: DataFrame, k: int, multiplier: int = 5, trade_off: float = 0.7, bootstraps: int = 1,
        seed: int = SEED, warm_start: int | None = None, **options) -> DataFrame:
    """Greedy: relevance against the largest similarity to what is already picked.

    The greedy part sees the ``k * multiplier`` nearest items of one target only. Bootstraps after
    the first start from one of the ``k`` nearest, or of at most ``warm_start`` of them.
    """
    starts = max(k, 1) if warm_start is None else min(max(k, 1), warm_start)
    near = normalize_weights(
        topk_similar(targets, pool, k * max(multiplier, 1), **options).withColumn(
            "_warm", F.when(F.col("rank") <= starts, F.col("similarity"))),
        score="_warm")
    vectors = pool.select("item_id", "vector")
    spread = near.join(vectors, "item_id").withColumn(
        "bootstrap_id", F.explode(F.sequence(F.lit(0), F.lit(bootstraps - 1))))
    race = F.when((F.col("bootstrap_id") > 0) & F.col("_warm").isNotNull(),
                  _race(seed, F.col("target_id"), F.col("bootstrap_id"), F.col("item_id")))
    spread = spread.select("target_id", "bootstrap_id", "item_id", "similarity", F.col("rank").alias("near_rank"),
                           "vector", race.alias("race"))
    types = {f.name: f.dataType.simpleString() for f in spread.schema}

    def pick(pdf):
        import numpy as np

        vec = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        sims, items, near_ranks = (pdf[c].to_numpy() for c in ("similarity", "item_id", "near_rank"))
        race = pdf["race"].to_numpy(dtype=np.float64)
        finite = np.isfinite(race)
        first = int(np.flatnonzero(finite)[np.argmin(race[finite])]) if finite.any() else 0
        chosen, open_rows = [first], np.ones(len(pdf), dtype=bool)
        open_rows[first] = False
        worst = vec @ vec[first]
        while open_rows.any() and len(chosen) < k:
            score = np.where(open_rows, trade_off * sims - (1.0 - trade_off) * worst, -np.inf)
            best = int(np.argmax(score))
            chosen.append(best)
            open_rows[best] = False
            worst = np.maximum(worst, vec @ vec[best])
        target, boot = pdf["target_id"].iloc[0], pdf["bootstrap_id"].iloc[0]
        return [(target, boot, items[i], sims[i], near_ranks[i], place) for place, i in enumerate(chosen, 1)]

    schema = (f"target_id {types['target_id']}, bootstrap_id int, item_id {types['item_id']}, similarity double, "
              "near_rank int, rank int")
    return map_sorted_groups(spread, ["target_id", "bootstrap_id"], ["near_rank"], pick, schema)


# ---------------------------------------------------------------- label balance


def class_pools(items: DataFrame, cross_fit: bool) -> DataFrame:
    """Items per (target fold, data set, bins): those outside the target's fold.

    Items with equal bins and data set always score alike, so this small table,
    at most 3 ** metrics * data sets rows per fold, stands for the whole pool.
    """
    if not cross_fit:
        return items.groupBy("dataset", "bins").agg(F.count("*").alias("n")).withColumn("target_fold", F.lit(-1))
    counts = items.groupBy("dataset", "bins", "fold").agg(F.count("*").alias("n"))
    folds = counts.agg(F.array_sort(F.collect_set("fold")).alias("f")).scalar()
    totals = counts.groupBy("dataset", "bins").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"))
    spread = totals.withColumn("_folds", folds).withColumn("target_fold", F.explode("_folds"))
    n = F.col("total") - F.coalesce(F.try_element_at("own", F.col("target_fold")), F.lit(0))
    return spread.select("dataset", "bins", n.alias("n"), F.col("target_fold").cast("int")).filter("n > 0")


def select_by_class(items: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int, strategy: str = "balanced",
                    bootstraps: int = 1, seed: int = SEED, temperature: float = 1.0, bonus: float = DATASET_BONUS,
                    cross_fit: bool = True, unique: bool = False) -> DataFrame:
    """Label-balanced example sets, one per (target fold, bootstrap).

    ``items``: one row per item with ``dataset``, one column per metric and, for
    ``cross_fit``, ``fold``. Strategies: "balanced" (greedy score), "softmax"
    (drawn by score) and "bin_coverage" (uncovered bins first). The greedy steps
    run on class counts; then the members of a class are taken in the order of
    their draws, which is a uniform choice. Ties between classes are drawn by
    how many items each still has, as per-item noise would settle them.
    """
    if strategy not in ("balanced", "softmax", "bin_coverage"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "softmax" and temperature <= 0:
        raise ValueError("temperature must be positive")
    # One row per signature: a repeated item must not be picked twice. Callers
    # whose items come out of a groupBy on the keys say ``unique``.
    base = items if unique else first_rows(items, keys, [f"`{c}`" for c in items.columns if c not in keys])
    binned = item_bins(base, metrics)
    pools = class_pools(binned, cross_fit).withColumn(
        "bootstrap_id", F.explode(F.sequence(F.lit(0), F.lit(bootstraps - 1))))
    names = list(metrics)

    def greedy(pdf):
        import hashlib
        import math

        import pandas as pd

        fold, boot = int(pdf["target_fold"].iloc[0]), int(pdf["bootstrap_id"].iloc[0])

        def draw(step):
            text = f"{seed}|{fold}|{boot}|{step}".encode()
            return (int(hashlib.md5(text).hexdigest()[:8], 16) + 0.5) / 4294967296.0

        classes = sorted((r.dataset, tuple(r.bins), int(r.n)) for r in pdf.itertuples())
        left = [c[2] for c in classes]
        covered: dict = {}
        wanted = {(m, b) for c in classes for m, b in zip(names, c[1])}
        seen, taken, rows = set(), [0] * len(classes), []
        for step in range(min(k, sum(left))):
            open_bins = wanted - set(covered)
            keyed = []
            for i, (dataset, bins, _) in enumerate(classes):
                if left[i] == 0:
                    continue
                cells = list(zip(names, bins))
                rarity = sum(1.0 / (1.0 + covered.get(cell, 0)) for cell in cells)
                extra = bonus if seen and dataset not in seen else 0.0
                gain = len(open_bins.intersection(cells))
                keyed.append((i, gain, rarity, extra))
            if strategy == "bin_coverage":
                rank = (lambda e: (e[1], round(e[2], 9), e[3])) if open_bins else (lambda e: (round(e[2], 9), e[3]))
            else:
                rank = lambda e: round(e[2] + e[3], 9)
            best = max(rank(e) for e in keyed)
            pool_size = sum(left)
            if strategy == "softmax":
                weights = [left[e[0]] * math.exp((e[2] + e[3] - best) / temperature) for e in keyed]
            else:
                weights = [float(left[e[0]]) if rank(e) == best else 0.0 for e in keyed]
            total, goal, run, at = sum(weights), draw(step), 0.0, None
            for e, w in zip(keyed, weights):
                run += w
                if w > 0:
                    at = e
                    if goal * total <= run:
                        break
            i, gain, rarity, extra = at
            chance = math.exp((rarity + extra - best) / temperature) / total if strategy == "softmax" else None
            phase = None
            if strategy == "bin_coverage":
                phase = "cover_uncovered" if open_bins else "fill_balanced"
            taken[i] += 1
            left[i] -= 1
            seen.add(classes[i][0])
            for cell in zip(names, classes[i][1]):
                covered[cell] = covered.get(cell, 0) + 1
            rows.append((fold, boot, step + 1, classes[i][0], list(classes[i][1]), taken[i], rarity + extra, chance,
                         pool_size, gain, extra, phase))
        return pd.DataFrame(rows, columns=["target_fold", "bootstrap_id", "rank", "dataset", "bins", "nth", "score",
                                           "probability", "pool_size", "gain", "dataset_bonus", "phase"])

    picks = pools.groupBy("target_fold", "bootstrap_id").applyInPandas(
        greedy, "target_fold int, bootstrap_id int, rank int, dataset string, bins array<string>, nth int, score double, "
        "probability double, pool_size long, gain int, dataset_bonus double, phase string")
    # One row per pick: at most k * bootstraps * folds, so the pool is not shuffled for it.
    needed = picks.groupBy("target_fold", "bootstrap_id", "dataset", "bins").agg(F.max("nth").alias("_need"))
    members = binned.join(F.broadcast(needed), ["dataset", "bins"])
    if cross_fit:
        members = members.filter(F.col("fold") != F.col("target_fold"))
    draw = uniform(seed, F.col("target_fold"), F.col("bootstrap_id"), key_text(keys))
    placed = first_rows(members.withColumn("_u", draw), ["target_fold", "bootstrap_id", "dataset", "bins"], ["_u", *keys],
                        max(k, 1), rank="nth").filter(F.col("nth") <= F.col("_need"))
    payload = [c for c in items.columns if c not in ("dataset", "bins")]
    return picks.join(placed.select("target_fold", "bootstrap_id", "dataset", "bins", "nth", *payload),
                      ["target_fold", "bootstrap_id", "dataset", "bins", "nth"]).drop("nth")


def score_balanced(items: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int, **options) -> DataFrame:
    return select_by_class(items, keys, metrics, k, "balanced", **options)


def score_balanced_softmax(items: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int,
                           temperature: float = 1.0, **options) -> DataFrame:
    return select_by_class(items, keys, metrics, k, "softmax", temperature=temperature, **options)


def metric_bin_coverage(items: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int, **options) -> DataFrame:
    return select_by_class(items, keys, metrics, k, "bin_coverage", **options)


def agreement_score_balanced(items: DataFrame, agreeing: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int,
                             **options) -> DataFrame:
    """``score_balanced`` on the items whose raters agree; too few of them is an
    error. They are found once and go to scratch (runs jobs)."""
    agreed, path = items.join(agreeing, list(keys), "left_semi"), scratch_path(items.sparkSession, "agreed")
    agreed.write.parquet(path)
    pool = items.sparkSession.read.schema(agreed.schema).parquet(path)
    found = pool.count()
    if found < k:
        raise ValueError(f"only {found} items pass the agreement filter, {k} are needed")
    return score_balanced(pool, keys, metrics, k, **options)
