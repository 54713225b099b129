"""Filters, joins, set operations, dedupe and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.functions.text import collapse_ws
from ratemill.functions.values import uniform
from ratemill.schema import ITEM_KEY, KEY, OUTPUT_COLUMNS, SYSTEM_PREFIX, TEMPLATE_KEY

# ---------------------------------------------------------------- filters


def filter_lang(df: DataFrame, lang: str | Sequence[str]) -> DataFrame:
    if lang == "all":
        return df
    wanted = [lang] if isinstance(lang, str) else list(lang)
    return df.filter(F.col("lang").isin(wanted))


def filter_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return df.filter(F.col("metric").isin(list(metrics)))


def filter_raters(df: DataFrame, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    if keep:
        df = df.filter(F.col("rater_id").isin(list(keep)))
    if drop:
        df = df.filter(F.col("rater_id").isNull() | ~F.col("rater_id").isin(list(drop)))
    return df


def filter_systems(df: DataFrame, numbers: Sequence, prefix: str = SYSTEM_PREFIX) -> DataFrame:
    return df.filter(F.col("candidate_author_id").isin([f"{prefix}{n}" for n in numbers]))


def filter_dataset(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("dataset") == name)


def split_fold(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the other folds, rows of this fold)."""
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def select_output_columns(df: DataFrame) -> DataFrame:
    return df.select(*OUTPUT_COLUMNS)


def fill_missing(df: DataFrame, value: str = "", columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(columns) if columns else None)


def headline_scores(scores: DataFrame) -> DataFrame:
    return scores.filter((F.col("scope") == "ALL") & (F.col("stat") == "mean"))


def identity(*extra: str) -> Column:
    """The item identity attached to every prompt."""
    names = ["dataset", "encounter_id", "lang", "candidate_author_id", *extra]
    return F.struct(*names)


# ---------------------------------------------------------------- dedupe


def _order(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1,
               rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark cuts to ``n`` rows per key before the
    shuffle, so one key holding a third of the table stays harmless."""
    window = Window.partitionBy(*keys).orderBy(*_order(order))
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def dedupe_first(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence[Column | str] = ("_pos",)) -> DataFrame:
    return first_rows(df, keys, order)


def dedupe_last(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence[Column | str] = ("_pos",)) -> DataFrame:
    """Last row per key, as a later write overwrites an earlier one."""
    return first_rows(df, keys, [c.desc() for c in _order(order)])


def dedupe_nodes(nodes: DataFrame, order: Sequence[Column | str] = ("_pos",), min_length: int = 0,
                 prefix: int | None = None) -> DataFrame:
    """One passage per (file, page, text), or per its first ``prefix`` characters;
    passages under ``min_length`` characters are dropped."""
    cleaned = nodes.withColumn("text", collapse_ws("text")).filter(F.length("text") >= min_length)
    keyed = (
        cleaned.withColumn("_file", F.coalesce("file_name", F.lit("")))
        .withColumn("_page", F.coalesce(F.col("page_label").cast("string"), F.lit("")))
        .withColumn("_head", F.substring("text", 1, prefix) if prefix else F.sha2("text", 256))
    )
    return first_rows(keyed, ["_file", "_page", "_head"], order).drop("_file", "_page", "_head")


# ---------------------------------------------------------------- joins


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_gold_auto(gold: DataFrame, auto: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Inner join in which missing keys match each other. Columns both tables
    have besides the keys get ``_x`` (gold) and ``_y``."""
    shared = {c for c in gold.columns if c in auto.columns and c not in keys}

    def name(c: str, suffix: str) -> Column:
        return F.col(c).alias(f"{c}{suffix}" if c in shared else c)

    left = gold.select(*keys, *[name(c, "_x") for c in gold.columns if c not in keys])
    right = auto.select(*[F.col(k).alias(f"_{k}") for k in keys], *[name(c, "_y") for c in auto.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])
    return left.join(right, condition, "inner").drop(*[f"_{k}" for k in keys])


def align(ratings: DataFrame, documents: DataFrame, keys: Sequence[str] = ("dataset", "encounter_id", "lang")) -> tuple[DataFrame, DataFrame]:
    """Ratings joined with their source document; second result: ratings whose
    document is missing. The document side is small next to the ratings or not,
    Spark decides from its size."""
    aligned = ratings.join(documents, list(keys), "inner").withColumnRenamed("value", "label")
    missing = ratings.join(documents, list(keys), "left_anti")
    return aligned, missing


def fill_template(template: DataFrame, predictions: DataFrame, keys: Sequence[str] = TEMPLATE_KEY,
                  default: float | None = -1.0, rater_id: str | None = None,
                  order: Sequence[Column | str] = ("_pos",)) -> DataFrame:
    """Every template row once, with the predicted value or ``default``.

    ``default=None`` keeps the template's own value. The ``hit`` column says
    whether a prediction was found.
    """
    last = dedupe_last(predictions, keys, order).select(*keys, F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    joined = template.join(last, list(keys), "left")
    fallback = F.col("value") if default is None else F.lit(default)
    out = joined.withColumn("value", F.when(F.col("_hit"), F.col("_new")).otherwise(fallback).cast("double"))
    out = out.withColumn("hit", F.coalesce(F.col("_hit"), F.lit(False)))
    if rater_id is not None:
        out = out.withColumn("rater_id", F.lit(rater_id))
    extra = [c for c in ("rater_id",) if c in out.columns and c not in template.columns]
    return out.select(*template.columns, *extra, "hit")


def expand_to_template(parsed: DataFrame, template: DataFrame, keys: Sequence[str] = TEMPLATE_KEY) -> tuple[DataFrame, DataFrame]:
    """One row per parsed value and matching template row (raters and candidates
    fan out), and the parsed rows that match nothing."""
    base = template.drop("value")
    matched = parsed.join(base.drop(*[c for c in base.columns if c in parsed.columns and c not in keys]),
                          list(keys), "inner")
    unmatched = parsed.join(base, list(keys), "left_anti").withColumn("error", F.lit("no template row"))
    return matched, unmatched


def semi_join_keys(df: DataFrame, picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was picked; a key picked twice does not repeat rows."""
    return df.join(picked, list(keys), "left_semi")


def filter_by_keyset(df: DataFrame, keyset: DataFrame, keys: Sequence[str] = ITEM_KEY) -> DataFrame:
    return df.join(keyset, null_safe(df, keyset, keys), "left_semi")


def anti_join_done(todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    return todo.join(done, list(keys), "left_anti")


def merge_overlay(base: DataFrame, updates: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Replace ``column`` where an update exists; updates of unknown keys are ignored."""
    new = updates.select(*keys, F.col(column).alias("_new"))
    out = base.join(new, list(keys), "left").withColumn(column, F.coalesce("_new", column))
    return out.select(*base.columns)


# ---------------------------------------------------------------- sort, limit, sets


def sort_keys(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.orderBy(*keys)


def limit_items(df: DataFrame, n: int, keys: Sequence[str] = ITEM_KEY) -> DataFrame:
    """All rows of the first ``n`` items in key order."""
    picked = df.select(*keys).distinct().orderBy(*keys).limit(n)
    return df.join(picked, null_safe(df, picked, keys), "left_semi")


def topk(similarities: DataFrame, k: int, target: Sequence[str] = ("target_id",), score: str = "similarity",
         item: str = "item_id") -> DataFrame:
    """The ``k`` most similar items per target, the smaller id on ties."""
    return first_rows(similarities, target, [F.col(score).desc(), F.col(item)], k, rank="rank")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def except_ids(df: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct().join(taken, list(keys), "left_anti")


def intersect_bins(left: Column, right: Column) -> Column:
    return F.array_intersect(left, right)


def pad_language(df: DataFrame, other: DataFrame, lang: str) -> DataFrame:
    """Append the untouched rows of another language."""
    return df.unionByName(filter_lang(other, lang), allowMissingColumns=True)


def shard(df: DataFrame, count: int, index: int, key: str) -> DataFrame:
    """One of ``count`` disjoint parts, a pure function of the key."""
    return df.filter(F.floor(uniform(F.col(key)) * count) == index)
