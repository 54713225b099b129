"""Writers. Each runs one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ratemill.functions.values import no_nan
from ratemill.schema import KEY


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", keys: Sequence[str] = KEY, mode: str = "error") -> None:
    """Sorted by key; CSV with header and doubled quotes, or parquet."""
    writer = df.orderBy(*keys).write.mode(mode)
    if fmt == "csv":
        options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**options).csv(path)
    else:
        writer.format(fmt).save(path)


def write_prompts(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; other scripts than Latin stay readable."""
    df.write.mode(mode).json(path)


def score_map(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One JSON text per ``by`` with keys ``scope-lang-metric-stat``. JSON has no
    NaN, so a missing score is null. The map has one entry per score name."""
    key = F.concat_ws("-", "scope", "lang", "metric", "stat")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), no_nan("value").alias("value")))))
    return scores.groupBy(*by).agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("value"))


def write_scores(scores: DataFrame, path: str, mode: str = "error") -> None:
    score_map(scores).coalesce(1).write.mode(mode).text(path)


def write_failures(failures: DataFrame, path: str, mode: str = "error") -> int:
    """All failures go to ``path``; the same job counts them."""
    seen = Observation()
    failures.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def write_provenance(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per fold; the training rows of a fold are those of the others,
    so nothing is written twice. Reading prunes to the folders needed."""
    df.write.mode(mode).partitionBy("fold").parquet(path)


def read_split(spark, path: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """(training rows, validation rows) of one fold."""
    df = spark.read.parquet(path)
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)
