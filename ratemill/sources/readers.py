"""Readers. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratemill.operators.relational import dedupe_last
from ratemill.schema import NODE, PROGRESS, RATINGS, RAW_OUTPUT

# Fixed value: how a score key is put together.
SCORE_KEY = r"^([^-]+)-([^-]+)-(.+)-([^-]+)$"
SIMPLE_TOTAL = "ALL_en_ALL_mean"


def position() -> Column:
    """Order of a row in its input: file, block, row. Reading order inside a block
    is what the running id follows."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those paths that are there."""
    conf, path_class = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if path_class(p).getFileSystem(conf).exists(path_class(p))]


def read_csv(spark: SparkSession, path, schema: StructType, multi_line: bool = True) -> DataFrame:
    """Columns of ``schema`` by the names in the header, in any order; others are left out.

    A missing column raises; a value that isn't of its type becomes null. Quoted texts
    may hold line breaks and doubled quotes; without line breaks ``multi_line=False``
    lets a file be split.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df = spark.read.options(**options).csv(path)
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema))


def read_ratings(spark: SparkSession, path, with_position: bool = True, schema: StructType = RATINGS, multi_line: bool = True) -> DataFrame:
    """Ratings from CSV; see ``read_csv``."""
    df = read_csv(spark, path, schema, multi_line)
    return df.withColumn("_pos", position()) if with_position else df


def read_documents(spark: SparkSession, path, schema, key: str = "encounter_id", multi_line: bool = True) -> DataFrame:
    """JSON array of source documents; of repeated ids the last one counts."""
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path).withColumn("_pos", position())
    return dedupe_last(df, [key]).drop("_pos")


def unpivot_languages(docs: DataFrame, langs: Sequence[str]) -> DataFrame:
    """Per-language columns ``query_title_{lang}`` … as one row per language."""
    shared = [c for c in docs.columns if not any(c.endswith(f"_{lang}") for lang in langs) and c != "responses"]
    per_lang = []
    for lang in langs:
        answers = F.transform("responses", lambda r: r[f"content_{lang}"]) if "responses" in docs.columns else F.array()
        per_lang.append(F.struct(
            F.lit(lang).alias("lang"),
            (F.col(f"query_title_{lang}") if f"query_title_{lang}" in docs.columns else F.lit(None).cast("string")).alias("query_title"),
            (F.col(f"query_content_{lang}") if f"query_content_{lang}" in docs.columns else F.lit(None).cast("string")).alias("query_content"),
            answers.cast("array<string>").alias("answers")))
    return docs.select(*shared, F.inline(F.array(*per_lang)))


def read_outputs(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Raw model outputs; JSON lines can be split, a JSON array (``multi_line``) cannot."""
    return spark.read.schema(RAW_OUTPUT).option("multiLine", multi_line).json(path)


def read_nodes(spark: SparkSession, path, root: str = "docstore/data", whole_file: bool = True) -> DataFrame:
    """Node maps as one row per node: one map per file or, which can be split, per line."""
    raw = spark.read.text(path, wholetext=whole_file)
    store = F.from_json("value", f"STRUCT<`{root}`: MAP<STRING, {NODE}>>")
    nodes = raw.select(F.posexplode(store[root]).alias("_pos", "node_id", "node"))
    data, meta = F.col("node.__data__"), F.col("node.__data__.metadata")
    return nodes.select("node_id", data["text"].alias("text"), meta["file_name"].alias("file_name"),
                        F.coalesce(F.when(meta["page_label"] != "", meta["page_label"]), meta["page_number"]).alias("page"),
                        meta["page_label"].alias("page_label"), "_pos")


def read_progress(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several progress logs; absent files and blank lines are skipped, and the
    last entry of a node counts (later files after earlier ones)."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], PROGRESS)
    parts = None
    for number, path in enumerate(found):
        part = spark.read.schema(PROGRESS).json(path).withColumn("_pos", F.struct(F.lit(number).alias("n"), position().alias("p")))
        parts = part if parts is None else parts.unionByName(part)
    return dedupe_last(parts.filter(F.col("node_id").isNotNull()), ["node_id"]).drop("_pos")


def parse_score_keys(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``scope-lang-metric-stat`` keys as columns; metric names may hold dashes.
    Bare metric names (the simple scorer) become English means over all data."""
    k = F.col(key)
    full = F.regexp_like(k, F.lit(SCORE_KEY)) & F.regexp_like(k, F.lit(r"-(kendalltau|pearson|spearman|mean)$"))
    part = lambda i: F.regexp_extract(k, SCORE_KEY, i)
    return df.withColumn("scope", F.when(full, part(1)).otherwise("ALL")).withColumn(
        "lang", F.when(full, part(2)).otherwise("en")).withColumn(
        "metric", F.when(full, part(3)).when(k == SIMPLE_TOTAL, "ALL").otherwise(k)).withColumn(
        "stat", F.when(full, part(4)).otherwise("mean")).withColumn("value", F.col(value).cast("double"))


def read_scores(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Score files as long rows with the file they came from; a missing file gives none."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "scope string, lang string, metric string, stat string, value double, file string")
    raw = spark.read.text(found, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = raw.select("file", F.explode(F.from_json("value", "MAP<STRING,DOUBLE>")).alias("key", "value"))
    return parse_score_keys(rows).select("scope", "lang", "metric", "stat", "value", "file")


def union_fold_files(spark: SparkSession, paths, schema, fmt: str = "json") -> DataFrame:
    """Rows of many fold folders, tagged with the fold in the folder name."""
    df = spark.read.schema(schema).format(fmt).load(paths)
    return df.withColumn("fold", F.regexp_extract(F.col("_metadata.file_path"), r"fold[_=](\d+)", 1).try_cast("int"))
