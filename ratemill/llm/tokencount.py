"""Token counts kept by digest of content and tokenizer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.llm.tokens import encoder, slices, tokenizer_version

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def content() -> F.Column:
    """The text as it is counted: null is empty. Nothing else is changed, as any change can change the count."""
    return F.coalesce(F.col("text"), F.lit(""))


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; none where the cache isn't there yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """``doc_id, digest, n_bytes, n_tokens`` of every row.

    Texts are known by their SHA-256 digest and the digest of the tokenizer file. Only
    digests that the cache does not hold are encoded, once each, and appended to it
    before the result is read; a repeated append changes nothing. Null texts are empty
    texts, with 0 tokens; an empty table gives an empty result; repeated rows stay;
    other columns are not read. Copies meet as one row per task and digest, and large
    groups of copies join with one row.
    """
    import pyarrow as pa

    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    keyed = docs.select("doc_id", content().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def counts(batches):
        for (digests,), texts in slices(batches, ["digest"]):
            sizes = [len(ids) // 4 for ids in encoder(tokenizer).encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array([version] * len(sizes), pa.string())], names=["digest", "n_tokens", "tokenizer"])

    once = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = once.join(cached_counts(spark, cache, version), "digest", "left_anti")
    misses.select("digest", "text").mapInArrow(counts, CACHE_SCHEMA).write.mode("append").parquet(cache)
    sized = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(cached_counts(spark, cache, version), "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
