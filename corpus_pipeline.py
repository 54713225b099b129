"""A training corpus in five stages: toxicity, near duplicates, benchmark items, personal data, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.llm import contamination, packing, pii, setsketch, toxicity
from ratemill.llm.queries import held_out, keyed, numbered, table, tokenizer
from ratemill.session import scratch_path

#: No stage with a model or a tokenizer can be written as SQL.
ORACLE_SQL = None
#: Texts with this score or more are rejected.
REJECTED = 0.7
#: Parts of texts whose ids a worker remembers while packing, beside what earlier stages left in its memory.
REMEMBERED = 100_000


def whole(docs: DataFrame) -> DataFrame:
    """All columns as one, ``row``, beside the text, so that no column of the table has the name of a result."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below REJECTED. Labels are learned outside the held-out rows."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score_texts(whole(docs), model, ["row"]).filter(F.col("score") < REJECTED).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows without ``doc_id`` are compared like others and come last; of rows with one id any may stay.
    """
    rows = numbered(spark, docs)
    judged = setsketch.near_duplicates(keyed(rows), scratch_path(spark, "near"), similarity=0.8, width=5)
    groups = judged.select(F.col("doc_id").alias("row_key"), "component_id").join(rows.select("row_key", "row.doc_id"), "row_key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key"))
    kept = groups.groupBy("component_id").agg(least.alias("first")).select("first.row_key")
    return rows.join(kept, "row_key", "left_semi").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without 0.8 or more of a benchmark item's five-word shingles."""
    rows = numbered(spark, docs)
    pairs = contamination.contained_items(keyed(rows), table(spark, sf_dir, "benchmark"), scratch_path(spark, "benchmark"))
    found = pairs.select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(found, "row_key", "left_anti").select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text."""
    found = pii.find(whole(docs), pii.train(), ["row"])
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), 0, scratch_path(spark, "pieces"), capacity=2048, remember=REMEMBERED)


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
