"""Retrieved passages as evidence inside prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.functions.text import chunk_array, collapse_ws, insert_evidence, overlapping_windows, truncate_words
from ratemill.operators.relational import dedupe_nodes
from ratemill.operators.similar import two_stage_topk

# How evidence is marked and introduced inside a prompt.
EVIDENCE_MARKER = {"en": "[Relevant Clinical Guidelines]", "zh": "[相关临床指南]"}
EVIDENCE_NOTE = {
    "en": "Passages found by search; background only, they may not fit the question.",
    "zh": "以下内容为检索所得，仅供参考。",
}


def chunk_text(docs: DataFrame, limit: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunk rows (id, pos, text) packed from paragraphs or sentences."""
    return docs.select(ident, F.posexplode(chunk_array(text, limit)).alias("pos", "text"))


def chunk_overlap(docs: DataFrame, size: int = 1024, overlap: int = 100, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Passage rows (id, pos, text) of ``size`` words sharing ``overlap`` words."""
    return docs.select(ident, F.posexplode(overlapping_windows(text, size, overlap)).alias("pos", "text"))


def evidence_line(rank: Column, text: Column, file_name: Column, page: Column, score: Column, style: str = "en",
                  metadata: bool = True, max_chars: int = 1200) -> Column:
    """One numbered line; null for an empty passage."""
    body = truncate_words(collapse_ws(text), max_chars)
    source = F.coalesce(F.when(file_name != "", file_name), F.lit("unknown"))
    some_page = F.when(page != "", page)
    number = rank.cast("string")
    if not metadata:
        line = F.concat(number, F.lit(". "), body)
    elif style == "en":
        line = F.concat(number, F.lit(". Source: "), source,
                        F.coalesce(F.concat(F.lit(", page="), some_page), F.lit("")),
                        F.coalesce(F.concat(F.lit(", score="), F.format_string("%.4f", score)), F.lit("")),
                        F.lit(". "), body)
    else:
        line = F.concat(number, F.lit(". 来源："), source,
                        F.coalesce(F.concat(F.lit(", page="), some_page), F.lit("")),
                        F.lit("，相关性="), F.format_string("%.4f", score), F.lit("。"), body)
    return F.when(collapse_ws(text) != "", line)


def format_evidence(hits: DataFrame, by: Sequence[str] = ("target_id",), style: str = "en", metadata: bool = True,
                    max_chars: int = 1200, query: str | None = "query", min_query: int = 0) -> DataFrame:
    """Evidence text per query from its ranked passages (``rank``, ``text``,
    ``file_name``, ``page``, ``score``). Queries under ``min_query`` characters get none."""
    if query is not None and min_query:
        hits = hits.filter(F.length(F.trim(F.col(query))) >= min_query)
    line = evidence_line(F.col("rank"), F.col("text"), F.col("file_name"), F.col("page").cast("string"), F.col("score"),
                         style, metadata, max_chars)
    joined = hits.withColumn("_line", line).filter(F.col("_line").isNotNull()).groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda r: r["_line"]), "\n").alias("_lines"))
    opening = f"\n\n{EVIDENCE_MARKER[style]}:\n{EVIDENCE_NOTE[style]}\n"
    return joined.select(*by, F.concat(F.lit(opening), F.col("_lines"), F.lit("\n")).alias("evidence"))


def augment_prompts(prompts: DataFrame, evidence: DataFrame, on: Sequence[str] = ("target_id",), style: str = "en",
                    location: str = "auto", mode: str = "both", allow_duplicate: bool = False, text: str = "content") -> DataFrame:
    """Prompts with their evidence put in; ``augmented`` says where something changed."""
    joined = prompts.join(evidence, list(on), "left")
    changed = insert_evidence(text, "evidence", EVIDENCE_MARKER[style], location, mode, allow_duplicate, style == "zh")
    return joined.withColumn("_new", changed).withColumn("augmented", F.col("_new") != F.col(text)).withColumn(
        text, F.col("_new")).drop("_new", "evidence")


def retrieve(queries: DataFrame, nodes: DataFrame, embed, k: int = 10, n: int = 2, rescore=None, dedupe: bool = True,
             min_length: int = 0, prefix: int | None = None) -> DataFrame:
    """Ranked passages per query: dedupe, embed, exact top-k, optional rescoring.

    ``dedupe=False`` keeps every node; ``min_length`` and ``prefix`` as in ``dedupe_nodes``.

    ``queries``: target_id, query. ``nodes``: node_id, text, file_name,
    page_label, _pos. ``embed`` maps a DataFrame with ``text`` to one with ``vector``.
    """
    passages = dedupe_nodes(nodes, min_length=min_length, prefix=prefix) if dedupe else nodes
    pool = embed(passages.select(F.col("node_id").alias("item_id"), "text")).select("item_id", "vector")
    targets = embed(queries.filter(F.length("query") > 0).select("target_id", F.col("query").alias("text")))
    hits = two_stage_topk(targets.select("target_id", "vector"), pool, k, n, rescore)
    details = passages.select(F.col("node_id").alias("item_id"), "text", "file_name", F.col("page_label").alias("page"))
    return hits.join(details, "item_id").join(queries.select("target_id", "query"), "target_id").withColumn(
        "score", F.col("similarity"))
