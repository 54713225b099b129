"""Registered queries of the operators on training texts, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.llm import contamination, filteraudit, lexicon, packing, pii, prefixtrie, rules, setsketch, simple8b, sql, suffixes, tokencount, toxicity, urls
from ratemill.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    """Rows whose labels are never learned; rows without ``doc_id`` are not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All rows as ``row``, with a ``row_key`` of their own, written to scratch: ``doc_id`` may be null or repeated, and verdicts are about rows."""
    path = scratch_path(spark, "numbered")
    docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("row_key")).write.parquet(path)
    return spark.read.parquet(path)


def keyed(rows: DataFrame) -> DataFrame:
    """The texts under their ``row_key``, as operators take them."""
    return rows.select(F.col("row_key").alias("doc_id"), "row.text")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(urls.labelled_urls(spark))
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, model, ["page_id"])


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    simple8b.write_ids(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    return simple8b.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _spans(column: str) -> Column:
    kinds = F.array(*map(F.lit, pii.KINDS))
    order = F.array_sort(F.transform(column, lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(), ["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_spans("base").cast("binary"), 256).alias("base_sha256"), _spans("spans").alias("spans"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), scratch_path(spark, "near"), similarity=0.8, width=2)


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows are judged, whatever their doc_id; a text is read again only where it may hold an item.
    rows = numbered(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    pairs = contamination.contained_items(keyed(rows), table(spark, sf_dir, "benchmark"), scratch_path(spark, "benchmark"))
    found = pairs.groupBy(F.col("doc_id").alias("row_key")).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("containment").alias("containment"))
    joined = rows.select("row_key", "row.doc_id").join(found, "row_key", "left")
    listed = F.coalesce(F.array_join(F.col("item_ids").cast("array<string>"), ","), F.lit(""))
    return joined.select("doc_id", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), listed.alias("item_ids"), F.coalesce("containment", F.lit(0.0)).alias("containment"), F.col("item_ids").isNull().alias("kept"))


@query
def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"), scratch_path(spark, "repeats"), length=50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score_texts(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 0, scratch_path(spark, "pieces"), capacity=2048)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.train(docs, table(spark, sf_dir, "labels"))
    judged = rules.judge(docs, learned, ["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("rule").isNull()).alias("kept"), "rule")


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), scratch_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op11_lexicon_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, file = table(spark, sf_dir, "documents"), scratch_path(spark, "lexicon"), tokenizer("word_bpe_49k.json")
    name = lexicon.send_lexicon(spark, lexicon.frequent_words(docs, path), file, f"{path}.bin")
    decoded = lexicon.decode_ids(lexicon.encode_texts(docs, name, file), file)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "trie")
    prefixtrie.paths(table(spark, sf_dir, "conversations")).write.parquet(f"{path}/own")
    nodes = prefixtrie.prefix_trie(prefixtrie.rebuilt(spark.read.parquet(f"{path}/own")), path)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch_path(spark, "audit"))


ORACLES["op5_decontaminate"] = sql.DECONTAMINATE
ORACLES["op12_prefix_trie"] = sql.PREFIX_TRIE
ORACLES["op13_filter_audit"] = sql.FILTER_AUDIT
