"""Column names, schemas and the fixed vocabulary of the rating domain."""

from __future__ import annotations

from pyspark.sql import types as T

# They must be spelled exactly like this for results to agree
# with rating files produced elsewhere.
ITEM_KEY = ["dataset", "encounter_id", "lang", "candidate", "candidate_author_id"]
KEY = ITEM_KEY + ["metric"]
TEMPLATE_KEY = ["dataset", "encounter_id", "lang", "candidate_author_id", "metric"]
OUTPUT_COLUMNS = KEY + ["rater_id", "value"]
LANG_METRICS = {
    "en": ["disagree_flag", "completeness", "factual-accuracy", "relevance", "writing-style", "overall"],
    "zh": ["factual-consistency-wgold", "writing-style"],
}
DATASETS = ["iiyi", "woundcare"]
SYSTEM_PREFIX = "SYSTEM00"
STATS = ["kendalltau", "pearson", "spearman", "mean"]
BINS = ["low", "mid", "high"]
CLASS_VALUES = [0.0, 0.5, 1.0]
INVERTED_METRIC = "disagree_flag"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


RATINGS = T.StructType(_strings(*KEY, "rater_id") + [T.StructField("value", T.DoubleType())])

ALIGNED = T.StructType(
    _strings(*KEY, "rater_id")
    + [T.StructField("label", T.DoubleType())]
    + _strings("query_text", "image_path")
    + [T.StructField("gold_texts", T.ArrayType(T.StringType()))]
    + _strings("image_caption")
    + [T.StructField("fold", T.IntegerType())]
)

PROMPT_KEY = T.StructType(
    _strings("dataset", "encounter_id", "lang", "candidate_author_id")
    + [
        T.StructField("fold", T.IntegerType()),
        T.StructField("bootstrap_id", T.IntegerType()),
        T.StructField("selection_strategy", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    _strings("role", "content") + [T.StructField("key", T.ArrayType(PROMPT_KEY))]
)

RAW_OUTPUT = T.StructType(
    [
        T.StructField("input", T.ArrayType(MESSAGE)),
        T.StructField("response", T.ArrayType(T.StringType())),
    ]
)

PROGRESS = T.StructType(
    _strings("node_id")
    + [
        T.StructField("original_len", T.LongType()),
        T.StructField("translated_len", T.LongType()),
        T.StructField("translated_text", T.StringType()),
    ]
)

NODE = "STRUCT<__data__: STRUCT<text: STRING, metadata: STRUCT<file_name: STRING, page_label: STRING, page_number: STRING>>>"

SCORES = T.StructType(_strings("scope", "lang", "metric", "stat") + [T.StructField("value", T.DoubleType())])
