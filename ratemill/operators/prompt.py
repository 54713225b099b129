"""Prompt rows from targets and chosen examples."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.functions.values import ColumnLike, as_column
from ratemill.schema import INVERTED_METRIC

# Our own wording; the markers inside prompts are fixed values of functions.text.
RUBRIC = {
    "disagree_flag": "1 when the answer should be rejected, otherwise 0",
    "completeness": "1 when nothing is left out, 0.5 when parts are, 0 when the question stays open",
    "factual-accuracy": "1 when every statement holds, 0.5 when some do, 0 when it misleads",
    "factual-consistency-wgold": "1 when it agrees with the reference answers, 0.5 in part, 0 when it contradicts them",
    "overall": "1 when it is sound as a whole, 0.5 in part, 0 when it is not",
    "relevance": "1 when it answers the question, 0.5 in part, 0 when it does not",
    "writing-style": "1 when the tone fits, 0.5 in part, 0 when it does not",
}
WITH_REFERENCE = "Reference answers by experts come with each sample; treat them as the truth."
WITHOUT_REFERENCE = "Judge by established knowledge of the field."
INSTRUCTION_REPLACEMENTS = [(WITH_REFERENCE, WITHOUT_REFERENCE)]
WEIGHT_NOTE = "Give examples with a higher weight more say."
NO_IMAGE_NOTE = "No image is shown."


def rubric_text(metrics: Sequence[str]) -> str:
    return "\n".join(f"{m}: {RUBRIC[m]}" for m in metrics)


def output_template(metrics: Sequence[str], continuous: bool = False) -> str:
    allowed = {m: "{0.0,1.0}" if m == INVERTED_METRIC else "{0.0,0.5,1.0}" for m in metrics}
    return json.dumps([{m: "a number from 0 to 1" if continuous else allowed[m] for m in metrics}])


def header(metrics: Sequence[str], variant: str = "gold", continuous: bool = False) -> str:
    """Opening of a prompt: task, rules and answer format."""
    lines = ["Rate the answer to a question by these rules.", rubric_text(metrics)]
    lines.append(WITH_REFERENCE if variant in ("gold", "weighted", "evidence") else WITHOUT_REFERENCE)
    if variant == "weighted":
        lines.append(WEIGHT_NOTE)
    if variant == "no_image":
        lines.append(NO_IMAGE_NOTE)
    lines.append(f"Answer with JSON only: {output_template(metrics, continuous)}")
    return "\n\n".join(lines)


def closing(metrics: Sequence[str]) -> str:
    return f"\n\nNow rate the response below with JSON only: {output_template(metrics)}\n\n"


def ratings_text(labels: ColumnLike, metrics: Sequence[str]) -> Column:
    """One line per metric from a map of labels."""
    labels = as_column(labels)
    return F.concat(*[F.concat(F.lit(f"{m}: "), F.coalesce(labels[m].cast("string"), F.lit("")), F.lit("\n")) for m in metrics])


def render_example(rank: ColumnLike, query: ColumnLike, candidate: ColumnLike, labels: ColumnLike, metrics: Sequence[str],
                   gold: ColumnLike | None = None, similarity: ColumnLike | None = None,
                   weight: ColumnLike | None = None, name: str = "Sample") -> Column:
    none = F.lit("")
    parts = [F.lit(f"{name} "), as_column(rank).cast("string"), F.lit(":\n")]
    if similarity is not None:
        parts += [F.lit("Nearness: "), F.format_string("%.6f", as_column(similarity).cast("double")), F.lit("\n")]
    if weight is not None:
        parts += [F.lit("Weight of the example: "), F.format_string("%.6f", as_column(weight).cast("double")), F.lit("\n")]
    parts += [F.lit('Query:\n"'), F.coalesce(as_column(query), none), F.lit('"\n\nLLM response:\n"'),
              F.coalesce(as_column(candidate), none), F.lit('"\n')]
    if gold is not None:
        parts += [F.lit("gold responses:"), F.coalesce(as_column(gold), none), F.lit("\n")]
    return F.concat(*parts, F.lit("Ratings:\n"), ratings_text(labels, metrics))


def render_target(query: ColumnLike, candidate: ColumnLike, gold: ColumnLike | None = None) -> Column:
    none = F.lit("")
    parts = [F.lit('The sample you need to rate:\nQuery:\n"'), F.coalesce(as_column(query), none),
             F.lit('"\n\nLLM response:\n"'), F.coalesce(as_column(candidate), none), F.lit('"\n')]
    if gold is not None:
        parts += [F.lit("gold responses:"), F.coalesce(as_column(gold), none), F.lit("\n")]
    return F.concat(*parts)


def shot_block(shots: DataFrame, by: Sequence[str], text: ColumnLike, order: ColumnLike = "rank",
               metadata: Sequence[str] = ()) -> DataFrame:
    """Examples of one set joined in order, each after a blank line; written once
    per set and not once per target. A set holds k examples."""
    row = F.struct(as_column(order).alias("o"), as_column(text).alias("t"))
    out = [F.concat_ws("", F.transform(F.array_sort(F.collect_list(row)), lambda s: F.concat(F.lit("\n\n"), s["t"]))).alias("shots")]
    if metadata:
        info = F.struct(as_column(order).alias("_o"), *metadata)
        out.append(F.array_sort(F.collect_list(info)).alias("shot_metadata"))
    return shots.groupBy(*by).agg(*out)


def attach_shots(targets: DataFrame, blocks: DataFrame, on: Sequence[str], bootstraps: int = 1) -> DataFrame:
    """Every target with the block of its set, once per bootstrap; a target
    without examples keeps one row with an empty block."""
    if "bootstrap_id" in blocks.columns and "bootstrap_id" not in targets.columns:
        targets = targets.withColumn("bootstrap_id", F.explode(F.sequence(F.lit(0), F.lit(max(bootstraps, 1) - 1))))
    keys = [*on, *([] if "bootstrap_id" in on or "bootstrap_id" not in blocks.columns else ["bootstrap_id"])]
    return targets.join(blocks, keys, "left").withColumn("shots", F.coalesce("shots", F.lit("")))


def render_prompt(metrics: Sequence[str], variant: str = "gold", query: str = "query_text", candidate: str = "candidate",
                  gold: str = "gold", shots: ColumnLike = "shots") -> Column:
    """Prompt text of one row. Variants: gold and weighted (reference answers),
    evidence (reference answers on lines of their own and no examples, ready for
    retrieved passages), zero_shot and no_image (no reference answers)."""
    if variant not in ("gold", "weighted", "evidence", "zero_shot", "no_image"):
        raise ValueError(f"unknown variant {variant!r}")
    reference = gold if variant in ("gold", "weighted") else None
    if variant == "evidence":
        target = F.concat(render_target(query, candidate), F.lit("\nGold doctor responses:\n"),
                          F.coalesce(as_column(gold), F.lit("(none given)")), F.lit("\n"))
        return F.concat(F.lit(header(metrics, variant)), F.lit(closing(metrics)), target)
    examples = F.lit("") if variant == "zero_shot" else F.coalesce(as_column(shots), F.lit(""))
    return F.concat(F.lit(header(metrics, variant)), examples, F.lit(closing(metrics)),
                    render_target(query, candidate, reference))


def text_block(text: ColumnLike) -> Column:
    return F.struct(F.lit("text").alias("type"), as_column(text).alias("text"), F.lit(None).cast("string").alias("image"))


def image_block(path: ColumnLike) -> Column:
    return F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), as_column(path).alias("image"))


def render_blocks(metrics: Sequence[str], shots: ColumnLike, query: str = "query_text", candidate: str = "candidate",
                  image: str = "image_path") -> Column:
    """Content as typed blocks: header, each example with its image, target with its image.

    ``shots`` is an array of structs (rank, text, image); images that are
    missing leave no block.
    """
    none = F.array().cast("array<struct<type:string,text:string,image:string>>")
    shots = F.coalesce(as_column(shots), F.array().cast("array<struct<rank:int,text:string,image:string>>"))
    examples = F.flatten(F.transform(F.array_sort(shots), lambda s: F.array(text_block(s["text"]), image_block(s["image"]))))
    target = F.array(text_block(F.lit(closing(metrics))), text_block(render_target(query, candidate)), image_block(F.col(image)))
    blocks = F.concat(F.array(text_block(F.lit(header(metrics, "blocks")))), F.coalesce(examples, none), target)
    return F.filter(blocks, lambda b: (b["type"] == "text") | b["image"].isNotNull())


def prompt_item(content: ColumnLike, key: ColumnLike, metadata: ColumnLike | None = None) -> Column:
    fields = [F.lit("user").alias("role"), as_column(content).alias("content"), F.array(as_column(key)).alias("key")]
    if metadata is not None:
        fields.append(as_column(metadata).alias("shot_metadata"))
    return F.struct(*fields)
