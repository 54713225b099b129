"""Text functions, prompts, raw outputs, hooks and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ratemill.functions import text as TX
from ratemill.functions import values as FV
from ratemill.operators import hooks as H
from ratemill.operators import parse as PA
from ratemill.operators import prompt as PR
from ratemill.operators import relational as R
from ratemill.operators import validate as V
from ratemill.plans.retrieval import chunk_overlap as overlap_rows
from ratemill.plans.retrieval import chunk_text as chunk_rows
from ratemill.schema import RAW_OUTPUT
from ratemill.session import scratch_path
from ratemill.sources import readers
from ratemill.streaming import outputs as ST
from workload import views as W
from workload.registry import query
from workload.views import u_sql, with_views

WS = r"[\s\x0b\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def clean_sql(x: str) -> str:
    return strip_sql(f"translate(coalesce({x}, ''), chr(10) || chr(13) || chr(9), '   ')")


def docs(spark, sf):
    return W.table(spark, sf, "documents")


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", TX.clean_text("text").alias("cleaned"))


@query("collapse_ws", f"SELECT page_id, {collapse_sql('html')} AS collapsed FROM pages")
def collapse_ws(spark, sf):
    return W.table(spark, sf, "pages").select("page_id", TX.collapse_ws("html").alias("collapsed"))


@query("join_fields", f"SELECT doc_id, {clean_sql('''concat(coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, ''), ' ', text)''')} AS joined FROM documents")
def join_fields(spark, sf):
    return docs(spark, sf).select("doc_id", TX.join_fields(F.when(F.col("doc_id") % 3 > 0, F.col("source")), "text").alias("joined"))


_GOLDS = f"list_filter(list_transform(gold_texts, lambda g: {clean_sql('g')}), lambda g: g <> '')"


@query("gold_list", with_views("aligned_items", f"SELECT doc_id, array_to_string({_GOLDS}, '|') AS golds, CAST(len({_GOLDS}) AS INTEGER) AS n, coalesce(list_extract({_GOLDS}, 1), '') AS first FROM aligned_items"))
def gold_list(spark, sf):
    golds = W.aligned_items(spark, sf).select("doc_id", TX.gold_list("gold_texts").alias("g"))
    return golds.select("doc_id", F.array_join("g", "|").alias("golds"), F.size("g").alias("n"), TX.first_gold("g").alias("first"))


@query("first_image", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source || '/' || lang END AS image FROM documents")
def first_image(spark, sf):
    ids = F.when(F.col("doc_id") % 3 > 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return docs(spark, sf).select("doc_id", TX.first_image(ids, "source").alias("image"))


_ITEMS = f"list_filter(list_transform(gold_texts, lambda g: {strip_sql('g')}), lambda g: g <> '')"


@query("parse_list_text", with_views("aligned_items", f"""SELECT doc_id, CASE WHEN len(g) = 0 THEN '[]' ELSE array_to_string(list_transform(g, lambda x, i: CAST(i AS VARCHAR) || '. ' || x), chr(10)) END AS numbered,
 CASE WHEN len(g) = 0 THEN '[]' ELSE array_to_string(g, ';') END AS joined FROM (SELECT doc_id, {_ITEMS} AS g FROM aligned_items)"""))
def parse_list_text(spark, sf):
    rows = W.aligned_items(spark, sf).select("doc_id", F.to_json("gold_texts").alias("t"))
    return rows.select("doc_id", TX.parse_list_text("t").alias("numbered"), TX.parse_list_text("t", "semicolon").alias("joined"))


@query("pack_texts", with_views("aligned_items", f"""SELECT a.doc_id, coalesce(p.packed, '') AS packed FROM aligned_items a LEFT JOIN (SELECT doc_id, string_agg(t, ' ; ' ORDER BY u, i) AS packed FROM (
 SELECT doc_id, t, u, i, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY u, i) AS total FROM (SELECT doc_id, s.t AS t, s.i AS i, {u_sql("'7'", 'CAST(doc_id AS VARCHAR)', 's.t', 'CAST(s.i AS VARCHAR)')} AS u FROM (
  SELECT doc_id, unnest(list_transform(list_filter(gold_texts, lambda g: {strip_sql('g')} <> ''), lambda g, i: struct_pack(t := g, i := i - 1))) AS s FROM aligned_items))) WHERE total < 130 GROUP BY doc_id) p ON a.doc_id = p.doc_id"""))
def pack_texts(spark, sf):
    return W.aligned_items(spark, sf).select("doc_id", TX.pack_texts("gold_texts", 130, 7, F.col("doc_id")).alias("packed"))


@query("normalize_metric_name", """SELECT event_id, CASE WHEN n IN ('disagree', 'disagree-flag', 'disagree_flag') THEN 'disagree_flag' ELSE replace(n, '_', '-') END AS metric FROM (
 SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'disagree' WHEN 1 THEN 'disagree_flag' WHEN 2 THEN 'factual_accuracy' WHEN 3 THEN 'writing-style' ELSE event_type || '_x' END AS n FROM events)""")
def normalize_metric_name(spark, sf):
    k = F.col("event_id") % 5
    name = F.when(k == 0, "disagree").when(k == 1, "disagree_flag").when(k == 2, "factual_accuracy").when(k == 3, "writing-style").otherwise(F.concat("event_type", F.lit("_x")))
    return W.table(spark, sf, "events").select("event_id", TX.normalize_metric_name(name).alias("metric"))


@query("strip_gold_instructions", "SELECT doc_id, replace(replace(replace(text, 'the', 'THE'), 'THE in', 'in'), 'er', '') AS text FROM documents")
def strip_gold_instructions(spark, sf):
    return docs(spark, sf).select("doc_id", TX.strip_gold_instructions("text", [("the", "THE"), ("THE in", "in"), ("er", "")]).alias("text"))


@query("flatten_content", "SELECT conv_id, string_agg(replace(text, 'e', 'E'), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def flatten_content(spark, sf):
    """Turns as text blocks with an image block after each; text changed block by block."""
    turn = F.struct("turn", F.array(PR.text_block("text"), PR.image_block("role")).alias("b"))
    convs = W.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    blocks = F.flatten(F.transform("t", lambda x: x["b"]))
    return convs.select("conv_id", TX.flatten_content(TX.map_text_blocks(blocks, lambda t: F.replace(t, F.lit("e"), F.lit("E")))).alias("content"))


@query("truncate_words", f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE {strip_sql('''regexp_replace(left(text, 300), ' [^ ]*$', '')''')} || ' ...' END AS short FROM documents")
def truncate_words(spark, sf):
    return docs(spark, sf).select("doc_id", TX.truncate_words("text", 300).alias("short"))


_MIXED_TEXT = "CASE WHEN doc_id % 3 = 0 THEN text || repeat('中文字', 100) ELSE text END"


@query("script_ratio", f"SELECT doc_id, round(length(regexp_replace({_MIXED_TEXT}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) / greatest(length(regexp_replace({_MIXED_TEXT}, '[^\\p{{L}}]', '', 'g')), 1), 6) AS ratio FROM documents")
def script_ratio(spark, sf):
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.repeat(F.lit("中文字"), 100))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", F.round(TX.script_ratio(mixed), 6).alias("ratio"))


@query("clean_generation", f"SELECT doc_id, {strip_sql('text')} AS text FROM documents")
def clean_generation(spark, sf):
    wrapped = F.concat(F.lit("```zh\n好的，以下是翻译： "), "text", F.lit("\n```"))
    return docs(spark, sf).select("doc_id", TX.clean_generation(wrapped).alias("text"))


@query("semantic_text", with_views("aligned_items", f"SELECT doc_id, 'Query: ' || query_text || chr(10) || 'LLM response: ' || candidate || chr(10) || 'Gold doctor responses: ' || coalesce(list_extract(gold_texts, 1), '') || CASE WHEN image_path IS NOT NULL THEN chr(10) || 'Image caption: ' || image_path ELSE '' END AS t FROM aligned_items"))
def semantic_text(spark, sf):
    return W.aligned_items(spark, sf).select("doc_id", TX.semantic_text("query_text", "candidate", TX.first_gold("gold_texts"), "image_path").alias("t"))


@query("format_example", with_views("aligned_items", """SELECT doc_id, metric, CASE WHEN metric IN ('completeness', 'overall') THEN candidate
 WHEN (metric = 'writing-style' AND ds <> 'iiyi') THEN candidate
 WHEN (metric = 'disagree_flag' AND ds = 'iiyi') OR (metric = 'factual-accuracy' AND ds <> 'iiyi') THEN '[QUERY] ' || query_text || ' [CANDIDATE] ' || candidate
 ELSE '[IMG] ' || left(cap, 300) || ' [QUERY] ' || query_text || ' [CANDIDATE] ' || candidate END AS text FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'iiyi' ELSE 'other' END AS ds, CASE WHEN doc_id % 7 > 0 THEN reverse(candidate) ELSE '' END AS cap FROM aligned_items),
 (SELECT unnest(['disagree_flag','completeness','factual-accuracy','relevance','writing-style','overall']) AS metric)"""))
def format_example(spark, sf):
    """Classifier texts, routed by metric and data set."""
    metrics = ["disagree_flag", "completeness", "factual-accuracy", "relevance", "writing-style", "overall"]
    rows = W.aligned_items(spark, sf).withColumn("dataset", F.when(F.col("doc_id") % 2 == 0, "iiyi").otherwise("other")).withColumn(
        "image_caption", F.when(F.col("doc_id") % 7 > 0, F.reverse("candidate"))).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    return rows.select("doc_id", "metric", TX.format_example("historical_dataset_specific", {"gold": F.lit("")}).alias("text"))


@query("group_key", "SELECT doc_id, concat_ws(chr(1), source, lang, CAST(doc_id AS VARCHAR)) AS k FROM documents")
def group_key(spark, sf):
    return docs(spark, sf).select("doc_id", TX.group_key("source", "lang", "doc_id").alias("k"))


_CHUNK = 400
_KEEP = lambda pieces: f"list_filter(list_transform({pieces}, lambda q: {strip_sql('q')}), lambda q: q <> '')"
_FLUSH = f"CASE WHEN acc.buf <> '' THEN list_append(acc.done, {strip_sql('acc.buf')}) ELSE acc.done END"


@query("chunk_text", f"""WITH b AS (SELECT doc_id, {strip_sql('text')} AS body FROM documents),
p AS (SELECT doc_id, body, {_KEEP("string_split_regex(body, '\\n{2,}')")} AS paras, {_KEEP(f"string_split(regexp_replace(body, '([.;:]){WS}+', '\\1' || chr(2), 'g'), chr(2))")} AS sents FROM b),
c AS (SELECT doc_id, body, CASE WHEN len(paras) > 1 THEN paras ELSE sents END AS pieces FROM p),
r AS (SELECT doc_id, body, list_reduce(list_transform(pieces, lambda q: struct_pack(done := CAST([] AS VARCHAR[]), buf := q)), lambda acc, x:
  CASE WHEN length(x.buf) > {_CHUNK} THEN struct_pack(done := list_concat({_FLUSH}, list_transform(range(0, CAST((length(x.buf) - 1) // {_CHUNK} + 1 AS BIGINT)), lambda j: {strip_sql(f'substr(x.buf, j * {_CHUNK} + 1, {_CHUNK})')})), buf := '')
  WHEN length(acc.buf) + length(x.buf) + 2 > {_CHUNK} THEN struct_pack(done := {_FLUSH}, buf := x.buf)
  ELSE struct_pack(done := acc.done, buf := CASE WHEN acc.buf <> '' THEN acc.buf || chr(10) || chr(10) || x.buf ELSE x.buf END) END,
  struct_pack(done := CAST([] AS VARCHAR[]), buf := '')) AS acc FROM c),
f AS (SELECT doc_id, CASE WHEN length(body) <= {_CHUNK} THEN [body] ELSE {_FLUSH} END AS chunks FROM r)
SELECT doc_id, CAST(s.pos AS INTEGER) AS pos, s.t AS text FROM (SELECT doc_id, unnest(list_transform(chunks, lambda t, i: struct_pack(pos := i - 1, t := t))) AS s FROM f)""")
def chunk_text(spark, sf):
    return chunk_rows(docs(spark, sf), _CHUNK)


@query("chunk_overlap", f"""WITH w AS (SELECT doc_id, list_filter(string_split({collapse_sql('text')}, ' '), lambda x: x <> '') AS words FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS pos, array_to_string(list_slice(words, i * 90 + 1, i * 90 + 100), ' ') AS text FROM (SELECT doc_id, words, unnest(range(0, greatest(CAST(ceil((len(words) - 10) / 90.0) AS BIGINT), 1))) AS i FROM w)""")
def chunk_overlap(spark, sf):
    return overlap_rows(docs(spark, sf), 100, 10)


# ---------------------------------------------------------------- prompts

PM = ["completeness", "relevance"]
_Q = "'Query:' || chr(10) || '\"' || {q} || '\"' || chr(10) || chr(10) || 'LLM response:' || chr(10) || '\"' || {c} || '\"' || chr(10)"


def lit_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LABELS = "'completeness: ' || CAST((doc_id % 3) / 2.0 AS VARCHAR) || chr(10) || 'relevance: ' || CAST((doc_id // 3 % 3) / 2.0 AS VARCHAR) || chr(10)"
_GOLD_TEXT = "array_to_string(gold_texts, ' ')"


def prompt_docs(spark, sf):
    """Documents as rated items of five folds with one line of reference answers."""
    i = F.col("doc_id")
    labels = F.create_map(F.lit("completeness"), (i % 3) / 2.0, F.lit("relevance"), (F.floor(i / 3) % 3) / 2.0)
    return W.aligned_items(spark, sf).withColumn("fold", (i % 5).cast("int")).withColumn("labels", labels).withColumn(
        "gold", F.array_join("gold_texts", " "))


def fold_shots(spark, sf):
    """Two examples for every fold, drawn from the fold before it."""
    picked = R.first_rows(prompt_docs(spark, sf), ["fold"], [FV.uniform("shot", F.col("doc_id")), "doc_id"], 2, rank="rank")
    return picked.withColumn("fold", ((F.col("fold") + 1) % 5).cast("int"))


_SHOTS = f"""base AS MATERIALIZED (SELECT *, CAST(doc_id % 5 AS INTEGER) AS fold, {_GOLD_TEXT} AS gold FROM aligned_items),
shots AS MATERIALIZED (SELECT *, CAST((fold + 1) % 5 AS INTEGER) AS for_fold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {u_sql("'shot'", 'CAST(doc_id AS VARCHAR)')}, doc_id) AS rank FROM base) WHERE rank <= 2)"""


def prompt_sql(variant: str, stripped: bool = False) -> str:
    gold = variant in ("gold", "weighted", "evidence")
    extra = ""
    if variant == "weighted":
        extra = " || 'Nearness: ' || printf('%.6f', 1.0 / rank) || chr(10) || 'Weight of the example: ' || printf('%.6f', rank / 3.0) || chr(10)"
    gold_part = "" if not gold else (" || chr(10)" if stripped else " || 'gold responses:' || gold || chr(10)")
    example = f"'Sample ' || CAST(rank AS VARCHAR) || ':' || chr(10){extra} || {_Q.format(q='query_text', c='candidate')}{gold_part} || 'Ratings:' || chr(10) || {_LABELS}"
    shots = "''" if variant == "zero_shot" else "coalesce(s.block, '')"
    header = PR.header(PM, variant)
    if stripped:
        for old, new in PR.INSTRUCTION_REPLACEMENTS:
            header = header.replace(old, new)
    target = f"'The sample you need to rate:' || chr(10) || {_Q.format(q='b.query_text', c='b.candidate')}" + (
        "" if not gold else (" || chr(10)" if stripped else " || 'gold responses:' || b.gold || chr(10)"))
    text = f"{lit_sql(header)} || {shots} || {lit_sql(PR.closing(PM))} || {target}"
    if stripped:
        text = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    ctes = f"""{_SHOTS},
blocks AS (SELECT for_fold, string_agg(chr(10) || chr(10) || {example}, '' ORDER BY rank) AS block FROM shots GROUP BY for_fold),
prompts AS (SELECT b.doc_id, {text} AS content FROM base b LEFT JOIN blocks s ON b.fold = s.for_fold)"""
    return with_views("aligned_items", "SELECT doc_id, md5(content) AS digest, CAST(length(content) AS INTEGER) AS chars FROM prompts", ctes)


def prompts(spark, sf, variant="gold"):
    gold = "gold" if variant in ("gold", "weighted", "evidence") else None
    more = {"similarity": 1.0 / F.col("rank"), "weight": F.col("rank") / 3.0} if variant == "weighted" else {}
    example = PR.render_example("rank", "query_text", "candidate", "labels", PM, gold, **more)
    blocks = PR.shot_block(fold_shots(spark, sf), ["fold"], example)
    targets = PR.attach_shots(prompt_docs(spark, sf), blocks, ["fold"])
    return targets.withColumn("content", PR.render_prompt(PM, variant))


def digest(df):
    return df.select("doc_id", F.md5("content").alias("digest"), F.length("content").alias("chars"))


for _variant in ("gold", "weighted", "zero_shot", "no_image"):
    query(f"render_prompt_{_variant}", prompt_sql(_variant))(
        lambda spark, sf, v=_variant: digest(prompts(spark, sf, v)))


@query("render_prompt_evidence", with_views("aligned_items", f"""SELECT doc_id, md5(content) AS digest, CAST(length(content) AS INTEGER) AS chars FROM (SELECT doc_id, {lit_sql(PR.header(PM, 'evidence'))} || {lit_sql(PR.closing(PM))} || 'The sample you need to rate:' || chr(10) || {_Q.format(q='query_text', c='candidate')}
 || chr(10) || 'Gold doctor responses:' || chr(10) || CASE WHEN len(g) = 0 THEN '[]' ELSE array_to_string(list_transform(g, lambda x, i: CAST(i AS VARCHAR) || '. ' || x), chr(10)) END || chr(10) AS content FROM (SELECT *, {_ITEMS} AS g FROM aligned_items))"""))
def render_prompt_evidence(spark, sf):
    """Numbered reference answers and no examples."""
    rows = prompt_docs(spark, sf).withColumn("gold", TX.parse_list_text(F.to_json("gold_texts")))
    return digest(rows.withColumn("content", PR.render_prompt(PM, "evidence")))


@query("strip_gold_blocks", prompt_sql("gold", stripped=True))
def strip_gold_blocks(spark, sf):
    """Prompts with reference answers turned into prompts without."""
    plain = TX.strip_gold_blocks(TX.strip_gold_instructions("content", PR.INSTRUCTION_REPLACEMENTS))
    return digest(prompts(spark, sf).withColumn("content", plain))


@query("assert_no_marker", "SELECT count(*) AS clean FROM documents")
def assert_no_marker(spark, sf):
    """No prompt keeps a reference marker after the removal; the check itself stops if one does."""
    done = prompts(spark, sf).withColumn("content", TX.strip_gold_blocks("content"))
    return V.assert_no_marker(done, "content", TX.GOLD_MARKERS).agg(F.count("*").alias("clean"))


@query("render_blocks", with_views("aligned_items", f"""SELECT b.doc_id, CAST(7 - CASE WHEN b.image_path IS NULL THEN 1 ELSE 0 END - m.missing + 0 AS INTEGER) AS blocks, 2 - m.missing + CASE WHEN b.image_path IS NULL THEN 0 ELSE 1 END AS images, m.paths || coalesce(b.image_path, '') AS paths
 FROM base b JOIN (SELECT for_fold, count(*) FILTER (image_path IS NULL) AS missing, string_agg(coalesce(image_path, ''), '' ORDER BY rank) AS paths FROM shots GROUP BY for_fold) m ON b.fold = m.for_fold""", _SHOTS).replace("CAST(7 -", "CAST(8 -"))
def render_blocks(spark, sf):
    """Content as text and image blocks; a missing image leaves no block."""
    example = PR.render_example("rank", "query_text", "candidate", "labels", PM, name="Image")
    shots = fold_shots(spark, sf).groupBy("fold").agg(F.collect_list(F.struct("rank", example.alias("text"), F.col("image_path").alias("image"))).alias("shots"))
    targets = prompt_docs(spark, sf).join(shots, "fold")
    blocks = targets.select("doc_id", PR.render_blocks(PM, "shots").alias("b"))
    images = F.filter("b", lambda x: x["type"] == "image")
    return blocks.select("doc_id", F.size("b").alias("blocks"), F.size(images).cast("long").alias("images"),
                         F.array_join(F.transform(images, lambda x: x["image"]), "").alias("paths"))


@query("attach_shots", with_views("aligned_items", "SELECT b.doc_id, CAST(s.boot AS INTEGER) AS bootstrap_id, CAST(s.n AS BIGINT) AS examples FROM base b JOIN (SELECT for_fold, boot, count(*) AS n FROM shots, (SELECT unnest(range(3)) AS boot) GROUP BY ALL) s ON b.fold = s.for_fold", _SHOTS))
def attach_shots(spark, sf):
    """Every target once per bootstrap with the block of its fold."""
    shots = fold_shots(spark, sf).withColumn("bootstrap_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
    blocks = PR.shot_block(shots, ["fold", "bootstrap_id"], F.lit("x"))
    out = PR.attach_shots(prompt_docs(spark, sf), blocks, ["fold"], bootstraps=3)
    return out.select("doc_id", "bootstrap_id", F.regexp_count("shots", F.lit("x")).cast("long").alias("examples"))


# ---------------------------------------------------------------- raw outputs

OM = ["completeness", "relevance", "disagree_flag"]
_KINDS = [("plain", 0.40), ("fenced", 0.55), ("prose", 0.65), ("text", 0.75), ("missing", 0.82), ("cut", 0.88), ("empty_list", 0.92), ("nothing", 0.95), ("bad", 0.97), ("trailing", 1.0)]
_KIND_SQL = "CASE " + " ".join(f"WHEN u < {limit} THEN '{kind}'" for kind, limit in _KINDS) + " END"
_OUT = f"""outs AS MATERIALIZED (SELECT *, {_KIND_SQL} AS kind FROM (SELECT *, {u_sql('encounter_id', 'candidate_author_id', 'CAST(bootstrap_id AS VARCHAR)')} AS u FROM items, (SELECT CAST(unnest(range(2)) AS INTEGER) AS bootstrap_id))),
vals AS MATERIALIZED (SELECT dataset, encounter_id, lang, candidate_author_id, fold, bootstrap_id, m.metric, CASE m.metric WHEN 'completeness' THEN completeness WHEN 'relevance' THEN relevance ELSE disagree_flag END AS value
 FROM outs, (SELECT unnest(['completeness','relevance','disagree_flag']) AS metric) m WHERE kind IN ('plain','fenced','prose','text') OR (kind = 'missing' AND m.metric <> 'relevance'))"""


def outputs(spark, sf):
    """Model answers for every item and two runs, good and broken ones."""
    runs = W.items(spark, sf).withColumn("bootstrap_id", F.explode(F.sequence(F.lit(0), F.lit(1))))
    u = FV.uniform(F.col("encounter_id"), F.col("candidate_author_id"), F.col("bootstrap_id"))
    c, r, d = (F.col(m).cast("string") for m in OM)
    obj = F.format_string('{"completeness": %s, "relevance": %s, "disagree-flag": %s}', c, r, d)
    text = F.format_string('[{"completeness": "%s", "relevance": " %s ", "disagree_flag": "%s"}]', c, r, d)
    broken = [
        F.concat(F.lit("["), obj, F.lit("]")), F.concat(F.lit("```json\n["), obj, F.lit("]\n```")), F.concat(F.lit("My rating:\n"), obj, F.lit("\nthat is all")),
        text, F.format_string('[{"completeness": %s, "disagree": %s}]', c, d), F.format_string('[{"completeness": %s, "rel', c), F.lit("[]"), F.lit(""),
        F.format_string('[{"completeness": "high", "relevance": %s, "disagree_flag": %s}]', r, d), F.concat(F.lit("["), obj, F.lit("] and [more]")),
    ]
    response = F.lit(None).cast("string")
    for (_, limit), value in reversed(list(zip(_KINDS, broken))):
        response = F.when(F.col("u") < limit, value).otherwise(response)
    return runs.withColumn("u", u).select("dataset", "encounter_id", "lang", "candidate_author_id", "fold", "bootstrap_id", response.alias("response"))


def raw_outputs(rows):
    """Rows in the nested form a model run leaves behind."""
    key = F.struct("dataset", "encounter_id", "lang", "candidate_author_id", "fold", "bootstrap_id", F.lit("random").alias("selection_strategy"))
    message = F.struct(F.lit("user").alias("role"), F.lit("rate this").alias("content"), F.array(key).alias("key"))
    return rows.select(F.array(message).alias("input"), F.array("response").alias("response"))


@query("parse_response", with_views("items", "SELECT * FROM vals", _OUT))
def parse_response(spark, sf):
    return PA.parse_response(outputs(spark, sf), OM)[0].drop("response")


_ERRORS = """SELECT CASE kind WHEN 'missing' THEN 'missing relevance' WHEN 'cut' THEN 'no JSON found' WHEN 'empty_list' THEN 'empty list' WHEN 'nothing' THEN 'no JSON found' WHEN 'bad' THEN 'value is no number' ELSE 'invalid JSON' END AS error,
 count(*) AS n FROM outs WHERE kind IN ('missing','cut','empty_list','nothing','bad','trailing') GROUP BY 1"""


@query("parse_failures", with_views("items", _ERRORS, _OUT))
def parse_failures(spark, sf):
    return PA.parse_response(outputs(spark, sf), OM)[1].groupBy("error").agg(F.count("*").alias("n"))


@query("read_outputs", with_views("items", "SELECT bootstrap_id, fold, count(*) AS n FROM outs GROUP BY ALL", _OUT))
def read_outputs(spark, sf):
    path = scratch_path(spark, "outputs")
    raw_outputs(outputs(spark, sf)).write.option("compression", "gzip").json(path)
    return PA.flatten_outputs(readers.read_outputs(spark, path)).groupBy("bootstrap_id", "fold").agg(F.count("*").alias("n"))


@query("predictions_from_outputs", with_views("items ratings", """SELECT v.bootstrap_id, v.metric, t.rater_id, count(*) AS n, sum(v.value) AS total FROM vals v JOIN ratings t ON v.dataset = t.dataset AND v.encounter_id = t.encounter_id AND v.lang = t.lang
 AND v.candidate_author_id = t.candidate_author_id AND v.metric = t.metric GROUP BY ALL""", _OUT))
def predictions_from_outputs(spark, sf):
    """Answers to values for every rater row of the template."""
    matched, _ = PA.predictions_from_outputs(outputs(spark, sf), W.ratings(spark, sf).drop("pos"), OM)
    return matched.groupBy("bootstrap_id", "metric", "rater_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("template_failures", with_views("items ratings", "SELECT 'no template row for ' || metric AS error, count(*) AS n FROM vals WHERE lang = 'zh' GROUP BY ALL UNION ALL " + _ERRORS, _OUT))
def template_failures(spark, sf):
    """The template lacks one language: those values go to the dead letters too."""
    template = R.filter_lang(W.ratings(spark, sf).drop("pos"), "en")
    _, failures = PA.predictions_from_outputs(outputs(spark, sf), template, OM)
    return failures.groupBy("error").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- streams


def arrive(raw, path):
    """Raw outputs as packed files, one a task; how many there are."""
    raw.write.option("compression", "gzip").json(path)
    return max(1, len(raw.sparkSession.read.schema(RAW_OUTPUT).json(path).inputFiles()))


@query("stream_outputs", with_views("items", "SELECT metric, bootstrap_id, count(*) AS n, sum(value) AS total FROM vals GROUP BY ALL", _OUT))
def stream_outputs(spark, sf):
    """Files arrive, values go to one sink and failures to another."""
    source, done, failed, state = (scratch_path(spark, n) for n in ("arriving", "parsed", "failed", "state"))
    files = arrive(raw_outputs(outputs(spark, sf)), source)
    run = ST.stream_outputs(ST.read_output_stream(spark, source, math.ceil(files / 3)), OM, done, failed, state)
    run.awaitTermination()
    return spark.read.parquet(done).groupBy("metric", "bootstrap_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("stream_bootstrap_means", with_views("items", "SELECT dataset, encounter_id, lang, candidate_author_id, metric, avg(value) AS value, count(*) AS runs FROM vals GROUP BY ALL", _OUT))
def stream_bootstrap_means(spark, sf):
    """Running means; every answer is delivered twice and counts once."""
    source, sink, state = (scratch_path(spark, n) for n in ("arriving", "means", "state"))
    raw = raw_outputs(outputs(spark, sf))
    files = arrive(raw.union(raw), source)
    means = ST.stream_bootstrap_means(ST.read_output_stream(spark, source, math.ceil(files / 2)), OM)
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(sink)
    means.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


# ---------------------------------------------------------------- hooks


@query("score_with", "SELECT doc_id, CAST(length(text) AS VARCHAR) AS response FROM documents")
def score_with(spark, sf):
    """A stub model that answers with the length of the text."""
    model = lambda: lambda texts: [str(len(t)) for t in texts]
    return H.score_with(docs(spark, sf).select("doc_id", "text"), model, "text").select("doc_id", "response")


@query("rescore_with", "SELECT doc_id, CAST(length(source) AS DOUBLE) / (length(text) + 1) AS score FROM documents")
def rescore_with(spark, sf):
    model = lambda: lambda q, p: [len(a) / (len(b) + 1) for a, b in zip(q, p)]
    return H.rescore_with(docs(spark, sf).select("doc_id", "source", "text"), model, "source", "text").select("doc_id", "score")


def _shape():
    return lambda: lambda texts: [[[float(len(t)), 3.0, 0.0], [0.0, float(t.count("e")), 1.0]] for t in texts]


_EMBED = """WITH v AS (SELECT doc_id, length(text) / 2.0 AS a, (3.0 + length(text) - length(replace(text, 'e', ''))) / 2.0 AS b, 0.5 AS c FROM documents)
SELECT doc_id, round(a / sqrt(a * a + b * b + c * c), 4) AS a, round(b / sqrt(a * a + b * b + c * c), 4) AS b FROM v"""


@query("embed_with", _EMBED)
def embed_with(spark, sf):
    """Stub token vectors, mean-pooled and normalised."""
    out = H.embed_with(docs(spark, sf).select("doc_id", "text"), _shape())
    return out.select("doc_id", F.round(F.col("vector")[0].cast("double"), 4).alias("a"), F.round(F.col("vector")[1].cast("double"), 4).alias("b"))


@query("cache_vectors", _EMBED)
def cache_vectors(spark, sf):
    """A third of the texts are edited between two runs: only those are embedded again."""
    root = scratch_path(spark, "vectors")
    texts = docs(spark, sf).select("doc_id", "text")
    before = texts.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("old "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    embed = lambda df: H.embed_with(df, _shape())
    H.cache_vectors(before, root, "docs", "stub", embed)
    out = H.cache_vectors(texts, root, "docs", "stub", embed, ["doc_id", "vector"])
    return out.select("doc_id", F.round(F.col("vector")[0].cast("double"), 4).alias("a"), F.round(F.col("vector")[1].cast("double"), 4).alias("b"))


_INDEXED = """WITH w AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS word FROM documents),
 words AS MATERIALIZED (SELECT * FROM w WHERE word <> ''),
 signs AS MATERIALIZED (SELECT word, j, 2 * ((CAST('0x' || substr(md5('7|0|' || word), j // 4 + 1, 1) AS INTEGER) >> CAST(3 - j % 4 AS INTEGER)) & 1) - 1 AS s FROM (SELECT DISTINCT word FROM words), (SELECT unnest(range(16)) AS j)),
 texts AS MATERIALIZED (SELECT doc_id, j, sum(s) AS s FROM words JOIN signs USING (word) GROUP BY ALL),
 sums AS MATERIALIZED (SELECT word, j, sum(t.s - g.s) AS s, count(*) AS n FROM words JOIN signs g USING (word) JOIN texts t USING (doc_id, j) GROUP BY ALL),
 units AS MATERIALIZED (SELECT word, j, CAST(round(s / greatest(sqrt(sum(CAST(s AS DOUBLE) * s) OVER (PARTITION BY word)), 1e-12) * 1048576) AS BIGINT) AS u FROM sums WHERE n >= 2),
 means AS MATERIALIZED (SELECT doc_id, j, CAST(sum(u) AS DOUBLE) AS u FROM words JOIN units USING (word) GROUP BY ALL),
 scaled AS (SELECT doc_id, j, u / greatest(sqrt(sum(u * u) OVER (PARTITION BY doc_id)), 1e-12) AS v FROM means)
SELECT d.doc_id, """ + ", ".join(f"coalesce(round(max(v) FILTER (j = {j}), 4), 0) + 0 AS v{j}" for j in (0, 1, 7, 15)) + " FROM documents d LEFT JOIN scaled s USING (doc_id) GROUP BY d.doc_id"


@query("word_vectors", _INDEXED)
def word_vectors(spark, sf):
    """Built-in embedding: texts to unit vectors of mean word vectors."""
    texts = docs(spark, sf).select("doc_id", "text")
    out = H.word_vectors(texts, size=16)(texts)
    return out.select("doc_id", *((F.round(F.col("vector")[j].cast("double"), 4) + F.lit(0.0)).alias(f"v{j}") for j in (0, 1, 7, 15)))
