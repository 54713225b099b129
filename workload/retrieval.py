"""Passages, evidence and its place in prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratemill.functions import text as TX
from ratemill.functions import values as FV
from ratemill.operators import relational as R
from ratemill.plans import retrieval as RT
from ratemill.session import scratch_path
from ratemill.sources import readers
from workload import views as W
from workload.registry import query
from workload.texts import _GOLD_TEXT, _Q, PM, collapse_sql, lit_sql, prompt_docs, strip_sql
from workload.views import with_views
from ratemill.operators import prompt as PR

from ratemill.operators.relational import fill_template
from ratemill.schema import TEMPLATE_KEY

LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORDS, OVERLAP = 100, 10

# ---------------------------------------------------------------- stand-in embedding: letter counts


def letters(text):
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def embed(df):
    """Unit vector of letter counts; a plain Spark expression."""
    return df.withColumn("vector", FV.l2_normalize(letters(F.col("text"))))


def letters_sql(x: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower({x})) - length(replace(lower({x}), '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


_CHUNKS = f"""words AS (SELECT doc_id, source, list_filter(string_split({collapse_sql('text')}, ' '), lambda x: x <> '') AS words FROM documents),
chunks AS MATERIALIZED (SELECT doc_id, CAST(i AS INTEGER) AS pos, source AS file_name, array_to_string(list_slice(words, i * {WORDS - OVERLAP} + 1, i * {WORDS - OVERLAP} + {WORDS}), ' ') AS text
 FROM (SELECT doc_id, source, words, unnest(range(0, greatest(CAST(ceil((len(words) - {OVERLAP}) / {WORDS - OVERLAP}.0) AS BIGINT), 1))) AS i FROM words)),
nodes AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS node_id, * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY file_name, pos % 3, substr(text, 1, 120) ORDER BY doc_id, pos) AS r FROM chunks WHERE length(text) >= 80) WHERE r = 1)"""


def passages(spark, sf):
    docs = W.table(spark, sf, "documents")
    chunks = docs.select("doc_id", "source", F.posexplode(TX.overlapping_windows("text", WORDS, OVERLAP)).alias("pos", "text"))
    return chunks.select(F.concat_ws("-", "doc_id", "pos").alias("node_id"), "text", F.col("source").alias("file_name"),
                         (F.col("pos") % 3).cast("string").alias("page_label"), F.struct("doc_id", "pos").alias("_pos"))


@query("dedupe_nodes", "WITH " + _CHUNKS + " SELECT node_id, file_name, CAST(pos % 3 AS VARCHAR) AS page_label, text FROM nodes")
def dedupe_nodes(spark, sf):
    return R.dedupe_nodes(passages(spark, sf), min_length=80, prefix=120).drop("_pos")


@query("read_nodes", """SELECT CAST(doc_id AS VARCHAR) AS node_id, text, source AS file_name, CASE WHEN doc_id % 2 = 0 THEN lang ELSE CAST(doc_id AS VARCHAR) END AS page FROM documents""")
def read_nodes(spark, sf):
    """Node maps of at most fifty documents each, written as JSON and read back."""
    docs = W.table(spark, sf, "documents")
    meta = F.struct(F.col("source").alias("file_name"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("page_label"), F.col("doc_id").cast("string").alias("page_number"))
    node = F.struct(F.struct("text", meta.alias("metadata")).alias("__data__"))
    maps = docs.groupBy(F.floor(F.col("doc_id") / 50).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), node))).alias("m"))
    path = scratch_path(spark, "nodes")
    maps.select(F.to_json(F.struct(F.col("m").alias("docstore/data"))).alias("value")).write.text(path)
    return readers.read_nodes(spark, path, whole_file=False).select("node_id", "text", "file_name", "page")


_K, _N = 4, 2
_HITS = _CHUNKS + f""",
qv AS MATERIALIZED (SELECT item_id AS target_id, text AS query, {unit_sql('v')} AS vec FROM (SELECT item_id, text, {letters_sql('text')} AS v FROM benchmark)),
pv AS MATERIALIZED (SELECT node_id, file_name, CAST(pos % 3 AS VARCHAR) AS page, text, {unit_sql('v')} AS vec FROM (SELECT *, {letters_sql('text')} AS v FROM nodes)),
scored AS (SELECT target_id, query, node_id, file_name, page, text, round(list_dot_product(q.vec, p.vec), 12) AS similarity FROM qv q CROSS JOIN pv p),
hits AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY similarity DESC, node_id) AS INTEGER) AS rank FROM scored) WHERE rank <= {_N})"""


def hits(spark, sf):
    queries = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("query"))
    return RT.retrieve(queries, passages(spark, sf), embed, _K, _N, min_length=80, prefix=120)


@query("retrieve", "WITH " + _HITS + " SELECT target_id, node_id AS item_id, file_name, page, rank, round(similarity, 6) AS similarity FROM hits")
def retrieve(spark, sf):
    """Passages of the documents for every benchmark text."""
    return hits(spark, sf).select("target_id", "item_id", "file_name", "page", "rank", F.round("similarity", 6).alias("similarity"))


def line_sql(style: str) -> str:
    body = f"CASE WHEN length(text) <= 200 THEN text ELSE {strip_sql('''regexp_replace(left(text, 200), ' [^ ]*$', '')''')} || ' ...' END"
    if style == "en":
        return f"CAST(rank AS VARCHAR) || '. Source: ' || file_name || ', page=' || page || ', score=' || printf('%.4f', similarity) || '. ' || {body}"
    return f"CAST(rank AS VARCHAR) || '. 来源：' || file_name || ', page=' || page || '，相关性=' || printf('%.4f', similarity) || '。' || {body}"


def evidence_sql(style: str) -> str:
    opening = lit_sql(f"\n\n{RT.EVIDENCE_MARKER[style]}:\n{RT.EVIDENCE_NOTE[style]}\n")
    return f"SELECT target_id, {opening} || string_agg({line_sql(style)}, chr(10) ORDER BY rank) || chr(10) AS evidence FROM hits GROUP BY target_id"


for _style in ("en", "zh"):
    query(f"format_evidence_{_style}", "WITH " + _HITS + " " + evidence_sql(_style))(
        lambda spark, sf, s=_style: RT.format_evidence(hits(spark, sf), style=s, max_chars=200, min_query=5))


# ---------------------------------------------------------------- evidence inside prompts

_EV = "'<<' || CAST(b.doc_id AS VARCHAR) || '>>'"
_BASE = f"base AS MATERIALIZED (SELECT *, {_GOLD_TEXT} AS gold FROM aligned_items)"


def insert_sql(location: str, gold_first: bool = False) -> str:
    """The prompt put together from its pieces, with the evidence in its place."""
    opening = f"{lit_sql(PR.header(PM, 'gold'))} || {lit_sql(PR.closing(PM))} || 'The sample you need to rate:' || chr(10)"
    query_part = "'Query:' || chr(10) || '\"' || b.query_text || '\"' || chr(10) || chr(10)"
    quoted = "'Query:' || chr(10) || '\"' || split_part(b.query_text, '\"', 1) || '\"'"
    after_quoted = f"substr({query_part}, length({quoted}) + 1)"
    response = "'LLM response:' || chr(10) || '\"' || b.candidate || '\"'"
    gold = "chr(10) || 'gold responses:' || b.gold"
    pieces = {
        "end": [opening, query_part, response, gold, "chr(10)", _EV],
        "after_llm_response": [opening, query_part, response, _EV, gold, "chr(10)"] if gold_first else [opening, query_part, response, gold, "chr(10)", _EV],
        "before_llm_response": [opening, query_part, _EV, response, gold, "chr(10)"],
        "after_query": [opening, quoted, _EV, after_quoted, response, gold, "chr(10)"],
    }[location]
    text = " || ".join(f"({p})" for p in pieces)
    return with_views("aligned_items", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5({text.replace(f'({_EV})', chr(39) * 2)}) ELSE md5({text}) END AS digest FROM base b", _BASE)


def _insert(location, gold_first=False):
    def run(spark, sf):
        evidence = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("<<"), F.col("doc_id").cast("string"), F.lit(">>")))
        rows = prompt_docs(spark, sf).withColumn("content", PR.render_prompt(PM, "gold", shots=F.lit("")))
        changed = TX.insert_evidence("content", evidence, "no such marker", location, gold_first=gold_first)
        return rows.select("doc_id", F.md5(changed).alias("digest"))

    return run


for _place in ("end", "after_llm_response", "before_llm_response", "after_query"):
    query(f"insert_evidence_{_place}", insert_sql(_place))(_insert(_place))
query("insert_evidence_before_gold", insert_sql("after_llm_response", True))(_insert("after_llm_response", True))


@query("insert_evidence_after_gold", with_views("aligned_items", f"SELECT doc_id, CASE WHEN regexp_matches(gold, '^{chr(92)}s*$') THEN 'empty' ELSE left(gold, 1) || '<<>>' END AS tail FROM base WHERE NOT regexp_matches(gold, '[{chr(92)}n]')", _BASE))
def insert_evidence_after_gold(spark, sf):
    """Evidence behind the reference answers; answers of one line are compared."""
    rows = prompt_docs(spark, sf).filter(~F.contains("gold", F.lit("\n"))).withColumn("content", PR.render_prompt(PM, "gold", shots=F.lit("")))
    changed = TX.insert_evidence("content", F.lit("<<>>"), "no such marker", "after_gold")
    tail = F.substring_index(changed, "gold responses:", -1)
    blank = F.regexp_like("gold", F.lit(r"\A\s*\z"))
    ends = tail.endswith("<<>>\n") & (F.replace(tail, F.lit("<<>>\n"), F.lit("")) == F.col("gold"))
    return rows.select("doc_id", F.when(blank, F.lit("empty")).when(ends, F.concat(F.left("gold", F.lit(1)), F.lit("<<>>"))).otherwise(tail).alias("tail"))


def after_gold_sql() -> str:
    """Every document's whole prompt; the answers end before a blank line with the next part, or before the last line break."""
    opening = f"{lit_sql(PR.header(PM, 'gold'))} || {lit_sql(PR.closing(PM))} || {lit_sql(TX.TARGET_MARKER)} || chr(10)"
    blank = r"[ \t\n\x0B\f\r]*"
    answers = rf"(?is)((?:gold doctor responses|gold responses):{blank}.*?)(?:\n{blank}\n(?:now rate|the sample|\n?$)|\n?$)"
    return with_views("aligned_items", "SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN content ELSE left(content, length(content) - length(section) + place) || '<<' || CAST(doc_id AS VARCHAR) || '>>' || substr(section, place + 1) END) AS digest FROM placed", f"""{_BASE},
rendered AS (SELECT doc_id, {opening} || {_Q.format(q='query_text', c='candidate')} || 'gold responses:' || gold || chr(10) AS content FROM base),
sections AS (SELECT *, {lit_sql(TX.TARGET_MARKER)} || list_extract(string_split(content, {lit_sql(TX.TARGET_MARKER)}), -1) AS section FROM rendered),
matched AS (SELECT *, regexp_extract(section, {lit_sql(answers)}, 1) AS answers FROM sections),
placed AS (SELECT *, instr(section, answers) + length(answers) - 1 AS place FROM matched)""")


query("insert_evidence_after_gold_all", after_gold_sql())(_insert("after_gold"))


@query("augment_prompts", f"WITH {_HITS}, ev AS ({evidence_sql('en')}) SELECT target_id, md5('LLM response:' || chr(10) || query || evidence) AS digest, true AS augmented FROM qv JOIN ev USING (target_id)")
def augment_prompts(spark, sf):
    prompts = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.concat(F.lit("LLM response:\n"), "text").alias("content"))
    out = RT.augment_prompts(prompts, RT.format_evidence(hits(spark, sf), max_chars=200, min_query=5))
    return out.select("target_id", F.md5("content").alias("digest"), "augmented")


@query("find_query", with_views("aligned_items", f"SELECT doc_id, split_part(query_text, '\"', 1) AS query, CAST(length('The sample you need to rate:' || chr(10) || {_Q.format(q='query_text', c='candidate')} || 'gold responses:' || gold || chr(10)) AS INTEGER) AS section FROM base b", _BASE))
def find_query(spark, sf):
    rows = prompt_docs(spark, sf).withColumn("content", PR.render_prompt(PM, "gold", shots=F.lit("")))
    return rows.select("doc_id", TX.find_query("content").alias("query"), F.length(TX.target_section("content")).alias("section"))


_QUERY = strip_sql("split_part(query_text, '\"', 1)")
_JOINED = f"array_to_string(list_filter(list_transform(gold_texts, lambda g: {strip_sql('g')}), lambda g: g <> ''), ' ')"


@query("retrieval_query", with_views("aligned_items", f"SELECT doc_id, {_QUERY} AS query, {_JOINED} AS gold, nullif(concat_ws(' ', nullif({_QUERY}, ''), nullif({_JOINED}, '')), '') AS both FROM aligned_items"))
def retrieval_query(spark, sf):
    """Reference answers as a JSON list, which is how they stand in a prompt."""
    rows = prompt_docs(spark, sf).withColumn("gold", F.to_json("gold_texts")).withColumn("content", PR.render_prompt(PM, "gold", shots=F.lit("")))
    return rows.select("doc_id", *[TX.retrieval_query("content", m).alias(m) for m in ("query", "gold", "both")])


# ---------------------------------------------------------------- similarity baseline


@query("baseline_similarity_score", with_views("aligned_items", f"""SELECT t.dataset, t.encounter_id, t.lang, t.candidate_author_id, t.metric, CASE WHEN t.doc_id % 4 = 0 THEN -1.0 ELSE round(greatest(0.0, least(1.0, CASE WHEN metric = 'disagree_flag' THEN 1 - sim ELSE sim END)), 6) END AS value, t.doc_id % 4 <> 0 AS hit
 FROM (SELECT *, unnest(['disagree_flag', 'overall']) AS metric FROM (SELECT *, list_dot_product({unit_sql('cv')}, {unit_sql('gv')}) AS sim FROM (SELECT *, {letters_sql('candidate')} AS cv, {letters_sql("coalesce(list_extract(gold_texts, 1), '')")} AS gv FROM aligned_items))) t"""))
def baseline_similarity_score(spark, sf):
    """Cosine of answer and first reference answer, flipped where needed, into a template."""
    rows = W.aligned_items(spark, sf).withColumn("metric", F.explode(F.array(F.lit("disagree_flag"), F.lit("overall"))))
    sim = FV.dot(FV.l2_normalize(letters(F.col("candidate"))), FV.l2_normalize(letters(TX.first_gold("gold_texts"))))
    template = rows.select(*TEMPLATE_KEY, F.lit(None).cast("double").alias("value"))
    preds = rows.filter("doc_id % 4 <> 0").select(*TEMPLATE_KEY, F.round(FV.clip01(FV.flip_metric("metric", sim)), 6).alias("value"))
    return fill_template(template, preds, order=["value"])
