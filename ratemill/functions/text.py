"""Text column functions. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratemill.functions.values import ColumnLike, as_column, let, uniform

# Markers and patterns of the prompt and evidence formats.
TARGET_MARKER = "The sample you need to rate:"
RESPONSE_MARKER = "LLM response:"
RATINGS_MARKER = "\nRatings:"
NEXT_TARGET_MARKER = "\nThe sample you need to rate:"
GOLD_MARKERS = ["gold responses", "Gold doctor responses"]
QUERY_PATTERN = r'(?s)Query:\s*"(.*?)"'
GOLD_BEFORE_RATINGS = r"(?imsd)^(?:Gold doctor responses|gold responses):.*?(?=^Ratings:)"
GOLD_BEFORE_END = (
    r"(?imsd)^(?:Gold doctor responses|gold responses):.*?"
    r"(?=^\s*(?:\[Relevant Clinical Guidelines|Now rate|The sample you need to rate:|Sample \d+:)|\z)"
)
GOLD_OF_TARGET = (
    r"(?isd)(?:Gold doctor responses|gold responses):\s*(.*?)"
    r"(?=\n\s*\n(?:Now rate|The sample|$)|$)"
)
METRIC_ALIASES = {"disagree-flag": "disagree_flag", "disagree": "disagree_flag"}
LEAD_IN = r"(?i)^(好的，?)?(这是|以下是)?(您要求的)?(简体中文)?翻译[:：]\s*"
CJK = r"[\x{4e00}-\x{9fff}]"
# The characters that count as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(text: ColumnLike) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(as_column(text), F.lit(SPACES))


def clean_text(text: ColumnLike) -> Column:
    """One line: line breaks and tabs become blanks, ends trimmed, null becomes ''."""
    return strip(F.translate(F.coalesce(as_column(text), F.lit("")), "\n\r\t", "   "))


def collapse_ws(text: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(as_column(text), SPACE_RUN, " "))


def join_fields(*fields: ColumnLike) -> Column:
    """Title and content on one cleaned line."""
    return clean_text(F.concat_ws(" ", *[F.coalesce(as_column(f), F.lit("")) for f in fields]))


def gold_list(answers: ColumnLike) -> Column:
    """Cleaned, non-empty answers; no answers at all gives an empty array."""
    cleaned = F.filter(F.transform(as_column(answers), clean_text), lambda x: x != "")
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def first_gold(answers: ColumnLike) -> Column:
    return F.coalesce(F.try_element_at(as_column(answers), F.lit(1)), F.lit(""))


def first_image(ids: ColumnLike, root: ColumnLike) -> Column:
    return F.concat(as_column(root), F.lit("/"), F.try_element_at(as_column(ids), F.lit(1)))


def _whole_list(text: Column, quotes: str = "true") -> Column:
    """The texts of a JSON list, null where anything stands before or after it."""
    # Wrapped once more, text behind the list is an error and not ignored.
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<string>>", {"allowSingleQuotes": quotes})
    return F.when(text.startswith("[") & (F.size(wrapped) == 1), F.try_element_at(wrapped, F.lit(1)))


def parse_list_text(text: ColumnLike, style: str = "numbered", empty: str = "") -> Column:
    """A list kept as text (JSON or single-quoted) turned into display text.

    ``style``: "numbered" lines, "semicolon" or "space" joined. Text that is no
    list comes back trimmed, and empty text as ``empty``.
    """
    cleaned = strip(F.coalesce(as_column(text), F.lit("")))
    parsed = F.coalesce(_whole_list(cleaned, quotes="false"), _whole_list(cleaned, quotes="true"))
    items = F.filter(F.transform(parsed, strip), lambda x: x != "")
    if style == "numbered":
        joined = F.array_join(
            F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
        )
    elif style in ("semicolon", "space"):
        joined = F.array_join(items, ";" if style == "semicolon" else " ")
    else:
        raise ValueError(f"unknown style {style!r}")
    is_list = cleaned.startswith("[") & (F.size(items) > 0)
    return F.when(cleaned == "", F.lit(empty)).when(is_list, joined).otherwise(cleaned)


def pack_texts(texts: ColumnLike, limit: int, *seed) -> Column:
    """Seeded shuffle, then whole texts while the total stays under ``limit``.

    Stops at the first text that would reach the limit. Blank texts are left out.
    """
    kept = F.filter(as_column(texts), lambda x: strip(x) != "")
    keyed = F.transform(
        kept,
        lambda x, i: F.struct(uniform(*seed, x, i).alias("u"), i.alias("i"), x.alias("text")),
    )
    start = F.struct(
        F.lit(0).alias("total"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("picked")
    )

    def step(acc: Column, item: Column) -> Column:
        text = item["text"]
        stop = acc["full"] | (acc["total"] + F.length(text) >= limit)
        return F.struct(
            F.when(stop, acc["total"]).otherwise(acc["total"] + F.length(text)).alias("total"),
            stop.alias("full"),
            F.when(stop, acc["picked"]).otherwise(F.concat(acc["picked"], F.array(text))).alias("picked"),
        )

    packed = F.aggregate(F.array_sort(keyed), start, step, lambda acc: acc["picked"])
    return F.coalesce(F.array_join(packed, " ; "), F.lit(""))


def normalize_metric_name(name: ColumnLike) -> Column:
    dashed = F.replace(as_column(name), F.lit("_"), F.lit("-"))
    result = dashed
    for alias, metric in METRIC_ALIASES.items():
        result = F.when(dashed == alias, F.lit(metric)).otherwise(result)
    return result


def strip_gold_instructions(text: ColumnLike, replacements: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    result = as_column(text)
    for old, new in replacements:
        result = F.replace(result, F.lit(old), F.lit(new))
    return result


def strip_gold_blocks(text: ColumnLike) -> Column:
    """Remove reference-answer blocks of the examples and of the target."""
    examples = F.regexp_replace(as_column(text), GOLD_BEFORE_RATINGS, "\n")
    target = F.regexp_replace(examples, GOLD_BEFORE_END, "\n")
    return F.regexp_replace(target, r"\n{3,}", "\n\n")


def map_text_blocks(blocks: ColumnLike, change) -> Column:
    """Apply ``change`` to every text block of a content array."""
    return F.transform(
        as_column(blocks),
        lambda b: F.when(b["type"] == "text", b.withField("text", change(b["text"]))).otherwise(b),
    )


def flatten_content(blocks: ColumnLike) -> Column:
    texts = F.transform(F.filter(as_column(blocks), lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.array_join(texts, "\n")


def target_section(text: ColumnLike, marker: str = TARGET_MARKER) -> Column:
    """From the last marker on; the whole text where there is none."""
    text = as_column(text)
    tail = F.substring_index(text, marker, -1)
    return F.when(F.contains(text, F.lit(marker)), F.concat(F.lit(marker), tail)).otherwise(text)


def find_query(text: ColumnLike) -> Column:
    """The quoted query of the target section, null where there is none."""
    section = target_section(text)
    return F.when(F.regexp_like(section, F.lit(QUERY_PATTERN)), F.regexp_extract(section, QUERY_PATTERN, 1))


def find_gold(text: ColumnLike) -> Column:
    """The reference answers of the target section as one line, null where there are none."""
    def one_line(raw: Column) -> Column:
        as_list = F.filter(F.transform(_whole_list(raw, quotes="false"), strip), lambda x: x != "")
        lines = F.filter(
            F.transform(F.split(raw, r"\r\n|\n|\r"), lambda x: strip(F.regexp_replace(x, r"^\s*\d+\.\s*", ""))),
            lambda x: x != "",
        )
        listed = F.when(raw.startswith("["), as_list)
        return let(listed, lambda kept: F.when(kept.isNotNull(), F.array_join(kept, " ")).otherwise(F.array_join(lines, " ")))

    def of_section(section: Column) -> Column:
        raw = strip(F.regexp_extract(section, GOLD_OF_TARGET, 1))
        return F.when(F.regexp_like(section, F.lit(GOLD_OF_TARGET)), let(raw, one_line))

    return let(target_section(text), of_section)


def retrieval_query(text: ColumnLike, mode: str = "both") -> Column:
    query, gold = strip(find_query(text)), find_gold(text)
    if mode == "query":
        return query
    if mode == "gold":
        return gold
    if mode == "both":
        def some(found: Column) -> Column:
            return let(found, lambda part: F.when(part != "", part))

        return some(F.concat_ws(" ", some(query), some(gold)))
    raise ValueError(f"unknown mode {mode!r}")


def truncate_words(text: ColumnLike, limit: int) -> Column:
    """At most ``limit`` characters, cut back to the last blank and marked with dots."""
    text = as_column(text)
    if limit <= 0:
        return text
    cut = strip(F.regexp_replace(F.left(text, F.lit(limit)), r"(?s) [^ ]*\z", ""))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(" ...")))


def _first_position(*positions: Column) -> Column:
    """Smallest position that was found (positions count from 1, 0 is none)."""
    return F.array_min(F.filter(F.array(*positions), lambda p: p > 0))


def _target_start(text: Column) -> Column:
    has = F.contains(text, F.lit(TARGET_MARKER))
    tail = F.substring_index(text, TARGET_MARKER, -1)
    return F.when(has, F.length(text) - F.length(tail) - len(TARGET_MARKER) + 1).otherwise(F.lit(1))


def _locate(needle: str, text: Column, start: Column) -> Column:
    return F.call_function("locate", F.lit(needle), text, start.cast("int"))


def insert_position(text: ColumnLike, location: str, gold_first: bool = False) -> Column:
    """1-based position at which evidence goes in.

    A place that is not found means the end of the text. With ``gold_first``,
    "after_llm_response" also stops before reference answers of the target.
    """
    text = as_column(text)
    start, end = _target_start(text), F.length(text) + 1
    if location == "end":
        return end
    if location in ("after_query", "after_gold"):
        pattern = QUERY_PATTERN if location == "after_query" else GOLD_OF_TARGET
        section = target_section(text)
        match = F.regexp_extract(section, pattern, 0)
        found = F.regexp_like(section, F.lit(pattern))
        at = F.call_function("locate", match, section) + F.length(match) + start - 1
        return F.when(found, at).otherwise(end)
    response = _locate(RESPONSE_MARKER, text, start)
    if location == "before_llm_response":
        return F.when(response > 0, response).otherwise(end)
    if location == "after_llm_response":
        stops = [
            _locate(RATINGS_MARKER, text, response),
            _locate("\ngold responses:", text, response)
            if gold_first
            else _locate(NEXT_TARGET_MARKER, text, response + len(RESPONSE_MARKER)),
        ]
        return F.when(response > 0, F.coalesce(_first_position(*stops), end)).otherwise(end)
    raise ValueError(f"unknown location {location!r}")


def insert_evidence(
    text: ColumnLike,
    evidence: ColumnLike,
    marker: str,
    location: str = "auto",
    mode: str = "both",
    allow_duplicate: bool = False,
    gold_first: bool = False,
) -> Column:
    """Put evidence into a prompt; nothing happens without evidence or, unless
    allowed, where the marker is already there."""
    text, evidence = as_column(text), as_column(evidence)
    if location == "auto":
        location = "after_gold" if mode == "gold" else "after_llm_response"
    position = insert_position(text, location, gold_first)
    joined = F.concat(
        F.substring(text, F.lit(1), position - 1),
        evidence,
        F.substring(text, position, F.length(text)),
    )
    skip = evidence.isNull() | (evidence == "")
    if not allow_duplicate:
        skip = skip | F.contains(text, F.lit(marker))
    return F.when(skip, text).otherwise(joined)


def script_ratio(text: ColumnLike) -> Column:
    """Share of CJK characters among the letters; 0 for text without letters."""
    text = as_column(text)
    cjk = F.regexp_count(text, F.lit(CJK))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(cjk / F.greatest(letters, F.lit(1)), F.lit(0.0))


def clean_generation(text: ColumnLike) -> Column:
    """Drop code fences and lead-in phrases around generated text."""
    inner = F.regexp_replace(strip(text), r"(?i)^```(?:zh|chinese)?\s*", "")
    inner = F.regexp_replace(inner, r"\s*```\z", "")
    return strip(F.regexp_replace(inner, LEAD_IN, ""))


def semantic_text(query: ColumnLike, candidate: ColumnLike, gold=None, caption=None) -> Column:
    """Labelled lines; the caption line only where there is a caption."""
    lines = [F.concat(F.lit("Query: "), F.coalesce(as_column(query), F.lit(""))),
             F.concat(F.lit("LLM response: "), F.coalesce(as_column(candidate), F.lit("")))]
    if gold is not None:
        lines.append(F.concat(F.lit("Gold doctor responses: "), F.coalesce(as_column(gold), F.lit(""))))
    if caption is not None:
        some = as_column(caption)
        lines.append(F.when(strip(some) != "", F.concat(F.lit("Image caption: "), some)))
    return F.concat_ws("\n", *lines)


# Field layouts of the classifier inputs.
LAYOUTS = {
    "candidate": "{candidate}",
    "query_candidate": "[QUERY] {query} [CANDIDATE] {candidate}",
    "context_first": "[IMG] {caption} [QUERY] {query} [CANDIDATE] {candidate}",
    "with_gold": "[QUERY] {query} [CANDIDATE] {candidate} [GOLD] {gold}",
    "zh_query_candidate": "问题：{query} [SEP] 候选回答：{candidate}",
    "zh_candidate_gold": "候选回答：{candidate} [SEP] 参考回答：{gold500}",
    "pair": "Query: {query} | Candidate: {candidate}{image_info}",
}
# Layout per metric; a pair is (layout where the data set name
# holds "iiyi", layout elsewhere).
STRATEGIES = {
    "matched_with_gold": {"*": "with_gold"},
    "matched_without_gold": {"*": "query_candidate"},
    "historical_dataset_specific": {
        "completeness": "candidate",
        "disagree_flag": ("query_candidate", "context_first"),
        "factual-accuracy": ("context_first", "query_candidate"),
        "relevance": "context_first",
        "writing-style": ("context_first", "candidate"),
        "overall": "candidate",
    },
    "historical_no_image": {
        "writing-style": "candidate",
        "completeness": "candidate",
        "disagree_flag": "candidate",
        "factual-accuracy": "query_candidate",
        "relevance": "query_candidate",
        "overall": "query_candidate",
    },
    "zh_with_gold": {"factual-consistency-wgold": "zh_candidate_gold", "writing-style": "candidate"},
    "zh_without_gold": {"factual-consistency-wgold": "zh_query_candidate", "writing-style": "candidate"},
}


def format_example(strategy: str, fields: Mapping[str, ColumnLike] | None = None) -> Column:
    """Classifier input text by metric and data set, null for an unlisted metric."""
    names = {"query": "query_text", "candidate": "candidate", "caption": "image_caption", "gold": "gold_texts",
             "dataset": "dataset", "metric": "metric"}
    cols = {name: F.coalesce(as_column(c), F.lit("")) for name, c in {**names, **(fields or {})}.items()}
    info = strip(F.replace(F.replace(cols["caption"], F.lit("**"), F.lit("")), F.lit("\n"), F.lit(" ")))
    parts = {
        "query": cols["query"],
        "candidate": cols["candidate"],
        "caption": F.left(cols["caption"], F.lit(300)),
        "gold": cols["gold"],
        "gold500": F.left(cols["gold"], F.lit(500)),
        "image_info": F.when(info != "", F.concat(F.lit(" [IMG_INFO]: "), info)).otherwise(F.lit("")),
    }

    def render(layout: str) -> Column:
        pieces = []
        for chunk in LAYOUTS[layout].split("{"):
            name, brace, rest = chunk.partition("}")
            pieces += [parts[name], F.lit(rest)] if brace else [F.lit(name)]
        return F.concat(*pieces)

    result = F.lit(None).cast("string")
    for metric, layout in STRATEGIES[strategy].items():
        if isinstance(layout, tuple):
            column = F.when(F.contains(F.lower(cols["dataset"]), F.lit("iiyi")), render(layout[0])).otherwise(
                render(layout[1])
            )
        else:
            column = render(layout)
        result = column if metric == "*" else F.when(cols["metric"] == metric, column).otherwise(result)
    return result


def group_key(*columns: ColumnLike) -> Column:
    """One text key; the separator cannot occur in ordinary ids."""
    return F.concat_ws("\u0001", *[as_column(c).cast("string") for c in columns])


def chunk_array(text: ColumnLike, limit: int) -> Column:
    """Chunks of at most ``limit`` characters, packed from paragraphs or, where
    there is only one paragraph, from sentences; longer pieces are cut hard."""
    def keep(pieces: Column) -> Column:
        return F.filter(F.transform(pieces, strip), lambda p: p != "")

    def pieces_of(body: Column) -> Column:
        sentences = keep(F.split(body, r"(?<=[.;:])(?U)\s+"))
        return let(keep(F.split(body, r"\n{2,}")), lambda found: F.when(F.size(found) > 1, found).otherwise(sentences))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, piece: Column) -> Column:
        buf, size = acc["buf"], F.length(piece)
        flushed = F.when(buf != "", F.concat(acc["done"], F.array(strip(buf)))).otherwise(acc["done"])
        cuts = F.transform(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(limit)),
            lambda at: strip(F.substring(piece, at, F.lit(limit))),
        )
        joined = F.when(buf != "", F.concat(buf, F.lit("\n\n"), piece)).otherwise(piece)
        over = F.length(buf) + size + 2 > limit
        return (
            F.when(size > limit, F.struct(F.concat(flushed, cuts).alias("done"), F.lit("").alias("buf")))
            .when(over, F.struct(flushed.alias("done"), piece.alias("buf")))
            .otherwise(F.struct(acc["done"].alias("done"), joined.alias("buf")))
        )

    def packed(body: Column) -> Column:
        done = F.aggregate(
            pieces_of(body),
            start,
            step,
            lambda acc: F.when(acc["buf"] != "", F.concat(acc["done"], F.array(strip(acc["buf"])))).otherwise(acc["done"]),
        )
        return F.when(F.length(body) <= limit, F.array(body)).otherwise(done)

    return let(strip(text), packed)


def overlapping_windows(text: ColumnLike, size: int = 1024, overlap: int = 100) -> Column:
    """Word windows of ``size`` that share ``overlap`` words with the next one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap

    def windows(words: Column) -> Column:
        count = F.greatest(F.ceil((F.size(words) - overlap) / F.lit(step)), F.lit(1)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "),
        )

    return let(F.filter(F.split(collapse_ws(text), " "), lambda w: w != ""), windows)
