"""Quality rules: an ordered list of threshold conjunctions, learned from labelled statistics.

Sequential covering: a rule grows by the condition with the most information gain on
two thirds of the rows, loses the conditions that do not help on the last third, and
takes the rows it covers out; then the next one is learned. The list becomes one Spark
expression; nothing but DataFrame functions touches the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed sets: white space of words, symbols, and characters for further statistics.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bound of the labelled rows that are used for learning.
SAMPLE_ROWS = 6000
#: Statistics that rules may use.
FEATURES = ["n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "line_words"]


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and, for every whole text, counts of words, characters, symbols, lines and repeats.

    A null text has no words, and 0 in every count. Words are runs without the six ASCII
    white space characters. ``n_repeat_words`` counts words in 3-word windows that
    the text has twice or more. Positions are sorted by the digest of their window, cut
    by the bits that hold the position; neighbours are then compared by their words, so
    the work per text is that of a sort. No shuffle.
    """
    kept = docs.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(columns)), F.coalesce("text", F.lit("")).alias("text"))
    words = kept.withColumn("words", F.array_remove(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), "")).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    n = F.size("words")
    bits = F.when(n < 4, 2).otherwise(F.ceil(F.log2(n + 1)).cast("int"))
    keyed = words.withColumn("bits", bits).withColumn("keys", F.when(n >= 3, F.expr(
        "sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> shiftleft(shiftrightunsigned(xxhash64(w, words[i + 1], words[i + 2]), bits), bits) | cast(i as bigint)))",
    )).otherwise(F.array().cast("array<bigint>")))
    places = keyed.withColumn("places", F.expr("transform(keys, k -> cast(k & (shiftleft(1L, bits) - 1) as int))"))
    same = "(shiftright(keys[{0}], bits) = shiftright(keys[{1}], bits) and words[places[{0}]] = words[places[{1}]] and words[places[{0}] + 1] = words[places[{1}] + 1] and words[places[{0}] + 2] = words[places[{1}] + 2])"
    repeated = places.withColumn("repeated", F.expr(
        f"sort_array(filter(places, (p, i) -> (i > 0 and {same.format('i', 'i - 1')}) or (i < size(places) - 1 and {same.format('i', 'i + 1')})))",
    ))
    covered = F.expr("if(size(repeated) = 0, 0, 3 + aggregate(repeated, named_struct('sum', 0, 'last', cast(null as int)), (a, p) -> named_struct('sum', a.sum + if(a.last is null, 0, least(3, p - a.last)), 'last', p), a -> a.sum))")
    return repeated.select(
        *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)),
        n.cast("long").alias("n_words"), F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"), _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), _without(F.col("text"), UPPER).cast("long").alias("n_upper"), _without(F.col("text"), "!?").cast("long").alias("n_marks"),
    )


def shares(stats: DataFrame) -> DataFrame:
    """The statistics with what rules look at: FEATURES."""
    def per(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return stats.withColumns({
        "mean_word": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "word_chars"), "upper_share": per("n_upper", "word_chars"), "mark_share": per("n_marks", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "line_words": per("n_words", "n_lines"),
    })


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= x[c.feature] > c.cut if c.above else x[c.feature] <= c.cut
    return hit


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Ordered rules for ``bad`` rows.

    A rule stays if at least ``least`` rows of the last third are covered with the
    given ``precision``; else learning ends. Without bad or without good rows there is no rule.
    """
    n = len(bad)
    open_, prune = np.ones(n, bool), np.arange(n) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow = open_ & ~prune
        rule: Rule = ()
        hit = grow.copy()
        while len(rule) < max_conditions:
            p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
            if not p or not q:
                break
            before, best, found = np.log2(p / (p + q)), 0.0, None
            for feature in FEATURES:
                values = x[feature]
                own = np.unique(values[hit])
                if len(own) > 64:
                    own = np.unique(np.quantile(own, np.linspace(0, 1, 65)))
                for cut in (own[:-1] + own[1:]) / 2:
                    for above in (True, False):
                        side = hit & (values > cut if above else values <= cut)
                        a, b = int((side & bad).sum()), int((side & ~bad).sum())
                        gain = a * (np.log2(a / (a + b)) - before) if a else 0.0
                        if gain > best + 1e-9:
                            best, found = gain, Condition(feature, above, float(cut))
            if found is None:
                break
            rule += (found,)
            hit &= _covers((found,), x, n)
        if not rule:
            break
        held = open_ & prune

        def worth(r: Rule) -> float:
            hit = held & _covers(r, x, n)
            p, q = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - q) / (p + q) if p + q else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        hit = held & _covers(rule, x, n)
        if (hit & bad).sum() < max(least, precision * hit.sum()):
            break
        rules.append(rule)
        open_ &= ~_covers(rule, x, n)
    return rules


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the statistics of at most ``sample_rows`` labelled documents, chosen by a digest of their id.

    Null labels and labels of no document are not used; of repeated ones the lower holds.
    Only numbers reach the driver; the chosen ids are broadcast.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    stats = shares(statistics(picked, ["doc_id", "quality"])).select("doc_id", "quality", *FEATURES)
    rows = sorted(stats.collect(), key=lambda r: (hash(r["doc_id"] * 2654435761 % 4294967291), *r))
    return learn({f: np.array([r[f] for r in rows], float) for f in FEATURES}, np.array([r["quality"] == 0 for r in rows], bool))


def rule_column(rules: list[Rule]) -> Column:
    """Number and text of the first rule that covers a row; null if none does."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        hit = rule[0].column()
        for c in rule[1:]:
            hit &= c.column()
        name = F.lit(f"{k}: " + " and ".join(map(str, rule)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], columns: list[str]) -> DataFrame:
    """``columns``, the statistics and ``rule`` (null: none covers the row) of every row."""
    return shares(statistics(docs, columns)).withColumn("rule", rule_column(rules))
