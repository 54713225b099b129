"""Personal data: fixed patterns, and further spans that boosted trees accept.

Generators propose spans in looser forms than the patterns allow. Trees on form
and context, fitted to a small labelled table of such forms, say how likely each is;
a threshold per kind, set on held-out rows of the table, decides. What the patterns
ask for (a plus sign, a checksum) is no feature, so like forms without it can be found.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: Fixed patterns. A lookbehind and possessive repeats say what leftmost matching means anyway, but keep long runs linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Stretches that hold every match of the three number patterns.
NUMBERS = re.compile(r"[0-9+(][0-9\x20().,:/+-]{5,}")

#: Looser forms. Repeats are bounded.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){0,4}"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:[.,:][0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,20}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])"),
}
CONTEXT = re.compile(r"(?:phone|tel|call|fax|mobile|e-?mail|mail|contact|card|visa|credit|pay|host|server|ip|address)\W{0,3}$", re.I)

#: Labelled forms: the span stands between ⟦ and ⟧, # is any digit, % one from 1 to 9, N a number up to 255, @w a word.
#: The first list of a kind is personal data, the second only looks like it.
TABLE = {
    "email": (
        ["@w ⟦@w(at)@w.@w⟧ @w", "mail ⟦@w.@w (at) @w.@w⟧", "e-mail: ⟦@w [at] @w [dot] @w⟧ or", "contact ⟦@w##[at]@w.@w⟧,", "⟦@w@@w(dot)@w⟧ @w", "@w ⟦@w_@w(at)@w(dot)@w⟧.", "write to ⟦@w-@w [at] @w-@w.@w⟧"],
        ["meet ⟦@w (at) noon⟧", "the ⟦@w [at] the⟧ @w", "sold ⟦#@%#⟧ each", "⟦@w@home⟧ @w", "look ⟦@w (at) @w⟧ now", "a ⟦##@###⟧ b", "@w ⟦@w[at]@w⟧ @w"],
    ),
    "ip": (
        ["server ⟦10,N,N,N⟧ is", "host: ⟦N,N,N,N⟧", "ip ⟦N:N:N:N⟧ @w", "address ⟦%##,%##,N,N⟧.", "the ip address ⟦%##:%##:N:N⟧", "host ⟦192,168,N,N⟧"],
        ["at ⟦%#:##:##:##⟧ today", "⟦%,%,%,%⟧ @w", "took ⟦##:##:##:##⟧.", "pages ⟦%#,%#,%#,%#⟧ and", "counts ⟦N,N,N,N⟧ @w", "@w ⟦%##,%##,%##,%##⟧ @w", "score ⟦%:%:%:%⟧"],
    ),
    "card": (
        ["card ⟦####.####.####.####⟧ @w", "visa: ⟦####/####/####/####⟧", "credit ⟦#### #### #### ####⟧ exp", "pay by card ⟦####-####-####-####⟧,", "card ⟦################⟧ @w", "visa ⟦#### ###### #####⟧"],
        ["@w ⟦################⟧ @w", "id ⟦##################⟧", "⟦2024-##-## ##-##-##⟧ @w", "isbn ⟦978-#-##-######-#⟧", "order ⟦####-####-####⟧ @w", "@w ⟦N.N.N.###⟧ @w", "at ⟦20############⟧.", "@w ⟦#### #### #### ####⟧ @w", "@w ⟦####.####.####.####⟧ @w"],
    ),
    "phone": (
        ["call ⟦(%##) ###-####⟧ now", "tel ⟦0## #### ####⟧", "phone: ⟦%##-###-####⟧ @w", "mobile ⟦0%## #######⟧.", "fax: ⟦(0##) ### ## ##⟧", "@w ⟦(%##) ###-####⟧ @w", "@w ⟦(0%##) ######⟧, @w", "contact ⟦%##.###.####⟧ or"],
        ["on ⟦20##-##-##⟧ @w", "⟦%#.0%.20##⟧ @w", "order ⟦########⟧ @w", "@w ⟦N.N.N.N⟧ @w", "at ⟦20##-##-## ##⟧:", "@w ⟦%##,###⟧ ###", "@w ⟦##########⟧ @w", "@w#⟦########⟧@w", "@w ⟦# # # # # # # #⟧ @w", "pages ⟦%##-%## %##-%##⟧", "@w ⟦%##-###-####⟧ @w"],
    ),
}
#: Random fillings of each form.
FILLINGS = 45
#: Share of accepted rows that must be right on held-out rows of the table.
PRECISION = 0.98


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[0::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _valid(kind: str, own: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in own.split("."))
    digits = re.sub("[^0-9]", "", own)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def stretches(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in NUMBERS.finditer(text)]


def base_spans(text: str, numbers: list[tuple[int, int]]) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping per kind; failing ones are dropped."""
    found = list(_emails(text))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, *m.span()) for a, b in numbers for m in pattern.finditer(text, a, b) if _valid(kind, m[0])]
    return found


def joined(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def overlaps(covered: tuple[list[int], list[int]], start: int, end: int) -> bool:
    at = bisect_left(covered[0], end)
    return at > 0 and covered[1][at - 1] > start


def candidates(text: str, numbers: list[tuple[int, int]]) -> list[Span]:
    """Spans in looser forms; they may overlap."""
    found: list[Span] = []
    if "@" in text or "at]" in text or "at)" in text:
        for mark in re.finditer(r"@|[\[(]at[\])]", text):
            # Each mark has a proposal of its own, whatever stands before: the local part that ends there.
            end = mark.start() - (mark[0] != "@" and text[mark.start() - 1:mark.start()] == " ")
            start = end
            while start > max(0, end - 64) and text[start - 1] in LOCAL:
                start -= 1
            around = LOOSE["email"].match(text, start, mark.end() + 320) if start < end else None
            if around:
                found.append(("email", *around.span()))
    for kind in KINDS[1:]:
        found += [(kind, *m.span()) for a, b in numbers for m in LOOSE[kind].finditer(text, a, b)]
    return list(dict.fromkeys(found))


def features(text: str, span: Span) -> list[float]:
    """Form and context. A plus sign, a checksum and the kind of separator of an address are left out."""
    kind, start, end = span
    own = text[start:end].lstrip("+")
    digits = [c for c in own if c.isdigit()]
    groups = [len(g) for g in re.findall("[0-9]+", own)] or [0]
    before, after = text[max(0, start - 24):start].rstrip("+ "), text[end:end + 2]
    values = [int(g) for g in re.findall("[0-9]+", own)] or [0]
    return [
        len(own), len(digits), len(digits) / max(1, len(own)), len(groups), max(groups), min(groups), groups[-1], own.count(" "), own.count("-"), own.count(".") if kind == "email" else 0,
        own.count("("), len(set(digits)), float(digits[0]) if digits else -1, min(max(values), 1000) if kind == "ip" else 0, float(bool(CONTEXT.search(before))), float(before[-1:].isalpha()),
        float(before[-1:].isdigit()), float(after[:1].isalnum()), float(after[:1] in ("", " ", "\n", ".", ",", "!")), float(len(own) - len(own.rstrip("."))),
    ]


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut) at the root and below, four leaf values each."""

    prior: float
    trees: list[tuple] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for (f, c), (fl, cl), (fr, cr), leaves in self.trees:
            right = x[:, f] > c
            out += leaves[2 * right + np.where(right, x[:, fr] > cr, x[:, fl] > cl)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3) -> Trees:
    """Newton boosting on the logistic loss; cuts at quantiles."""
    share = float(np.clip(y.mean(), 0.01, 0.99))
    model = Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])) for f in range(x.shape[1])]
    margin = np.full(len(x), model.prior)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best, found = -1.0, (0, np.inf)
        for f, own in enumerate(cuts):
            for c in own:
                right = rows & (x[:, f] > c)
                left = rows & ~right
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1)
                if right.any() and left.any() and gain > best + 1e-12:
                    best, found = gain, (f, float(c))
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        everything = np.ones(len(x), bool)
        root = split(everything, g, h)
        right = x[:, root[0]] > root[1]
        low, high = split(~right, g, h), split(right, g, h)
        leaf = 2 * right + np.where(right, x[:, high[0]] > high[1], x[:, low[0]] > low[1])
        values = np.array([-rate * g[leaf == k].sum() / (h[leaf == k].sum() + 1) for k in range(4)])
        model.trees.append((root, low, high, values))
        margin = margin + values[leaf]
    return model


def filled(form: str, rng: random.Random) -> tuple[str, int, int]:
    """A text of the form, and where the span is."""
    def one(m: re.Match) -> str:
        word = "".join(rng.choice(["ba", "lo", "ri", "ten", "mu", "sa", "kor", "ne"]) for _ in range(rng.randint(1, 3)))
        return {"#": str(rng.randrange(10)), "%": str(rng.randrange(1, 10)), "N": str(rng.randrange(256)), "@w": word}[m[0]]

    text = re.sub("@w|[#%N]", one, form)
    start, end = text.index("⟦"), text.index("⟧") - 1
    return text.replace("⟦", "").replace("⟧", ""), start, end


def labelled_spans(table: dict = TABLE, fillings: int = FILLINGS, seed: int = 11) -> list[tuple[str, int, list[float], bool]]:
    """(kind, fold, features, personal) of every filling of every form."""
    rng, rows = random.Random(seed), []
    for kind, sides in table.items():
        for personal, forms in zip((True, False), sides):
            for form in forms:
                for fold in range(fillings):
                    text, start, end = filled(form, rng)
                    rows.append((kind, fold % 3, features(text, (kind, start, end)), personal))
    return rows


def fit(rows: list[tuple[str, int, list[float], bool]]) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold of each kind, from (kind, fold, features, personal).

    Folds 1 and 2 of 3 fit, fold 0 sets the threshold: the lowest margin at which the
    share of right ones, counted with one error more, reaches PRECISION. A kind whose rows are
    all alike gets no trees and adds nothing.
    """
    models = {}
    for kind in KINDS:
        own = [r for r in rows if r[0] == kind]
        fold, y = np.array([r[1] for r in own], int), np.array([r[3] for r in own], float)
        if len(set(y[fold != 0])) < 2:
            continue
        x = np.array([r[2] for r in own], float)
        trees = boost(x[fold != 0], y[fold != 0])
        margin, right = trees.margin(x[fold == 0]), y[fold == 0]
        order = np.argsort(-margin, kind="stable")
        share = np.cumsum(right[order]) / (np.arange(len(order)) + 2)
        # A threshold takes all candidates of one margin or none, and none that is more likely wrong.
        last = np.append(np.diff(margin[order]) < 0, True) & (margin[order] > 0)
        good = np.flatnonzero((share >= PRECISION) & last)
        if len(good):
            models[kind] = (trees, float(margin[order[good[-1]]]))
    return models


def train(table: dict = TABLE) -> dict[str, tuple[Trees, float]]:
    """Trees and thresholds from the labelled table; no document is read for it."""
    return fit(labelled_spans(table))


def all_spans(text: str, models: dict[str, tuple[Trees, float]]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the accepted candidates that overlap none before them."""
    numbers = stretches(text)
    base = base_spans(text, numbers)
    scored = []
    proposed, covered = candidates(text, numbers) if models else [], joined(base)
    for kind, (trees, threshold) in models.items():
        own = [c for c in proposed if c[0] == kind and not overlaps(covered, c[1], c[2])]
        if own:
            margin = trees.margin(np.array([features(text, c) for c in own], float))
            scored += [(-m, c) for m, c in zip(margin, own) if m >= threshold]
    taken: list[Span] = []
    starts, ends = [], []
    for _, span in sorted(scored):
        if not overlaps((starts, ends), span[1], span[2]):
            taken.append(span)
            at = bisect_left(starts, span[1])
            starts.insert(at, span[1])
            ends.insert(at, span[2])
    return base, sorted(base + taken, key=lambda s: (KINDS.index(s[0]), s[1]))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones joined, replaced by the kind of its first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find(docs: DataFrame, models: dict[str, tuple[Trees, float]], columns: list[str]) -> DataFrame:
    """``columns`` of every row, ``base`` and ``spans`` (arrays of kind, start, end) and ``redacted``.

    Positions count code points, the end is exclusive. A null text has no spans and stays
    null in ``redacted``; repeated rows stay. No shuffle. ``columns`` may be any of the table.
    """
    import pyarrow as pa
    span = ArrayType(StructType().add("kind", "string").add("start", IntegerType()).add("end", IntegerType()))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def as_rows(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def spans_of(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                found = [all_spans(t or "", own) for t in texts]
                clean = [t if t is None else redact(t, s) for t, (_, s) in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(f"kept_{i}") for i in range(len(columns))), pa.array([as_rows(b) for b, _ in found], arrow), pa.array([as_rows(s) for _, s in found], arrow), pa.array(clean, pa.string()),
                ], names=[*columns, "base", "spans", "redacted"])

    kept = StructType(list(docs.select(*columns).schema.fields))
    schema = kept.add("base", span).add("spans", span).add("redacted", "string")
    return docs.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(columns)), "text").mapInArrow(spans_of, schema)
