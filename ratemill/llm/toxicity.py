"""Toxicity by averaged subword embeddings and a linear softmax, trained together.

A word is the sum of the vectors of its character n-grams and of itself, all by
hashed bucket, so an unseen spelling shares vectors with known ones. A text is the
mean over its words. The softmax is linear, so each word adds a fixed amount to a
text's margin; tasks remember it by word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm.memory import remembered
from ratemill.llm.tokens import slices

WORD = re.compile(r"\w+")
#: Hash buckets of words and n-grams, length of a vector, n-gram sizes.
BUCKETS, WIDTH, GRAMS = 1 << 15, 8, (3, 4, 5)
#: Neutral words in every mean, so that a few unknown words decide nothing.
NEUTRAL = 8
#: Bound of the labelled rows that are used for fitting, in order of a digest of their id.
SAMPLE_ROWS = 6000
#: Words remembered by one worker.
REMEMBERED = 150_000


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its n-grams with marks at both ends. Texts of digits or single marks have them too."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) & (BUCKETS - 1) for g in grams]


#: Factor that keeps the small shares of a text within the range of 16-bit numbers.
SHARES = 1000.0


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its words that each has, as 16-bit numbers."""
    words = Counter(WORD.findall(text.lower()))
    index: list[int] = []
    value: list[float] = []
    for word, n in words.items():
        own = features(word)
        index += own
        value += [n / len(own)] * len(own)
    dense = np.bincount(np.array(index, np.int64), np.array(value), BUCKETS) * (SHARES / (sum(words.values()) + NEUTRAL))
    at = np.flatnonzero(dense)
    return at.astype(np.uint16), dense[at].astype(np.float16)


@dataclass
class Model:
    """``margin`` of each bucket and the bias; the score is the logistic of their sum for a text."""

    margin: np.ndarray
    bias: float
    _version: int | None = None

    def word(self, word: str, known: dict[str, float]) -> float:
        value = known.get(word)
        if value is None:
            value = float(self.margin[features(word)].mean())
            if len(known) < REMEMBERED:
                known[word] = value
        return value

    def logit(self, words: dict[str, int]) -> float:
        known = remembered(f"margins {self.version}")
        return sum(self.word(w, known) * n for w, n in words.items()) / (sum(words.values()) + NEUTRAL) + self.bias

    @property
    def version(self) -> int:
        """Tells the memories of several models apart."""
        if self._version is None:
            self._version = zlib.crc32(self.margin.tobytes())
        return self._version

    def score(self, text: str) -> float:
        """Between 0 and 1; a text without words gets the bias alone."""
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.logit(Counter(WORD.findall(text.lower())))))))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 10, batch: int = 128, rate: float = 0.02, drop: float = 0.2, seed: int = 7) -> Model:
    """Embeddings and softmax together, by Adam on the class-weighted cross entropy.

    Both classes weigh the same, so 0.5 is where both are equally likely if equally
    frequent. With one class only, or no row, every text scores the share of label 1.
    """
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(seed)
    scale = 30.0  # means are small: a few words of many decide
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, soft, bias)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(order), batch):
            rows = order[low:low + batch]
            dense = np.zeros((len(rows), BUCKETS), np.float32)
            for k, r in enumerate(rows):
                at, shares = vectors[r]
                dense[k, at] = shares
            dense *= scale / SHARES / (1 - drop) * (rng.random(BUCKETS, np.float32) >= drop)
            hidden = dense @ table
            logits = hidden @ soft + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows].astype(int)] -= 1
            p *= (weight[rows] / weight[rows].sum())[:, None]
            gradients = (dense.T @ (p @ soft.T), hidden.T @ p, p.sum(axis=0))
            step += 1
            for parameter, g, (m, v) in zip((table, soft, bias), gradients, state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                parameter -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    margin = scale * (table @ (soft[:, 1] - soft[:, 0]))
    return Model(margin.astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, keep=None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled documents, whole texts of at most ``sample_rows`` of them.

    ``keep`` is a column on ``doc_id`` that says which rows labels may come from.
    Tasks turn texts into sparse vectors of at most BUCKETS entries; those reach the driver.
    Labels that are null, or of no document, are not used; of repeated ones the higher holds. Which rows are used is fixed by a digest of ``doc_id``. The chosen
    ids are broadcast, at most ``sample_rows`` of them.
    """
    import pyarrow as pa

    def vectors(batches):
        for (toxic, keys), texts in slices(batches, ["toxic", "key"]):
            own = [vector(t) for t in texts]
            columns = [pa.array(toxic, pa.int32()), pa.array(keys, pa.int64()), pa.array([a.tobytes() for a, _ in own], pa.binary()), pa.array([v.tobytes() for _, v in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "key", "buckets", "shares"])

    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if keep is not None:
        known = known.filter(keep)
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", F.xxhash64("doc_id", "text").alias("key"), "text")
    found = texts.mapInArrow(vectors, "toxic int, key long, buckets binary, shares binary").collect()
    found.sort(key=lambda r: (r["key"], r["toxic"]))
    return fit([(np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float16)) for r in found], [r["toxic"] for r in found])


def score_texts(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of every row and ``score`` of its whole text; null texts count as empty. No shuffle."""
    import pyarrow as pa

    schema = docs.select(*columns).schema
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.margin, model.bias))

    def score(batches):
        own = sent.value
        for batch in batches:
            scores = [own.score(t) for _, texts in slices([batch], []) for t in texts]
            kept = [batch.column(f"kept_{i}") for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=[*columns, "score"])

    named = docs.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(columns)), "text")
    return named.mapInArrow(score, type(schema)(list(schema.fields)).add("score", "double"))
