"""BPE ids by a minimal acyclic transducer of frequent words, and back.

The most frequent words of a corpus are compiled with their ids into an automaton whose
equal suffixes are one state. Every transition adds a number; the sum along a word is its
place in the table of ids. The automaton, that table and the tokenizer's merges are one
file of plain arrays, which Spark sends to every executor and tasks map into memory. Words
that the automaton does not have are merged exactly, by the tokenizer's ranks, many at once.

This holds for tokenizers that drop white space and end words with a suffix. Words are split
here in texts of ASCII and Latin letters, whose classes and lower case no Unicode version
changed; what lies between spaces and has other characters goes to the library.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.llm.memory import remembered
from ratemill.llm.tokens import OTHER, WORD_SPLIT, slices

#: Words of a lexicon, at most.
MOST_WORDS = 200_000
#: Different parts of texts counted by one task before it hands them on.
COUNTED = 200_000
#: Characters of texts encoded at once; a longer text is on its own.
SLICE = 4_000_000
#: Steps of a doubling in which frequencies are told apart.
STEPS = 8
#: Bytes of a word up to which words are merged together; longer ones are merged by the library.
LONG = 96

_WORD = regex.compile(WORD_SPLIT)
_NEVER = np.iinfo(np.int32).max


# ---------------------------------------------------------------- the automaton


def automaton(words: Sequence[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of distinct words in ascending order.

    ``keys`` are 256 * state + byte of every transition, ascending; ``targets`` its state;
    ``adds`` what it adds to the number of a word; ``final`` marks the states that end a word.
    """
    known: dict[tuple, int] = {}
    shapes: list[tuple[bool, tuple]] = []
    # States of the last word that may still grow: [ends a word, transitions].
    path: list[list] = [[False, []]]

    def settled(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in known:
            known[shape] = len(shapes)
            shapes.append(shape)
        return known[shape]

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for at in range(len(last), same, -1):
            state = settled(path.pop())
            path[-1][1].append((last[at - 1], state))
        path += [[False, []] for _ in word[same:]]
        path[-1][0], last = True, word
    for at in range(len(last), 0, -1):
        state = settled(path.pop())
        path[-1][1].append((last[at - 1], state))
    root = settled(path[0])
    # States are settled before those that lead to them, so their words can be counted in this order.
    count = []
    keys, targets, adds = [], [], []
    for state, (final, moves) in enumerate(shapes):
        n = int(final)
        for byte, target in moves:
            keys.append(256 * state + byte)
            targets.append(target)
            adds.append(n)
            n += count[target]
        count.append(n)
    return {"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "adds": np.array(adds, np.int32), "final": np.array([f for f, _ in shapes], np.uint8), "root": np.array([root], np.int64)}


def word_numbers(arrays: dict[str, np.ndarray], words: Sequence[bytes]) -> np.ndarray:
    """The number of each word, -1 where the automaton does not have it. Follows all words byte by byte."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.full(len(words), -1, np.int64)
    keys = arrays["keys"]
    if not len(words) or not len(keys):
        return out
    flat = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(lengths) - lengths
    alive = np.arange(len(words))
    state, number = np.full(len(words), arrays["root"][0]), np.zeros(len(words), np.int64)
    step = 0
    while len(alive):
        ended = lengths[alive] == step
        done = alive[ended]
        out[done] = np.where(arrays["final"][state[ended]] == 1, number[ended], -1)
        alive, state, number = alive[~ended], state[~ended], number[~ended]
        wanted = 256 * state + flat[begin[alive] + step]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        there = keys[at] == wanted
        at = at[there]
        alive, state, number = alive[there], arrays["targets"][at].astype(np.int64), number[there] + arrays["adds"][at]
        step += 1
    return out


# ---------------------------------------------------------------- merges


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if it can be printed, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def merge_table(spec: dict) -> dict[str, np.ndarray]:
    """Ids of single bytes, inside and at the end of a word, and all merges ordered by their pair of ids."""
    model, letters = spec["model"], _byte_letters()
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(key)
    return {
        "inside": np.array([vocab[c] for c in letters], np.int32), "ending": np.array([vocab[c + suffix] for c in letters], np.int32),
        "pairs": key[order], "ranks": order.astype(np.int32), "merged": np.array([vocab[a + b] for a, b in pairs], np.int32)[order],
    }


def merge_words(arrays: dict[str, np.ndarray], words: Sequence[bytes]) -> list[bytes]:
    """Ids of words: in every word the pair of least rank, the leftmost one, is merged until none is left."""
    out = [b""] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for low in range(0, len(order), 4000):
        own = order[low:low + 4000]
        lengths = np.array([len(words[i]) for i in own])
        width = int(lengths.max())
        codes = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in own), np.uint8).reshape(-1, width)
        ids = arrays["inside"][codes].astype(np.int64)
        rows = np.arange(len(own))
        ids[rows, lengths - 1] = arrays["ending"][codes[rows, lengths - 1]]
        ids[np.arange(width)[None, :] >= lengths[:, None]] = -1
        for i, row in zip(own, _merged(arrays, ids)):
            out[i] = row[row >= 0].astype("<u4").tobytes()
    return out


def _ranks(arrays: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair and the id it merges to."""
    wanted = left << 32 | right
    at = np.minimum(np.searchsorted(arrays["pairs"], wanted), len(arrays["pairs"]) - 1)
    there = (arrays["pairs"][at] == wanted) & (right >= 0)
    return np.where(there, arrays["ranks"][at], _NEVER), np.where(there, arrays["merged"][at], -1)


def _merged(arrays: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Rows of ids, -1 behind the last one, after all merges."""
    n, width = ids.shape
    if width == 1:
        return ids
    out, open_ = ids.copy(), np.arange(n)
    rank, new = _ranks(arrays, ids[:, :-1], ids[:, 1:])
    while True:
        at = rank.argmin(axis=1)
        rows = np.arange(len(ids))
        more = rank[rows, at] < _NEVER
        out[open_[~more]] = ids[~more]
        if not more.any():
            return out
        open_, ids, rank, new, at = open_[more], ids[more], rank[more], new[more], at[more]
        rows, place = np.arange(len(ids)), np.arange(width)[None, :]
        ids[rows, at] = new[rows, at]
        # The right half of the pair goes, what follows moves up.
        ids = np.take_along_axis(ids, np.minimum(place + (place > at[:, None]), width - 1), 1)
        ids[:, -1] = -1
        closer = np.minimum(place[:, :-1] + (place[:, :-1] > at[:, None]), width - 2)
        rank, new = np.take_along_axis(rank, closer, 1), np.take_along_axis(new, closer, 1)
        rank[:, -1], new[:, -1] = _NEVER, -1
        for beside in (at - 1, at):
            there = (beside >= 0) & (beside < width - 1)
            r, b = rows[there], beside[there]
            rank[r, b], new[r, b] = _ranks(arrays, ids[r, b], ids[r, b + 1])


# ---------------------------------------------------------------- the file


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def _spec(path: str) -> dict:
    """The tokenizer file, if the lexicon can stand for it."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kinds = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = steps[0].get("pattern") == {"Regex": WORD_SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    loose = any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
    if not (split and kinds == ["NFC", "Replace", "Lowercase"] and model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not loose and spec.get("decoder") is None):
        raise ValueError(f"{path} is no tokenizer of lower-case words with an end-of-word suffix")
    return spec


def lexicon_bytes(words: Sequence[str], tokenizer: str) -> bytes:
    """The lexicon's file: the number of arrays, a row of (name, type, length) for each, then the arrays."""
    ordered = sorted({w.encode() for w in words} - {b""})
    merges = merge_table(_spec(tokenizer))
    short = [w for w in ordered if len(w) <= LONG]
    ids = merge_words(merges, short)
    arrays = automaton(short) | merges | {"starts": np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int64), "ids": np.frombuffer(b"".join(ids), "<u4")}
    head = [struct.pack("<q", len(arrays))]
    for name, array in arrays.items():
        head.append(struct.pack("<8s8sq", name.encode(), array.dtype.str.encode(), len(array)))
    body = [array.tobytes() + b"\0" * (-array.nbytes % 8) for array in arrays.values()]
    return b"".join(head + body)


def _mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a lexicon file, mapped into memory."""
    data = np.asarray(np.memmap(path, np.uint8, "r"))
    count = struct.unpack_from("<q", data)[0]
    at, arrays = 8 + 24 * count, {}
    for k in range(count):
        name, kind, length = struct.unpack_from("<8s8sq", data, 8 + 24 * k)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        arrays[name.rstrip(b"\0").decode()] = data[at:at + length * dtype.itemsize].view(dtype)
        at += -(-length * dtype.itemsize // 8) * 8
    return arrays


class Lexicon:
    """A mapped lexicon file with its tokenizer."""

    def __init__(self, path: str, tokenizer: str) -> None:
        self.arrays = _mapped(path)
        self.library = _library(tokenizer)
        self.special = [t["content"] for t in _spec(tokenizer).get("added_tokens") or []]

    def parts(self, text: str) -> list[str]:
        """What stands between white space, in lower case; with a zero before it what is left to the library."""
        if not OTHER.search(text) and not any(s in text for s in self.special):
            return text.lower().split()
        out = []
        for part in text.split(" "):
            if OTHER.search(part) or any(s in part for s in self.special):
                out.append("\0" + part)
            else:
                out += part.lower().split()
        return out

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        numbers = word_numbers(self.arrays, raw)
        seen = np.flatnonzero(numbers >= 0)
        starts = self.arrays["starts"]
        lows = starts[numbers[seen]]
        sizes = starts[numbers[seen] + 1] - lows
        ends = np.cumsum(sizes)
        gathered = self.arrays["ids"][np.arange(ends[-1] if len(ends) else 0) + np.repeat(lows - (ends - sizes), sizes)].tobytes()
        out = {words[k]: gathered[a:b] for k, a, b in zip(seen.tolist(), (4 * (ends - sizes)).tolist(), (4 * ends).tolist())}
        new = [k for k in np.flatnonzero(numbers < 0).tolist() if len(raw[k]) <= LONG]
        out.update(zip([words[k] for k in new], merge_words(self.arrays, [raw[k] for k in new])))
        left = [w for w in words if w not in out]
        out.update(zip(left, self.whole(left)))
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of distinct parts."""
        single = [p for p in parts if p.isalpha()]
        mixed = {p: _WORD.findall(p) for p in parts if not p.isalpha() and p[0] != "\0"}
        out = self.word_ids(list({*single}.union(*mixed.values())))
        out.update([(p, b"".join(map(out.__getitem__, words))) for p, words in mixed.items()])
        left = [p for p in parts if p[0] == "\0"]
        out.update(zip(left, self.whole([p[1:] for p in left])))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.parts(t) for t in texts]
        known = self.ids(list(set().union(*split)))
        return [b"".join(map(known.__getitem__, parts)) for parts in split]


def opened(name: str, tokenizer: str) -> Lexicon:
    """The lexicon that Spark sent to this executor; one per worker, as long as it is asked for."""
    own = remembered(f"lexicon {name}")
    if not own:
        own["lexicon"] = Lexicon(SparkFiles.get(name), tokenizer)
    return own["lexicon"]


# ---------------------------------------------------------------- jobs


def frequent_words(docs: DataFrame, scratch: str, most: int = MOST_WORDS) -> list[str]:
    """At most ``most`` words, the more frequent ones, counted in all texts.

    Frequencies are told apart in STEPS steps of a doubling; the words of the last step that
    does not fit are left out together. The driver gets one row per step, then these words;
    the table of all words goes to ``scratch``.
    """
    import pyarrow as pa

    def counts(batches: Iterator):
        found: Counter[str] = Counter()

        def batch():
            # What the library has to split is not counted; here other characters only end a word.
            words: Counter[str] = Counter()
            for part, n in found.items():
                for word in (part,) if part.isalpha() else _WORD.findall(part):
                    words[word] += n
            kept = [w for w in words if len(w) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([words[w] for w in kept], pa.int64())], names=["word", "n"])

        for _, texts in slices(batches, []):
            for text in texts:
                found.update(text.lower().split())
                if len(found) >= COUNTED:
                    yield batch()
                    found.clear()
        yield batch()

    counted = docs.select("text").mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    stepped = counted.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int"))
    stepped.select("word", "step").write.mode("overwrite").parquet(f"{scratch}/words")
    words = docs.sparkSession.read.parquet(f"{scratch}/words")
    left, least = most, None
    for row in sorted(words.groupBy("step").count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    if least is None:
        return []
    return sorted(r["word"] for r in words.filter(F.col("step") >= least).collect() if not OTHER.search(r["word"]))


def send_lexicon(spark: SparkSession, words: Sequence[str], tokenizer: str, uri: str) -> str:
    """Compile the words, write the file to ``uri`` in the shared folder and have Spark send it to executors. Gives its name there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(lexicon_bytes(words, tokenizer)))
    finally:
        stream.close()
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[-1]


def encode_texts(docs: DataFrame, lexicon: str, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` of every row: the ids that the library gives the whole text without special tokens added.

    Null text is empty and has no ids; equal rows stay; other columns are not read; an empty
    table stays empty. A task holds a few texts, and their distinct words.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind, wanted = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)

    def rows(batches: Iterator):
        for (keys,), texts in slices(batches, [key], most=SLICE):
            own = opened(lexicon, tokenizer).encode(texts)
            ends = np.cumsum([0, *(len(i) // 4 for i in own)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(own), "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(keys, wanted), ids], names=[key, "ids"])

    return docs.select(key, "text").mapInArrow(rows, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """``key, ids, text`` of every row with ``ids``: tokens with blanks between, as the library writes them where a file names no decoder."""
    import pyarrow as pa

    kind = encoded.schema[key].dataType.simpleString()

    def rows(batches: Iterator):
        spec = _spec(tokenizer)
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        tokens = np.empty(max(names.values()) + 1, object)
        for token, i in names.items():
            tokens[i] = token
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = part.column("ids")
                texts = [" ".join(tokens[i.values.to_numpy()].tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(key), ids, pa.array(texts, pa.string())], names=[key, "ids", "text"])

    return encoded.select(key, "ids").mapInArrow(rows, f"`{key}` {kind}, ids array<int>, text string")
