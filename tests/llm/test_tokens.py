import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratemill.llm import packing, simple8b, tokencount
from ratemill.llm.tokens import Encoder, tokenizer_version

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", "Word, word, WORD. word.", "a,. b.. ,. , . é. É,", "x1, 1. -.", " ", "  a", "a  b", "a \nb", "foo <|endoftext|> bar", "x<|endoftext|>", "tab\t x", "é ́x", "it's 's", "a b ", "\n\n a", "ab\xa0 c", "x \x1c y", "ΑΣ s", "İ I", "\x01 a \x01", "a\x01b c", "１２ 3a", "don't. 'S"]


def library(name, texts):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def words(rng, n):
    return " ".join(rng.choice(["the", "ththion", "Erst.", "naïve,", "x1", "\nand", "", "漢字"]) + rng.choice(["", "s", "ed"]) for _ in range(n))


@pytest.mark.parametrize("name", FILES)
def test_remembered_parts_give_the_ids_of_the_library(name, monkeypatch):
    rng = random.Random(4)
    texts = ODD + [words(rng, rng.randint(0, 60)) for _ in range(200)]
    own = Encoder(public_tokenizers.path(name))
    assert own.spaces
    for limit in (500_000, 5):
        monkeypatch.setattr("ratemill.llm.tokens.REMEMBERED", limit)
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == library(name, texts)


def test_words_hold_any_ids():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 59, 60, 61, 500):
        for bits in (1, 2, 15, 33, 60, 63, 64):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True)
            assert (simple8b.unpack(simple8b.pack(ids), n) == ids).all()
    assert len(simple8b.pack(np.zeros(60, np.uint64))) == 1


def test_token_files_round_trip(spark, docs_of, odd_rows, scratch):
    path = public_tokenizers.path(FILES[0])
    simple8b.write_ids(docs_of(odd_rows), scratch, path, 2, shards=3)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in simple8b.read_ids(spark, scratch).collect())
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for (doc_id, _), ids in zip(rows, library(FILES[0], [t or "" for _, t in rows])):
        own = np.array(ids + [2], "<u4").tobytes()
        want.append((at, doc_id, len(ids) + 1, own))
        at += len(ids) + 1
    assert got == want
    simple8b.write_ids(docs_of([]), scratch + "0", path, 2)
    assert simple8b.read_ids(spark, scratch + "0").count() == 0


def test_counts_come_from_the_cache(spark, docs_of, odd_rows, scratch):
    path = public_tokenizers.path(FILES[1])
    want = Counter((i, len((t or "").encode()), len(x)) for (i, t), x in zip(odd_rows, library(FILES[1], [t or "" for _, t in odd_rows])))
    for _ in range(2):
        got = tokencount.token_counts(docs_of(odd_rows), path, scratch).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    stored = spark.read.parquet(scratch)
    assert stored.count() == len({t or "" for _, t in odd_rows}) and {r[0] for r in stored.select("tokenizer").distinct().collect()} == {tokenizer_version(path)}
    # A stored count is used as it is; another version is not.
    spark.read.parquet(scratch).selectExpr("digest", "n_tokens + 1000 n_tokens", "tokenizer").write.parquet(scratch + "-other")
    assert all(r["n_tokens"] >= 1000 for r in tokencount.token_counts(docs_of(odd_rows), path, scratch + "-other").collect())
    assert tokencount.token_counts(docs_of([]), path, scratch + "-none").count() == 0


def filled(runs, capacity):
    bins = {}
    for r in runs:
        for i in range(r.count):
            bins.setdefault(r.sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(rng.choice([1, 2.5, 3.5]), 1)))) for _ in range(400)]
    runs = packing.plan(Counter(lengths), capacity)
    bins = filled(runs, capacity)
    assert Counter(n for own in bins.values() for _, n in own) == Counter(lengths)
    assert all(sum(3 * n > capacity for _, n in own) <= 2 for own in bins.values())
    assert sorted(bins) == list(range(len(bins)))
    ranks = sorted((r.length, r.first, r.count) for r in runs)
    assert all(a[1] + a[2] == b[1] for a, b in zip(ranks, ranks[1:]) if a[0] == b[0])
    # Never worse than best-fit decreasing, item by item.
    free = []
    for n in sorted(lengths, reverse=True):
        own = min((g for g in free if g >= n), default=None)
        free.append((capacity if own is None else free.pop(free.index(own))) - n)
    assert len(bins) <= len(free)


def test_large_items_take_their_longest_partner():
    runs = packing.plan({60: 1, 55: 1, 45: 1, 40: 1}, 100)
    assert sorted(sorted(n for _, n in own) for own in filled(runs, 100).values()) == [[40, 60], [45, 55]]


def test_cuts():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut(1, 2048) == [(0, 1)]


def test_packing_of_documents(docs_of, odd_rows, scratch):
    path, ids_of = public_tokenizers.path(FILES[1]), library(FILES[1], [t or "" for _, t in odd_rows])
    rows = packing.pack_documents(docs_of(odd_rows), path, 0, scratch, capacity=64, with_ids=True).collect()
    want = Counter()
    for (doc_id, _), ids in zip(odd_rows, ids_of):
        for k, (start, length) in enumerate(packing.cut(len(ids) + 1, 64)):
            own = np.array((ids + [0])[start:start + length], "<u4").tobytes()
            want[doc_id, k, start, length, zlib.crc32(own), own] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    assert packing.pack_documents(docs_of([]), path, 0, scratch + "0").count() == 0


def test_packing_remembers_no_more_than_it_is_told(spark, docs_of, scratch):
    """What a worker remembers is bounded by the caller, and the pieces do not depend on it."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Encoder(path, 100)
    assert own.encode([t for _, t in rows[:2]]) == Encoder(path).encode([t for _, t in rows[:2]])
    for _, text in rows[2:]:
        own.encode([text])
    assert len(own.later) <= 100 + 59 and len(own.first) <= 100 + 1
    few, all_ = ({(r["doc_id"], r["piece"], r["ids_crc32"], r["length"]) for r in packing.pack_documents(docs_of(rows), path, 0, f"{scratch}-{n}", 64, remember=n).collect()} for n in (10, None))
    assert few == all_
