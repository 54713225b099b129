"""The word lexicon, the prefix trie and the filter audit against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratemill.llm import filteraudit, lexicon, prefixtrie
from ratemill.llm.queries import QUERIES

FILE = public_tokenizers.path("word_bpe_49k.json")
SPACE = "\x20\t\n\x0b\x0c\r"


def some_words(rng, n):
    return ["".join(rng.choice(["the", "in", "er", "é", "st", "ñ", "q", "ing"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_automaton_numbers_every_word_once_and_shares_suffixes():
    rng = random.Random(1)
    words = sorted({w.encode() for w in some_words(rng, 3000)})
    arrays = lexicon.automaton(words)
    assert sorted(lexicon.word_numbers(arrays, words)) == list(range(len(words)))
    others = [w + b"x" for w in words[:200]] + [w[:-1] for w in words[:200] if w[:-1] not in words] + [b"", b"zz"]
    assert (lexicon.word_numbers(arrays, others) == -1).all()
    ended = lexicon.automaton(sorted(a + b for a in (b"walk", b"talk", b"link") for b in (b"", b"s", b"ed", b"ing")))
    # Three stems in k share all of what follows: 12 words have one tail.
    assert len(ended["final"]) < 16 and len(lexicon.automaton([])["final"]) == 1
    assert (lexicon.word_numbers(lexicon.automaton([]), [b"a", b""]) == -1).all()


def test_merged_words_are_those_of_the_library():
    rng = random.Random(2)
    words = list({*some_words(rng, 800), *(chr(c) for c in range(33, 0x250) if chr(c).strip() and chr(c).lower() == chr(c) and c not in range(127, 161)), "a" * 96})
    library = Tokenizer.from_file(FILE)
    merges = lexicon.merge_table(lexicon._spec(FILE))
    got = lexicon.merge_words(merges, [w.encode() for w in words])
    for word, ids in zip(words, got):
        whole = library.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == whole, word
    with pytest.raises(ValueError):
        lexicon._spec(public_tokenizers.path("byte_bpe_50k.json"))


def test_texts_are_encoded_and_decoded_as_by_the_library(spark, docs_of, odd_rows, scratch):
    rng = random.Random(3)
    odd = ["Word, word. WORD", "x<|endoftext|>y <|ENDOFTEXT|>", "é ́x", "it's 'S don't", "\x01 a\x85b", "１２ 3a½²", "İ I ΑΣ s", "x" * 500 + " " + "é" * 90, "漢字 ok", "\xad \xa0 b", "ª º µ ×÷"]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(odd)] + [(200 + i, " ".join(some_words(rng, 40))) for i in range(40)]
    docs, library = docs_of(rows), Tokenizer.from_file(FILE)
    for most in (0, 25, 100_000):
        words = lexicon.frequent_words(docs, f"{scratch}-{most}", most)
        assert len(words) <= most and (most < 1000 or len(words) > 100)
        name = lexicon.send_lexicon(spark, words, FILE, f"{scratch}-{most}.bin")
        got = lexicon.decode_ids(lexicon.encode_texts(docs, name, FILE), FILE).collect()
        want = [(i, tuple(ids := library.encode(t or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False)) for i, t in rows]
        assert sorted(((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got), key=repr) == sorted(want, key=repr)
    assert lexicon.frequent_words(docs_of([]), f"{scratch}-none") == []
    assert lexicon.encode_texts(docs_of([]), name, FILE).count() == 0


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        own[c] = [t[1:] for t in sorted(turns, key=lambda t: (t[0], t[1]))]
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    words = lambda p: len([w for w in "".join(" " if x in SPACE else x for x in p[-1][1]).split(" ") if w]) if p else 0
    saved = {p: (len(m) - 1) * words(p) for p, m in members.items()}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        found = [p]
        for q in found:
            found += children[q]
        return found

    for p, m in members.items():
        subtree = below(p)
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in subtree), sum(saved[q] for q in subtree), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("stretch, piece", [(0, 2), (60, 1000), (10**6, 1000)])
def test_nodes_of_conversations(spark, tmp_path, stretch, piece):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b  b", "", None, "é c\x0bd", "a"])) for c in range(120) for t in range(rng.randint(0, 5)) if c % 7]
    rows += [(200 + c, t, "user", "same words") for c in range(30) for t in range(3)] + [(300, t, "user", f"long {t}") for t in range(60)] + [(301, None, "x", "first"), (301, 0, "x", "second"), (340, 0, None, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int").repartition(3)
    own = prefixtrie.paths(table)
    got = prefixtrie.prefix_trie(prefixtrie.rebuilt(own), str(tmp_path), stretch, piece).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_conversations_without_rows_or_ids(spark, tmp_path):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.paths(table)), str(tmp_path / "a")).count() == 0
    table = spark.createDataFrame([(None, 1, "r", "x"), (None, 0, "r", "y"), (5, 0, "r", "y"), (5, 0, "r", "y")], table.schema)
    nodes = {r["depth"]: r for r in prefixtrie.prefix_trie(prefixtrie.paths(table), str(tmp_path / "b")).filter("depth < 2").collect()}
    assert nodes[0]["n_convs"] == nodes[1]["n_convs"] == 2 and nodes[0]["conv_id"] == 5 and nodes[1]["n_children"] == 2


def test_runs_of_levels_cover_all_depths():
    rng = random.Random(5)
    for _ in range(200):
        lengths = {rng.randrange(50): rng.randint(1, 30) for _ in range(rng.randint(1, 8))}
        runs = prefixtrie.steps(lengths, rng.choice([0, 50, 1000, 10**6]))
        assert [d for high, low, _ in runs for d in range(high, low - 1, -1)] == list(range(max(lengths), -1, -1))
        assert all(here or high == low for high, low, here in runs)
    assert prefixtrie.steps({400: 1, 3: 1000}, 500)[0] == (400, 4, True)


def brute_audit(rows, labels):
    first = {}
    for i, t, lang in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in SPACE else c for c in t).split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = {f: sum(120 // len(d[1]) for d in own if f in d[1]) for f in "ABCDE"}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in own) - len(lost)
                out.append((part, "".join(order), step, len(kept), len(lost), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in lost), sum(d[3] for d in lost), shapley[f]))
                left = kept
    return sorted(out)


@pytest.mark.parametrize("size", [1, 700, 10**7])
def test_filters_in_every_order(spark, tmp_path, size):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "A", "x # y", "É ÉÉ", "AbC d" * 30, " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i % 90}" for i in range(130)), " ".join(f"W{i}X" for i in range(110)) + "|", "a\x0bb\x1cc " * 60]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(150)]
    rows += [(500 + i, "hot text", "en") for i in range(40)] + [(500, "hot text", "de"), (500, "hot text", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), 500, 501, 501, None]]
    docs = spark.createDataFrame([(*r, "clash", 5, "z") for r in rows], "doc_id long, text string, lang string, part string, mask int, digest string").repartition(4)
    table = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, good int")
    got = filteraudit.filter_audit(docs, table, str(tmp_path), size=size)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)


def test_dictionary_numbers_every_word_once(spark, docs_of, odd_rows, tmp_path):
    docs = docs_of(odd_rows).select("doc_id", F.lit("p").alias("part"), F.lit(b"").alias("digest"), "text")
    filteraudit.blocks(docs, 50).write.parquet(str(tmp_path / "blocks"))
    local = spark.read.schema(filteraudit.BLOCK_SCHEMA).parquet(str(tmp_path / "blocks"))
    asked = filteraudit.questions(local, 5)
    numbers = {bytes(r["word"]): r["id"] for r in filteraudit.dictionary(asked, 5).collect()}
    words = {w for _, t in odd_rows for w in (t or "").encode().split()}
    assert set(numbers) == words and len(set(numbers.values())) == len(words)
    rows = []
    for s in filteraudit.shards(local, filteraudit.answers(asked, 5)).collect():
        for k, i in enumerate(s["doc_ids"]):
            part = slice(s["starts"][k], s["starts"][k + 1])
            rows.append((i, tuple(sorted(zip(s["columns"][part], s["counts"][part])))))
    want = []
    for i, t in odd_rows:
        own = (t or "").encode().split()
        want.append((i, tuple(sorted((numbers[w], n) for w, n in Counter(own).items()))))
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, docs_of, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.filter_audit(docs_of([]), labels, str(tmp_path)).count() == 0


def test_contained_items_are_judged_by_row(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(None, f"x {item} y"), (None, "clean words only here now"), (4, item.upper()), (4, "clean"), (5, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (1, item), (2, item + " more"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(((r["doc_id"], r["n_items"], r["item_ids"], r["kept"]) for r in QUERIES["op5_decontaminate"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, 2, "1,2", False), (None, 0, "", True), (4, 2, "1,2", False), (4, 0, "", True), (5, 0, "", True), (5, 0, "", True)], key=repr)
