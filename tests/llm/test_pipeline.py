import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ratemill.llm import pii, toxicity
from ratemill.llm.queries import QUERIES, held_out

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert docs.select("doc_id").distinct().count() == sizes[4]


def test_an_empty_corpus_passes_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_near_duplicates_and_benchmark_items_are_judged_by_row(spark, docs_of, tmp_path):
    def text(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    a, b = text("a"), text("b")
    rows = [(3, a), (5, a), (5, b), (7, text("c")), (None, text("c")), (None, text("d")), (None, text("e")), (None, text("e", 41)), (None, None), (None, ""), (9, text("f")), (9, text("f")), (8, text("f", 41))]
    kept = corpus_pipeline.near_dedup_stage(spark, docs_of(rows), SMALL)
    assert kept.columns == docs_of(rows).columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    certain = [(3, a), (5, b), (7, text("c")), (None, text("d")), (None, None), (None, ""), (8, text("f", 41))]
    others = list(got)
    for row in certain:
        others.remove(row)
    assert others in ([(None, text("e"))], [(None, text("e", 41))])

    spark.createDataFrame([(1, text("q", 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held = "x y " + text("q", 12) + " z"
    rows = [(None, held), (None, a), (None, b), (5, held), (5, a), (6, b)]
    clean = corpus_pipeline.decontamination_stage(spark, docs_of(rows), str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in clean), key=str) == sorted([(None, a), (None, b), (5, a), (6, b)], key=str)


def five_words(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def corpus(rng):
    """Texts with nulls, empty and long ones, copies, near copies, a benchmark item, insults and personal data; columns named as results are."""
    def plain(n):
        return " ".join(rng.choice(["river", "stone", "garden", "cloud", "paper", "lamp", "window", "tree"]) + str(rng.randrange(400)) for _ in range(n))

    texts = [None, "", " \t ", "x", plain(9000)] + [plain(rng.randint(8, 120)) for _ in range(60)]
    texts += [t for t in texts[5:12] for _ in range(2)] + [t + " more" for t in texts[12:20]] + [" ".join([t.split()[0], "inserted", *t.split()[1:]]) for t in texts[20:24]]
    texts += [f"{plain(20)} {ITEM} {plain(5)}" for _ in range(3)] + [ITEM]
    texts += [f"mail {rng.choice('abc')}@d{i}.example.com or call +1 (212) 555-01{i:02} {plain(30)}" for i in range(10)]
    insults = [f"you are an awful stupid idiot, {plain(6)} shut up you moron" for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts + insults)] + [(7, plain(30)), (7, texts[6]), (None, plain(25)), (None, None), (None, texts[8])]
    labels = [(i, 1, int(i >= len(texts))) for i in range(len(texts) + len(insults)) if i % 4]
    return rows, labels


ITEM = " ".join(f"question{i}" for i in range(14))


def test_the_pipeline_against_plain_python(spark, tmp_path):
    rows, labels = corpus(random.Random(21))
    clash = "doc_id long, text string, n_chars long, score double, row_key string, base string, spans int, redacted string, row int, Text2 string"
    docs = spark.createDataFrame([(i, t, len(t or ""), 0.25, "k", "b", 3, "r", 9, "t") for i, t in rows], clash).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))

    # Toxicity, by the fitted model.
    model = toxicity.train(source, labelled, ~held_out())
    left = [(i, t) for i, t in rows if model.score(t or "") < corpus_pipeline.REJECTED]
    assert 0 < len(rows) - len(left) < 40
    got = corpus_pipeline.toxicity_stage(spark, source, str(tmp_path))
    assert got.columns == source.columns and got.filter("score <> 0.25 or row_key <> 'k'").isEmpty()
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(left)
    got.write.parquet(str(tmp_path / "1"))

    # Near duplicates: all pairs of sets, components, the least id of each.
    sets = [five_words(t) for _, t in left]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    members = defaultdict(list)
    for k, g in enumerate(group):
        members[g].append(left[k])
    kept = corpus_pipeline.near_dedup_stage(spark, spark.read.parquet(str(tmp_path / "1")), str(tmp_path))
    kept.write.parquet(str(tmp_path / "2"))
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    ends = Counter(min(((i is None, i or 0) for i, _ in m)) for m in members.values())
    assert Counter((i is None, i or 0) for i, _ in kept) == ends and len(kept) < len(left)
    assert all(row in left for row in kept)

    # Benchmark items, then personal data.
    item = five_words(ITEM)
    clean = [(i, t) for i, t in kept if 5 * len(five_words(t) & item) < 4 * len(item)]
    assert len(clean) < len(kept)
    got = corpus_pipeline.decontamination_stage(spark, spark.read.parquet(str(tmp_path / "2")), str(tmp_path))
    got.write.parquet(str(tmp_path / "3"))
    assert got.columns == source.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(clean)
    models = pii.train()
    hidden = [(i, t if t is None else pii.redact(t, pii.all_spans(t, models)[1])) for i, t in clean]
    assert sum("<email>" in (t or "") and "<phone>" in t for _, t in hidden) == 10
    got = corpus_pipeline.pii_stage(spark, spark.read.parquet(str(tmp_path / "3")), str(tmp_path))
    assert got.columns == source.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(hidden)
    assert got.filter("n_chars <> length(text) or spans <> 3 or base <> 'b'").isEmpty()

    # run(): every token of what is left has one place, sequences are gapless and few.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in hidden)
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sequences = defaultdict(list)
    for r in placed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert sum(r["length"] for r in placed) == sum(n * c for (_, n), c in sizes.items())
    assert len(sequences) <= -(-sum(r["length"] for r in placed) // 2048) + 1
    whole = Counter((r["doc_id"], r["length"]) for r in placed)
    assert all(whole[key] >= c for key, c in sizes.items() if key[1] <= 2048 and [i for i, _ in sizes].count(key[0]) == 1)
