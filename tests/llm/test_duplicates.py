import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from ratemill.llm import contamination, setsketch, suffixes
from ratemill.llm.components import components


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes(rows, width, linked):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and linked(sets[i], sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), least, least is None or doc_id == least))
    return Counter(out)


def close(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def near_copies(seed, n):
    """Chains, stars with a centre that isn't the least, hot groups and strangers."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n // 10):
        base = [rng.choice(words) for _ in range(rng.choice([3, 9, 25, 60]))]
        for _ in range(rng.choice([1, 4, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
            if rng.random() < 0.4:
                base = own
    centre = [rng.choice(words) for _ in range(30)]
    texts += [" ".join(centre[:k] + [f"v{k}"] + centre[k + 1:]) for k in range(1, 29, 3)] + [" ".join(centre)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_are_those_of_all_pairs(docs_of, scratch, width):
    rows = near_copies(width, 250)
    got = setsketch.near_duplicates(docs_of(rows), scratch, 0.8, width).collect()
    assert Counter(tuple(r) for r in got) == classes(rows, width, close)


def test_hot_buckets_are_compared_to_the_end(docs_of, scratch, monkeypatch):
    """A crowd of near copies, linked through a few, with outliers that one of them links or none."""
    monkeypatch.setattr(setsketch, "NEXT", 1)
    monkeypatch.setattr(setsketch, "BLOCK", 7)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(90):
        own = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 3, 4, 5, 6])):
            own[at] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = setsketch.near_duplicates(docs_of(rows), scratch, 0.8, 2).collect()
    want = classes(rows, 2, close)
    assert Counter(tuple(r) for r in got) == want and 1 < sum(kept for *_, kept in want.elements()) < 60


def test_near_duplicates_of_odd_rows(docs_of, odd_rows, scratch):
    got = setsketch.near_duplicates(docs_of(odd_rows), scratch, 0.8, 2).collect()
    assert Counter(tuple(r) for r in got) == classes(odd_rows, 2, close)
    assert setsketch.near_duplicates(docs_of([]), scratch + "0", 0.8, 2).count() == 0


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(5)
    for n, shared in ((400, 0.3), (2000, 0.6), (3000, 0.9)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[:int(n * shared)], rng.integers(0, 2**63, n // 3, dtype=np.uint64)])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        own = setsketch.estimate(setsketch.registers(a)[None], setsketch.registers(b)[None], np.array([len(a)], float), np.array([len(b)], float))
        assert abs(own[0] - truth) < 0.16
    a, b = rng.integers(0, 2**63, (2, 500), dtype=np.uint64)
    x, y = setsketch.registers(a), setsketch.registers(b)
    assert (np.where((x - y).view(np.int8) > 0, x, y) == setsketch.registers(np.concatenate([a, b]))).mean() > 0.99


def test_components(spark, scratch):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(200, 210 + i) for i in range(30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), scratch).collect()}
    label = {v: v for p in pairs for v in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def removed(rows, length):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for i, d in data:
        for p in range(len(d) - length + 1):
            s = d[p:p + length]
            least[s] = min(least.get(s, rank(i)), rank(i))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if least[d[p:p + length]] < rank(i):
                gone[p:p + length] = True
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))) if len(d) else []
        out.append((i, len(d), int(gone.sum()), len(turns) // 2, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return Counter(out)


def cut_rows(df):
    return Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


def pieced(seed, n=120):
    """Shared passages, runs of one character, near copies and strings that share less than the length."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([20, 49, 50, 51, 80, 200]))) for _ in range(12)] + ["a" * 70, "ab" * 40, "x" * 49]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(pieces) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6)))
        rows.append((rng.randrange(n), text))
    return rows


@pytest.mark.parametrize("seed,batch", [(1, 2_000_000), (2, 3000), (3, 500)])
def test_repeated_bytes_are_those_of_all_windows(docs_of, scratch, monkeypatch, seed, batch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffixes, "SHARE_RANKS", 20)
    rows = pieced(seed)
    assert cut_rows(suffixes.remove_repeats(docs_of(rows), scratch, 50)) == removed(rows, 50)


def test_repeated_bytes_of_odd_rows(docs_of, odd_rows, scratch):
    assert cut_rows(suffixes.remove_repeats(docs_of(odd_rows), scratch, 50)) == removed(odd_rows, 50)
    assert suffixes.remove_repeats(docs_of([]), scratch + "0").count() == 0


def test_contained_items_are_those_of_all_pairs(spark, docs_of, odd_rows, scratch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([2, 6, 20, 60, 400])))) for k in range(40)] + [(50, None), (51, ""), (52, "X"), (53, "one two three four five six seven")]
    rows = list(odd_rows)
    for i in range(100, 160):
        item = (rng.choice(items[:40])[1]).split()
        part = item[rng.randrange(0, max(1, len(item) // 3)):]
        rows.append((i, " ".join([rng.choice(words) for _ in range(rng.randint(0, 300))] + part + [rng.choice(words) for _ in range(50)]).title()))
    got = contamination.contained_items(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), scratch)
    want = set()
    for doc_id, text in rows:
        own = shingle_set(text, 5)
        for item_id, item in items:
            wanted = shingle_set(item, 5)
            if wanted and len(own & wanted) >= 0.8 * len(wanted):
                want.add((doc_id, item_id, len(own & wanted), len(wanted)))
    assert {(r["doc_id"], r["item_id"], r["n_found"], r["n_item"]) for r in got.collect()} == want and want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contained_items(docs_of(rows), empty, scratch + "0").count() == 0
    assert contamination.contained_items(docs_of([]), spark.createDataFrame(items, "item_id long, text string"), scratch + "1").count() == 0
