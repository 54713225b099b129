import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratemill.operators import sample as S
from ratemill.operators import select as X
from ratemill.operators import similar as N

METRICS = ["m1", "m2"]


def largest_first(sizes, k):
    loads = [0] * k
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            at = loads.index(min(loads))
            loads[at] += size
    return loads


def test_fold_quotas_equal_one_by_one_filling():
    rng = random.Random(1)
    for _ in range(300):
        k = rng.randint(1, 6)
        sizes = [(s, rng.randint(1, 12)) for s in rng.sample(range(1, 20), rng.randint(1, 6))]
        loads = [0] * k
        for size, fold, first, last in S.fold_quotas(sizes, k):
            loads[fold] += size * (last - first + 1)
        assert loads == largest_first(sizes, k)


def test_five_folds(spark):
    rows = [(g, i) for g, n in zip("abcdef", (6, 6, 6, 6, 6, 1)) for i in range(n)]
    folded = S.with_folds(spark.createDataFrame(rows, "g string, i int"), ["g"], 5)
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [6, 6, 6, 6, 7]
    assert folded.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_dense_index_is_dense(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    for by in ([], ["g"]):
        out = S.dense_index(df, ["k"], by).groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.max("idx").alias("m")).collect()
        assert all(r["n"] == r["d"] == r["m"] + 1 for r in out)


def test_bootstraps(spark):
    pool = spark.range(10).select(F.col("id").cast("string").alias("k"))
    draws = S.bootstrap_groups(pool, ["k"], 30, 2)
    assert draws.count() == 60 and draws.select("bootstrap_id", "copy_id").distinct().count() == 60
    assert S.bootstrap_groups(pool, ["k"], 0, 2).count() == 0
    once = S.bootstrap_groups(pool, ["k"], 5, 2, replace=False)
    assert once.count() == 10 and once.distinct().count() == 10
    assert S.sample_groups(pool, ["k"], 50).count() == 10
    assert sorted(r["k"] for r in draws.collect()) == sorted(r["k"] for r in S.bootstrap_groups(pool.repartition(3), ["k"], 30, 2).collect())


def test_short_stratum_is_an_error(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, k int")
    with pytest.raises(ValueError):
        S.stratified_sample(df, ["s"], 2, ["k"])


def vectors(spark, n, dim=4, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, [float(x) for x in row], int(i % 3), "ab"[i % 2]) for i, row in enumerate(v)],
                                    "item_id int, vector array<double>, fold int, dataset string")


@pytest.mark.parametrize("block_rows", [7, 20000])
def test_topk_in_blocks(spark, block_rows):
    v, pool = vectors(spark, 40)
    targets = pool.select(F.col("item_id").alias("target_id"), "vector", "fold")
    got = collections.defaultdict(list)
    for r in N.topk_similar(targets, pool, 5, exclude_same_fold=True, block_rows=block_rows).orderBy("target_id", "rank").collect():
        got[r["target_id"]].append(r["item_id"])
    sims = v @ v.T
    for t in range(40):
        order = sorted((i for i in range(40) if i % 3 != t % 3), key=lambda i: (-round(sims[t, i], 12), i))
        assert got[t] == order[:5]
    assert N.topk_similar(targets, pool.limit(3), 10, block_rows=block_rows).groupBy("target_id").count().filter("count <> 3").count() == 0


def test_equal_vectors_tie_by_id(spark):
    pool = spark.createDataFrame([(i, [0.6, 0.8]) for i in (5, 3, 9)], "item_id int, vector array<double>")
    target = spark.createDataFrame([(1, [1.0, 0.0])], "target_id int, vector array<double>")
    assert [r["item_id"] for r in N.topk_similar(target, pool, 2).orderBy("rank").collect()] == [3, 5]


def test_uniform_weights_where_nothing_is_positive(spark):
    df = spark.createDataFrame([(1, -0.2), (1, 0.0), (2, 3.0), (2, -1.0)], "target_id int, similarity double")
    assert sorted((r["target_id"], r["weight"]) for r in X.normalize_weights(df).collect()) == [(1, 0.5), (1, 0.5), (2, 0.0), (2, 1.0)]


def test_weighted_draw_frequencies(spark):
    """The first pick of many targets follows the weights."""
    pool = spark.createDataFrame([(0, [0.6, 0.0]), (1, [0.3, 0.0]), (2, [0.1, 0.0])], "item_id int, vector array<double>")
    targets = spark.range(3000).select(F.col("id").alias("target_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    out = X.weighted_sample(targets, pool, 1, 3, bootstraps=2).filter("bootstrap_id = 1").groupBy("item_id").count()
    share = {r["item_id"]: r["count"] / 3000 for r in out.collect()}
    assert share[0] == pytest.approx(0.6, abs=0.04) and share[2] == pytest.approx(0.1, abs=0.03)


def test_mmr_against_python(spark):
    v, pool = vectors(spark, 25, seed=2)
    targets = pool.filter("item_id < 4").select(F.col("item_id").alias("target_id"), "vector")
    got = collections.defaultdict(list)
    for r in X.mmr(targets, pool, 4, 3, 0.6).orderBy("target_id", "rank").collect():
        got[r["target_id"]].append(r["item_id"])
    for t in range(4):
        sims = v @ v[t]
        open_items = sorted(range(25), key=lambda i: -sims[i])[:12]
        picked = [open_items.pop(0)]
        while len(picked) < 4:
            best = max(open_items, key=lambda i: 0.6 * sims[i] - 0.4 * max(v[i] @ v[j] for j in picked))
            open_items.remove(best)
            picked.append(best)
        assert got[t] == picked


def label_items(spark, n=60, seed=4):
    rng = random.Random(seed)
    rows = [(str(i), rng.choice("ab"), i % 3, rng.choice([0.0, 0.0, 0.5, 1.0]), rng.choice([0.0, 1.0])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, dataset string, fold int, m1 double, m2 double")


def bin_of(v):
    return "low" if v <= 0 else "high" if v >= 1 else "mid"


@pytest.mark.parametrize("strategy", ["balanced", "bin_coverage"])
def test_every_greedy_pick_has_the_best_item_score(spark, strategy):
    rows, items = label_items(spark)
    out = X.select_by_class(items, ["k"], METRICS, 10, strategy, bootstraps=3)
    data = {r[0]: r for r in rows}
    sets = collections.defaultdict(list)
    for r in out.orderBy("target_fold", "bootstrap_id", "rank").collect():
        sets[(r["target_fold"], r["bootstrap_id"])].append(r["k"])
    assert len(sets) == 9
    for (fold, _), picks in sets.items():
        assert len(set(picks)) == 10 and all(data[p][2] != fold for p in picks)
        covered, seen, left = collections.Counter(), set(), {r[0] for r in rows if r[2] != fold}
        wanted = {(m, bin_of(data[i][c])) for i in left for m, c in (("m1", 3), ("m2", 4))}

        def key(i):
            cells = [("m1", bin_of(data[i][3])), ("m2", bin_of(data[i][4]))]
            rarity = sum(1 / (1 + covered[c]) for c in cells)
            bonus = 0.25 if seen and data[i][1] not in seen else 0.0
            if strategy == "balanced":
                return (round(rarity + bonus, 9),)
            gain = sum(c in wanted and covered[c] == 0 for c in cells)
            return (gain, round(rarity, 9), bonus) if wanted - {c for c in covered if covered[c]} else (round(rarity, 9), bonus)

        for pick in picks:
            assert key(pick) == max(key(i) for i in left)
            left.remove(pick)
            seen.add(data[pick][1])
            covered.update([("m1", bin_of(data[pick][3])), ("m2", bin_of(data[pick][4]))])


def test_softmax_probability_is_per_item(spark):
    rows, items = label_items(spark, 30)
    out = X.score_balanced_softmax(items, ["k"], METRICS, 1, 0.5, cross_fit=False).first()
    assert out["pool_size"] == 30 and out["probability"] == pytest.approx(1 / 30)  # every item scores alike at first
    with pytest.raises(ValueError):
        X.score_balanced_softmax(items, ["k"], METRICS, 1, 0.0)


def test_small_pool_and_no_examples(spark):
    _, items = label_items(spark, 4)
    assert X.score_balanced(items, ["k"], METRICS, 10, cross_fit=False).count() == 4
    assert X.score_balanced(items, ["k"], METRICS, 0, cross_fit=False).count() == 0
    assert X.score_balanced(items.union(items), ["k"], METRICS, 10, cross_fit=False).count() == 4
    with pytest.raises(ValueError):
        X.agreement_score_balanced(items, items.select("k").limit(2), ["k"], METRICS, 3)


def test_coverage_similarity_in_blocks(spark):
    _, pool = vectors(spark, 30, seed=7)
    pool = pool.withColumn("m1", (F.col("item_id") % 3) / 2.0).withColumn("m2", (F.col("item_id") % 2).cast("double"))
    targets = pool.select(F.col("item_id").alias("target_id"), "vector", "fold")
    a, b = (X.coverage_similarity(targets, pool, METRICS, 4, exclude_same_fold=True, block_rows=n).select("target_id", "rank", "item_id").collect() for n in (6, 20000))
    assert sorted(a) == sorted(b) and len(a) == 120


def test_approximate_neighbours_are_whole(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    made = centres[rng.integers(0, 6, 120)] + 0.05 * rng.normal(size=(120, 16))
    made = np.r_[made, [-centres[0], -centres[1]]]
    made /= np.linalg.norm(made, axis=1)[:, None]
    rows = [(i, [float(x) for x in v], i % 5) for i, v in enumerate(made)]
    pool = spark.createDataFrame(rows[:120], "item_id long, vector array<double>, fold int")
    # The last two lie opposite to all of the pool, and a bucket holds few of the others.
    targets = spark.createDataFrame(rows, "target_id long, vector array<double>, fold int")
    for excluded in (False, True):
        near = N.topk_similar_approx(targets, pool, 5, cell_rows=20, exclude_same_fold=excluded).collect()
        assert collections.Counter(r["target_id"] for r in near) == {i: 5 for i in range(122)}
        assert all(sorted(r["rank"] for r in near if r["target_id"] == i) == [1, 2, 3, 4, 5] for i in range(122))
        assert all(abs(made[r["target_id"]] @ made[r["item_id"]] - r["similarity"]) < 1e-9 for r in near)
        assert not excluded or all(r["target_id"] % 5 != r["item_id"] % 5 for r in near)
        exact = N.topk_similar(targets, pool, 5, exclude_same_fold=excluded)
        assert N.recall(spark.createDataFrame(near), exact).first()["recall"] >= 0.9
    few = N.topk_similar_approx(targets, pool.limit(3), 5)
    assert few.groupBy("target_id").count().filter("count = 3").count() == 122


def test_approximate_query_finds_most_of_the_exact_neighbours(spark):
    import __spark_entry__ as entry

    near, exact = (entry.queries()[n](spark, "/root/testdata/sf0.01") for n in ("topk_similar_approx", "topk_similar"))
    assert near.groupBy("target_id").count().filter("count <> 5").count() == 0
    assert near.select("target_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count()
    assert N.recall(near, exact).first()["recall"] >= 0.9


@pytest.mark.parametrize("cell_rows, block_rows", [(10, 7), (10, 20000), (1000, 50)])
def test_cells_with_bounds_are_exact(spark, cell_rows, block_rows):
    """Clusters of unequal lengths, a vector that a third of the pool has, zeros, ties and single precision."""
    rng = np.random.default_rng(8)
    made = np.r_[np.repeat(rng.normal(size=(6, 8)), 12, axis=0) + 0.1 * rng.normal(size=(72, 8)), np.tile(rng.normal(size=8), (40, 1)), np.zeros((3, 8))].astype(np.float32)
    made[:20] *= 3
    rows = [(f"i{i:03}", [float(x) for x in v], i % 4) for i, v in enumerate(made)]
    pool = spark.createDataFrame([*rows, ("none", None, 0)], "item_id string, vector array<float>, fold int")
    targets = pool.withColumnRenamed("item_id", "target_id")
    for excluded in (False, True):
        got = collections.defaultdict(list)
        for r in sorted(N.topk_similar_approx(targets, pool, 4, cell_rows=cell_rows, block_rows=block_rows, exclude_same_fold=excluded).collect(), key=lambda r: r["rank"]):
            got[r["target_id"]].append((r["item_id"], r["similarity"]))
        sims = np.round(made.astype(np.float64) @ made.T.astype(np.float64), 12)
        for t, (name, _, own) in enumerate(rows):
            want = sorted(((-sims[t, i], item) for i, (item, _, fold) in enumerate(rows) if not excluded or fold != own))[:4]
            assert [i for i, _ in got[name]] == [i for _, i in want], name
            assert np.allclose([v for _, v in got[name]], [-v for v, _ in want], atol=1e-9)
        assert len(got) == len(rows)
    assert N.topk_similar_approx(targets, pool.limit(0), 4).count() == 0 and N.topk_similar_approx(targets.limit(0), pool, 4).count() == 0


def test_bounds_leave_cells_out(spark):
    """Far clusters meet the targets of no other cluster: few rows are sent to other cells."""
    rng = np.random.default_rng(9)
    centres = np.eye(8)[:6]
    made = np.repeat(centres, 50, axis=0) + 0.02 * rng.normal(size=(300, 8))
    pool = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "item_id long, vector array<double>")
    targets = pool.withColumnRenamed("item_id", "target_id")
    from ratemill.operators import cells

    sent = cells.topk_cells(targets, pool, 5, cell_rows=50)
    folder = sent.inputFiles()[0].rsplit("/hits/", 1)[0]
    assert spark.read.parquet(f"{folder}/hits").count() < 300 * 5 * 2.5


@pytest.mark.parametrize("block_rows", [9, 20000])
@pytest.mark.parametrize("weights", [(0.7, 0.3), (0.05, 0.95), (1.0, 0.0)])
def test_class_heads_give_the_greedy_picks(spark, block_rows, weights):
    """Against greedy steps over the whole pool; equal vectors and a large class included."""
    from ratemill.functions.values import uniform
    from ratemill.operators import coverage as C

    rng = np.random.default_rng(12)
    v = rng.normal(size=(60, 5))
    v[30:38] = v[30]
    v /= np.linalg.norm(v, axis=1)[:, None]
    m1, m2 = rng.choice([0.0, 0.5, 1.0], 60, p=[0.8, 0.1, 0.1]), rng.choice([0.0, 1.0], 60)
    rows = [(i, [float(x) for x in v[i]], i % 4, "ab"[i % 2] if i % 9 else None, float(m1[i]), float(m2[i])) for i in range(60)]
    pool = spark.createDataFrame(rows, "item_id int, vector array<double>, fold int, dataset string, m1 double, m2 double")
    targets = pool.select(F.col("item_id").alias("target_id"), "vector", "fold")
    pairs = targets.select("target_id").crossJoin(pool.select("item_id")).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("b")))
    noise = {(r[0], r[1], r[2]): r[3] for r in pairs.select("target_id", "b", "item_id", uniform(X.SEED, F.col("target_id"), F.col("b"), F.col("item_id"))).collect()}
    got = collections.defaultdict(list)
    for r in sorted(X.coverage_similarity(targets, pool, METRICS, 6, *weights, bootstraps=2, exclude_same_fold=True, block_rows=block_rows).collect(), key=lambda r: r["rank"]):
        got[r["target_id"], r["bootstrap_id"]].append(r["item_id"])
    bin_of = lambda x: "low" if x <= 0 else "high" if x >= 1 else "mid"
    sims = np.round(v @ v.T, 12)
    for t in range(60):
        free = [i for i in range(60) if i % 4 != t % 4]
        low, high = sims[t, free].min(), sims[t, free].max()
        by_class = collections.defaultdict(list)
        for i in sorted(free, key=lambda i: (-sims[t, i], i)):
            by_class[rows[i][3], bin_of(m1[i]), bin_of(m2[i])].append(i)
        for boot in range(2):
            open_ = [i for members in by_class.values() for i in members[:6]]
            covered, seen, want = collections.Counter(), set(), []
            while len(want) < 6:
                def key(i):
                    cells = [("m1", bin_of(m1[i])), ("m2", bin_of(m2[i]))]
                    rarity = sum(1.0 / (1.0 + covered[c]) for c in cells) / 2.0
                    extra = 0.25 if seen and rows[i][3] not in seen else 0.0
                    return round(weights[0] * rarity + weights[1] * (sims[t, i] - low) / (high - low), 12), extra, noise[t, boot, i]

                best = max(open_, key=key)
                open_.remove(best)
                want.append(best)
                seen.add(rows[best][3])
                covered.update([("m1", bin_of(m1[best])), ("m2", bin_of(m2[best]))])
            assert got[t, boot] == want, (t, boot)
    items = C.item_bins(pool, METRICS).withColumn("cls", F.to_json(F.concat(F.array("dataset"), "bins")))
    heads = C.class_heads(targets, items, 6, (*weights, 0.25), 2, 1 if block_rows > 60 else 7, 1, True)
    classes = items.select("cls").distinct().count()
    # The eight equal vectors of a class stay together, so they may add to the bound.
    assert heads.filter(F.size("items") > 6 + classes + 7).count() == 0
    assert heads.groupBy("target_id").agg(F.count("*").alias("n")).filter(f"n > {1 if block_rows > 60 else 7}").count() == 0


def test_cut_off_selection_is_exact(spark):
    """Any n, strata with null and few rows, repeated rows, and no sort or limit over the table."""
    rows = [(["a", "b", None][i % 3] if i < 590 else "c", i % 200 if i < 560 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "s string, k int").repartition(5)
    text = {k: r for k, r in ((r["k"], r["d"]) for r in df.select("k", S.digest(S.SEED, S.key_text(["k"])).alias("d")).distinct().collect())}
    for n in (1, 37, 180, 199, 599, 600, 900):
        got = sorted((text[r["k"]], r["k"]) for r in S.sample_rows(df, n, ["k"]).collect())
        assert got == sorted((text[k], k) for _, k in rows)[:n]
        per = collections.defaultdict(list)
        for r in S.stratified_sample(df, ["s"], n, ["k"], check=False).collect():
            per[r["s"]].append((text[r["k"]], r["k"]))
        for s in ("a", "b", None, "c"):
            assert sorted(per[s]) == sorted((text[k], k) for x, k in rows if x == s)[:n]
    plan = S.sample_rows(df, 180, ["k"])._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "Sort [_digest" not in plan.split("== Physical Plan ==")[0]
    assert S.sample_rows(df.limit(0), 5, ["k"]).count() == 0 and S.sample_rows(df, 0, ["k"]).count() == 0


def test_draws_with_replacement_are_even_and_null_safe(spark):
    pool = spark.createDataFrame([(i, None if i % 2 else "f") for i in range(60)] + [(100, "one")], "k int, fold string")
    drawn = S.bootstrap_groups(pool, ["k"], 3000, 3, by=["fold"])
    per = collections.Counter((r["fold"], r["bootstrap_id"], r["k"]) for r in drawn.collect())
    for fold, size in ((None, 30), ("f", 30), ("one", 1)):
        for boot in range(3):
            counts = [c for (f, b, _), c in per.items() if (f, b) == (fold, boot)]
            assert sum(counts) == 3000 and len(counts) == size
            chance = 3000 / size
            # Chi square with 29 degrees of freedom: 60 is beyond the 0.999 quantile.
            assert size == 1 or sum((c - chance) ** 2 / chance for c in counts) < 60
    assert all(k % 2 if f is None else k % 2 == 0 for f, _, k in per)


def test_neighbours_hold_few_similarities_at_once(spark):
    """A chunk shrinks as the pool's block grows, and its borders change no neighbour."""
    import numpy as np

    from ratemill.operators import similar

    assert all(similar.chunk_rows(n) * n <= max(similar.SCORES, n) for n in (1, 2000, 20_000, 10_000_000))
    pool = np.random.default_rng(3).integers(-9, 9, (4000, 4)).astype(float)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(pool)], "item_id long, vector array<double>")
    targets = items.filter("item_id < 1200").withColumnRenamed("item_id", "target_id")
    assert similar.chunk_rows(len(pool)) < 1200
    got = {(r["target_id"], r["rank"]): r["item_id"] for r in similar.topk_similar(targets, items, 3, block_rows=10_000).collect()}
    scores = pool[:1200] @ pool.T
    for t in range(1200):
        assert [got[t, k] for k in (1, 2, 3)] == sorted(range(len(pool)), key=lambda i: (-scores[t, i], i))[:3]
