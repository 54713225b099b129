import math
import random

import pytest

from ratemill.operators import correlate as C


def brute(points):
    n = len(points)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    conc = disc = tx = ty = 0
    for i in range(n):
        for j in range(i):
            a, b = xs[i] - xs[j], ys[i] - ys[j]
            conc, disc, tx, ty = conc + (a * b > 0), disc + (a * b < 0), tx + (a == 0), ty + (b == 0)
    pairs = n * (n - 1) / 2

    def rank(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    def r(a, b):
        ma, mb = sum(a) / n, sum(b) / n
        top = sum((p - ma) * (q - mb) for p, q in zip(a, b))
        return top / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))

    return (conc - disc) / math.sqrt((pairs - tx) * (pairs - ty)), r(xs, ys), r(rank(xs), rank(ys))


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    rows = []
    for g in range(6):
        for _ in range(20 + 25 * g):
            x = rng.choice([0.0, 0.5, 1.0]) if g % 2 else round(rng.random(), 2)
            rows.append((g, x, round(x / 2 + rng.random(), 1 if g < 3 else 4)))
    # All ties but one pair.
    rows += [(9, 1.0, 1.0)] * 8 + [(9, 2.0, 3.0)]
    return rows


@pytest.mark.parametrize("task_cells", [10**6, 30, 5])
def test_against_brute_force(spark, points, task_cells):
    df = spark.createDataFrame(points, "g int, x double, y double")
    out = {r["g"]: r for r in C.correlations(df, ["g"], task_cells=task_cells).collect()}
    for g in {p[0] for p in points}:
        want = brute([p[1:] for p in points if p[0] == g])
        got = (out[g]["kendalltau"], out[g]["pearson"], out[g]["spearman"])
        assert got == pytest.approx(want, abs=1e-9), g


@pytest.mark.parametrize("task_cells", [10**6, 1])
def test_guards(spark, task_cells):
    nan = float("nan")
    rows = [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("gap", 1.0, None), ("gap", 2.0, 1.0), ("nan", nan, 1.0), ("nan", 2.0, 2.0)]
    out = {r["g"]: r for r in C.correlations(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], task_cells=task_cells).collect()}
    assert (out["flat"]["kendalltau"], out["flat"]["pearson"], out["flat"]["spearman"]) == (0.0, 0.0, 0.0)
    for g in ("one", "gap", "nan"):
        assert all(math.isnan(out[g][c]) for c in ("kendalltau", "pearson", "spearman")), g


def test_null_group_key(spark):
    df = spark.createDataFrame([(None, 0.0, 0.0), (None, 1.0, 2.0), (None, 2.0, 1.0)], "g string, x double, y double")
    for cells in (10**6, 1):
        row = C.correlations(df, ["g"], task_cells=cells).first()
        assert row["n"] == 3 and row["kendalltau"] == pytest.approx(1 / 3)


def test_weights_count_rows(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 3), ("a", 1.0, 2.0, 2), ("a", 2.0, 1.0, 1)], "g string, x double, y double, n int")
    row = C.correlations(df, ["g"], weight="n").first()
    want = brute([(0.0, 0.0)] * 3 + [(1.0, 2.0)] * 2 + [(2.0, 1.0)])
    assert (row["kendalltau"], row["pearson"], row["spearman"]) == pytest.approx(want)


def test_ranges_hold_heavy_values_nulls_and_many_groups(spark):
    """One task has few cells, whatever the values: half of the rows share one x, others one y."""
    rng = random.Random(11)
    rows = [(g, 1.0 if rng.random() < 0.5 else round(rng.random(), 2), 2.0 if rng.random() < 0.4 else rng.randrange(40) / 4) for g in ("a", None) for _ in range(300)]
    rows += [("gap", rng.random(), rng.random()) for _ in range(50)] + [("gap", None, 1.0)] * 3 + [("few", 1.0, 2.0), ("few", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    whole, cut = ({r["g"]: r for r in C.correlation_pvalues(C.correlations(df, ["g"], task_cells=c)).collect()} for c in (10**6, 20))
    for g in ("a", None, "few"):
        assert [cut[g][c] for c in cut[g].asDict() if c != "g"] == pytest.approx([whole[g][c] for c in whole[g].asDict() if c != "g"], rel=1e-9, abs=1e-9)
        if g != "few":
            points = [p[1:] for p in rows if p[0] == g]
            assert (cut[g]["kendalltau"], cut[g]["pearson"], cut[g]["spearman"]) == pytest.approx(brute(points), abs=1e-9)
    assert cut["gap"]["n"] == 53 and math.isnan(cut["gap"]["pearson"])


def tail(r, n):
    """By Simpson's rule over the angle."""
    a = n / 2 - 1
    low = math.asin(abs(r))
    high = min(math.pi / 2, low + 16 / math.sqrt(2 * a))
    steps = 20_000
    f = lambda t: math.exp((2 * a - 1) * math.log(max(math.cos(t), 1e-300))) if a != 0.5 else 1.0
    h = (high - low) / steps
    total = f(low) + f(high) + sum((4 if k % 2 else 2) * f(low + k * h) for k in range(1, steps))
    return 2 * total * h / 3 / math.exp(math.lgamma(0.5) + math.lgamma(a) - math.lgamma(a + 0.5))


def test_tail_probabilities(spark):
    cases = [(r, n) for n in (3, 4, 5, 10, 30, 77, 400, 10_000) for r in (0.0, 0.01, -0.1, 0.3, -0.632, 0.7072, 0.95, 0.9999)]
    df = spark.createDataFrame([(r, n) for r, n in cases], "r double, n long")
    from pyspark.sql import functions as F

    for r in df.withColumn("p", C.tail_probability(F.col("r"), F.col("n"))).collect():
        assert r["p"] == pytest.approx(tail(r["r"], r["n"]), abs=1e-6), (r["r"], r["n"])
    # Published tables: critical values of r for two-sided 0.05 and 0.01.
    table = [(0.997, 3, 0.05), (0.632, 10, 0.05), (0.765, 10, 0.01), (0.361, 30, 0.05), (0.195, 102, 0.05)]
    rows = spark.createDataFrame(table, "r double, n long, p double").withColumn("q", C.tail_probability(F.col("r"), F.col("n"))).collect()
    assert all(r["q"] == pytest.approx(r["p"], rel=0.02) for r in rows)
    odd = spark.createDataFrame([(1.0, 5), (-1.0, 3), (1.0, 2), (float("nan"), 1), (1e-3, 10**9)], "r double, n long").withColumn("p", C.tail_probability(F.col("r"), F.col("n"))).collect()
    assert [r["p"] for r in odd[:3]] == [0.0, 0.0, 1.0] and math.isnan(odd[3]["p"]) and odd[4]["p"] < 1e-12


def test_kendall_pvalue_with_ties(spark):
    rng = random.Random(5)
    rows = [("none", float(i), float((i * 7) % 30)) for i in range(30)] + [("ties", float(rng.randrange(3)), float(rng.randrange(4))) for _ in range(60)] + [("up", float(i), float(i)) for i in range(30)]
    out = {r["g"]: r for r in C.correlation_pvalues(C.correlations(spark.createDataFrame(rows, "g string, x double, y double"), ["g"])).collect()}
    for g in ("none", "ties", "up"):
        x, y = zip(*[p[1:] for p in rows if p[0] == g])
        n = len(x)
        counts = [[v.count(u) for u in set(v)] for v in (x, y)]
        s = sum((a > b) - (a < b) if c > d else (a < b) - (a > b) if c < d else 0 for i, (a, c) in enumerate(zip(x, y)) for b, d in zip(x[:i], y[:i]))
        m = n * (n - 1)
        pairs, zero, one = ([sum(f(t) for t in c) for c in counts] for f in (lambda t: t * (t - 1) / 2, lambda t: t * (t - 1) * (t - 2), lambda t: t * (t - 1) * (2 * t + 5)))
        variance = (m * (2 * n + 5) - sum(one)) / 18 + 2 * pairs[0] * pairs[1] / m + zero[0] * zero[1] / (9 * m * (n - 2))
        assert out[g]["kendall_pvalue"] == pytest.approx(math.erfc(abs(s) / math.sqrt(variance) / math.sqrt(2)), abs=1e-6), g


def test_moments_merge_over_gaps(spark):
    """Large means, missing values, several groups and partitions against numpy."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for lang in ("en", None, "zh"):
        base = rng.normal(size=(40, 1))
        values = 1e6 + base * rng.normal(size=5) + rng.normal(size=(40, 5))
        values[rng.random((40, 5)) < 0.3] = np.nan
        values[:, 4] = 7.0
        rows += [(lang, str(i), f"m{j}", float(values[i, j])) for i in range(40) for j in range(5)]
    df = spark.createDataFrame(rows, "lang string, item string, metric string, value double").repartition(7)
    out = {(r["lang"], r["metric_a"], r["metric_b"]): r for r in C.correlation_matrix(df, [f"m{j}" for j in range(6)], ["item"]).collect()}
    assert len(out) == 3 * 36
    for lang in ("en", None, "zh"):
        grid = np.array([r[3] for r in rows if r[0] == lang]).reshape(40, 5)
        for a in range(5):
            for b in range(5):
                both = ~np.isnan(grid[:, a]) & ~np.isnan(grid[:, b])
                row = out[lang, f"m{a}", f"m{b}"]
                assert row["n"] == both.sum()
                if 4 in (a, b):
                    assert row["pearson"] is None
                else:
                    assert row["pearson"] == pytest.approx(np.corrcoef(grid[both, a], grid[both, b])[0, 1], abs=1e-9)
        assert out[lang, "m5", "m0"]["n"] == 0 and math.isnan(out[lang, "m5", "m5"]["pearson"])
