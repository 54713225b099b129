"""Grouped Pearson, Spearman and Kendall tau-b for few, very large groups.

Rows are first counted into distinct cells (group, x, y), with partial counts
before the shuffle, and the cells are checkpointed: they are far fewer than the
rows, and the large input is read once. A mergeable quantile summary of every group
with more than TASK_CELLS cells gives cut points of x and of y. A cut point is a range of its own,
what lies between two is another, so a range holds a bounded number of cells or
a single value. Smaller groups have one range. A task finishes one range, or many small
groups: ranks from its own cells and the totals of the ranges before, and the concordant
pairs inside. Pairs across ranges come from counts by x range and y range, but for those
in one y range, which a task of that range counts. All sums are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.functions.values import let, no_nan
from ratemill.session import cut_lineage

RANGES = 256
#: Cells that a task holds at most, about: of one range, or of small groups together.
TASK_CELLS = 200_000
#: Cut points that a group's summary can give.
QUANTILES = 1023
NAN = float("nan")


def with_ranges(values: DataFrame, value: str, keys: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """Adds ``range``, the range number of ``value``, from at most ``ranges - 1`` cut points.

    The cut points are a sample of the rows chosen by hash, so they are a pure
    function of the data: every branch of a plan and every retry sees the same
    ones, and any cut points give exact results. One small row reaches the plan
    as a scalar subquery.
    """
    picked = (
        values.select(F.col(value).alias("_v"), F.xxhash64(*keys, value).alias("_h"))
        .orderBy("_h", "_v")
        .limit(ranges - 1)
    )
    cuts = picked.agg(F.array_sort(F.collect_set("_v")).alias("cuts")).scalar()
    return (
        values.withColumn("_cuts", cuts)
        .withColumn("range", F.size(F.filter("_cuts", lambda c: c <= F.col(value))))
        .drop("_cuts")
    )


def rank_values(values: DataFrame, by: Sequence[str], value: str = "v", weight: str = "n", ranges: int = RANGES) -> DataFrame:
    """Position of every distinct value of a group.

    Input: one row per (group, value) and how often it occurs. Adds ``rank``
    (average rank, as ties share it), ``dense`` (distinct smaller values),
    ``range``, and for the whole group ``total``, ``distinct``, ``mean`` and
    ``ties`` (tied pairs).
    """
    by = list(by)
    ranged = with_ranges(values, value, by, ranges)
    n, v = F.col(weight).cast("double"), F.col(value)
    sums = ranged.groupBy(*by, "range").agg(
        F.sum(n).alias("_n"), F.count("*").alias("_k"), F.sum(n * v).alias("_nv"), F.sum(n * (n - 1.0) / 2.0).alias("_t")
    )
    group = Window.partitionBy(*by)
    before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = group.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("range").alias("_range"),
        F.coalesce(F.sum("_n").over(before), F.lit(0.0)).alias("_n_before"),
        F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k_before"),
        F.sum("_n").over(whole).alias("total"),
        F.sum("_k").over(whole).alias("distinct"),
        (F.sum("_nv").over(whole) / F.sum("_n").over(whole)).alias("mean"),
        F.sum("_t").over(whole).alias("ties"),
    )
    inside = Window.partitionBy(*by, "range").orderBy(value)
    placed = ranged.select(
        *by, value, weight, "range",
        F.coalesce(F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_n_in"),
        (F.row_number().over(inside) - 1).alias("_k_in"),
    )
    match = placed["range"] == offsets["_range"]
    for c in by:
        match = match & placed[c].eqNullSafe(offsets[f"_{c}"])
    return placed.join(offsets, match).select(
        *by, value, weight, "range",
        (F.col("_n_before") + F.col("_n_in") + (n + 1.0) / 2.0).alias("rank"),
        (F.col("_k_before") + F.col("_k_in")).alias("dense"),
        "total", "distinct", "mean", "ties",
    )


def average_rank(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average rank per distinct value of each group, ties sharing one rank."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return rank_values(counted, by, value).select(*by, value, "n", "rank")


def _cells(df: DataFrame, by: Sequence[str], x: str, y: str, weight: str | None) -> DataFrame:
    count = F.sum(weight) if weight else F.count("*")
    return df.groupBy(*by, no_nan(x).alias("x"), no_nan(y).alias("y")).agg(count.cast("double").alias("n"))


def correlations(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", weight: str | None = None,
                 task_cells: int = TASK_CELLS) -> DataFrame:
    """One row per group: n, kendalltau, pearson, spearman, and sums over ties.

    Fewer than two rows, or a missing value anywhere in the group, give NaN; a
    constant side gives 0 for all three. ``weight`` names a column that says how
    often a row counts. No task gets more than about ``task_cells`` cells, whatever the
    size of a group. Runs two jobs: the cells, and the sizes of groups; where a group has more
    than one range, also one for its cut points.
    """
    # Own names inside, whatever the caller's columns are called.
    inner = {c: f"_g{i}" for i, c in enumerate(by)}
    renamed = df.select(*[F.col(c).alias(n) for c, n in inner.items()], F.col(x).alias("x"), F.col(y).alias("y"),
                        *([F.col(weight).alias("w")] if weight else []))
    keys = list(inner.values())
    cells = cut_lineage(_cells(renamed, keys, "x", "y", "w" if weight else None))
    sizes = cells.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    largest, total = sizes[0] or 0, sizes[1] or 0
    parts = max(cells.sparkSession.sparkContext.defaultParallelism, -(-total // task_cells))
    if largest <= task_cells:
        return _finish(_task_sums(cells.select(*keys, "x", "y", "n", *_alone()), keys, parts), inner)
    return _finish(_ranged_sums(cells, keys, parts, task_cells), inner)


SUM_COLUMNS = ["rows", "gaps", "concordant", "tx", "ty", "txy", "sxy", "sxx", "syy", "rxy", "rxx", "ryy", "x0", "x1", "y0", "y1"]
END_COLUMNS = ["min_x", "max_x", "min_y", "max_y"]
#: What a cell of a group with several ranges knows besides itself: its x range, the totals before it, the
#: weight of a single-valued range, its rank of y, means and weight of the group, and what the task of its y range counted.
KNOWN = ["before_x", "point_x", "rank_y", "mean_x", "mean_y", "total", "near", "ty_near", "y0_near", "y1_near"]


def _alone() -> list[Column]:
    """KNOWN of cells whose group is finished in one task."""
    return [F.lit(0).alias("range_x"), F.lit(None).cast("long").alias("unit"), *[F.lit(None).cast("double").alias(c) for c in KNOWN]]


def _starts(*keys):
    """Where a new combination of the sorted keys begins."""
    import numpy as np

    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _carry(values, new):
    """The value at the last beginning, for every place."""
    import numpy as np

    return values[np.flatnonzero(new)][np.cumsum(new) - 1]


def _positions(g, v, n, count):
    """Dense rank, average rank within the group, and the sums over ties of every group: pairs and third order."""
    import numpy as np

    order = np.lexsort((v, g))
    gs, vs = g[order], v[order]
    run = np.cumsum(_starts(gs, vs)) - 1
    w, rg = np.bincount(run, weights=n[order]), gs[_starts(gs, vs)]
    before, new = np.cumsum(w) - w, _starts(rg)
    rank, dense = np.empty(len(v)), np.empty(len(v), dtype=np.int64)
    rank[order] = (before - _carry(before, new) + (w + 1.0) / 2.0)[run]
    dense[order] = (np.arange(len(w)) - _carry(np.arange(len(w)), new))[run]
    ties = [np.bincount(rg, weights=t, minlength=count) for t in (w * (w - 1) / 2, w * (w - 1) * (w - 2), w * (w - 1) * (2 * w + 5))]
    return dense, rank, ties


def _concordant(g, first, second, n, count):
    """Pairs of each group with both dense ranks in the same strict order.

    Two ranks r < s part at the highest bit in which they differ, where r has 0 and s
    has 1 and all higher bits agree. So per bit level the cells with equal higher bits are
    put in the order of ``first``, and each with 1 counts those with 0 before it.
    """
    import numpy as np

    out = np.zeros(count)
    for level in range(int(second.max(initial=0)).bit_length()):
        high = second >> (level + 1)
        order = np.lexsort((first, high, g))
        one = ((second[order] >> level) & 1).astype(bool)
        zeros = np.where(one, 0.0, n[order])
        before = np.cumsum(zeros) - zeros
        smaller = _carry(before, _starts(g[order], high[order], first[order])) - _carry(before, _starts(g[order], high[order]))
        out += np.bincount(g[order][one], weights=(n[order] * smaller)[one], minlength=count)
    return out


def _task_sums(cells: DataFrame, by: Sequence[str], parts: int) -> DataFrame:
    """The sums of each (group, x range): of cells with KNOWN, ``range_x`` and ``unit``, the number of its own task."""
    by = list(by)
    columns = [*SUM_COLUMNS, *END_COLUMNS]
    fields = [f for f in cells.schema.fields if f.name in by]
    part = F.struct(F.when(F.col("unit").isNull(), F.pmod(F.xxhash64(*by), F.lit(parts)) if by else F.lit(0).cast("long")).alias("small"), F.col("unit"))

    def sums(pdf):
        import numpy as np
        import pandas as pd

        named = [*by, "range_x"]
        g = pdf.groupby(named, dropna=False, sort=False).ngroup().to_numpy()
        count = int(g.max()) + 1
        first = np.full(count, len(pdf))
        np.minimum.at(first, g, np.arange(len(pdf)))
        n, x, y, *known = (pdf[c].to_numpy(dtype=np.float64) for c in ("n", "x", "y", *KNOWN))
        whole = ~(np.isnan(x) | np.isnan(y))
        out = {"rows": np.bincount(g, weights=n, minlength=count), "gaps": np.bincount(g, weights=np.where(whole, 0.0, n), minlength=count)}
        g, n, x, y = g[whole], n[whole], x[whole], y[whole]
        before_x, point_x, rank_y, mean_x, mean_y, total, near, ty_near, y0_near, y1_near = (k[whole] for k in known)

        def per_group(values):
            return np.bincount(g, weights=values, minlength=count)

        def ends(v):
            low, high = np.full(count, np.inf), np.full(count, -np.inf)
            np.minimum.at(low, g, v)
            np.maximum.at(high, g, v)
            return np.where(np.isinf(low), np.nan, low), np.where(np.isinf(high), np.nan, high)

        if len(g):
            ranged = ~np.isnan(total)
            weight = per_group(n)
            dense_x, rx, ties_x = _positions(g, x, n, count)
            dense_y, ry, ties_y = _positions(g, y, n, count)
            # A single-valued range may be in several tasks: its ties and its rank come from its total.
            rx = np.where(np.isnan(point_x), rx, (point_x + 1.0) / 2.0) + np.where(ranged, before_x, 0.0)
            ry = np.where(ranged, rank_y, ry)
            alone = per_group(ranged) == 0
            interval = per_group(~np.isnan(point_x)) == 0
            for name, values in zip(("tx", "x0", "x1"), ties_x):
                out[name] = np.where(interval, values, 0.0)
            for name, values, others in zip(("ty", "y0", "y1"), ties_y, (ty_near, y0_near, y1_near)):
                out[name] = np.where(alone, values, per_group(np.nan_to_num(others)))
            with np.errstate(invalid="ignore", divide="ignore"):
                middle = [np.where(ranged, m, (per_group(n * v) / weight)[g]) for m, v in ((mean_x, x), (mean_y, y))]
            size = np.where(ranged, total, weight[g])
            dx, dy, rx, ry = x - middle[0], y - middle[1], rx - (size + 1.0) / 2.0, ry - (size + 1.0) / 2.0
            for name, p, q in (("sxy", dx, dy), ("sxx", dx, dx), ("syy", dy, dy), ("rxy", rx, ry), ("rxx", rx, rx), ("ryy", ry, ry)):
                out[name] = per_group(n * p * q)
            out["txy"] = per_group(n * (n - 1.0) / 2.0)
            out["concordant"] = _concordant(g, dense_x, dense_y, n, count) + per_group(np.nan_to_num(near))
            out["min_x"], out["max_x"] = ends(x)
            out["min_y"], out["max_y"] = ends(y)
        frame = pdf.iloc[first][by].reset_index(drop=True)
        for c in columns:
            frame[c] = out.get(c, np.full(count, np.nan if c in END_COLUMNS else 0.0))
        return pd.DataFrame(frame)

    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in columns]])
    return cells.groupBy(part.alias("_part")).applyInPandas(sums, schema)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join; the other columns of ``right`` are added."""
    named = right.withColumnsRenamed({k: f"_k{k}" for k in keys})
    return left.join(named, [left[k].eqNullSafe(named[f"_k{k}"]) for k in keys] or F.lit(True), how).drop(*(f"_k{k}" for k in keys))


def range_number(cuts: str, value: str) -> Column:
    """Twice the number of smaller cuts, one more at a cut; found by halving, as ``cuts`` (at most QUANTILES) are sorted and distinct."""
    def step(at: Column, half: Column) -> Column:
        return F.when(F.get(cuts, at + half - 1) < F.col(value), at + half).otherwise(at)

    halves = F.array(*(F.lit(1 << k) for k in reversed(range(QUANTILES.bit_length()))))
    return let(F.aggregate(halves, F.lit(0), step), lambda s: 2 * s + F.coalesce(F.get(cuts, s) == F.col(value), F.lit(False)).cast("int"))


def _ranged_sums(cells: DataFrame, by: Sequence[str], parts: int, task_cells: int) -> DataFrame:
    """One row of sums per group where some groups have several ranges. Runs a job for the cut points."""
    by = [*by, "_all"]
    cells = cells.withColumn("_all", F.lit(0))
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    steps = [(i + 1) / (QUANTILES + 1) for i in range(QUANTILES)]

    n, x, y = F.col("n"), F.col("x"), F.col("y")
    summary = cells.filter(whole).groupBy(*by).agg(
        F.count("*").alias("cells"), *(F.percentile_approx(v, steps, 20_000).alias(f"cuts_{v}") for v in ("x", "y")),
        F.sum("n").alias("total"), (F.sum(n * x) / F.sum("n")).alias("mean_x"), (F.sum(n * y) / F.sum("n")).alias("mean_y"))

    def cuts(value: str) -> Column:
        """Every so many of the summary's quantiles, as the group's size asks for; equal ones are one cut."""
        ranges = F.least(F.ceil(F.col("cells") / task_cells) + 1, F.lit(QUANTILES + 1)).cast("int")
        wanted = F.transform(F.sequence(F.lit(1), ranges - 1), lambda i: F.get(f"cuts_{value}", F.floor(i * (QUANTILES + 1) / ranges).cast("int") - 1))
        return F.array_distinct(wanted).alias(f"cuts_{value}")

    large = cut_lineage(summary.filter(F.col("cells") > task_cells).select(*by, cuts("x"), cuts("y"), "total", "mean_x", "mean_y"))

    small = _joined(cells, large.select(*by), by, "left_anti").select(*by, "x", "y", "n", *_alone())
    placed = _joined(cells, large, by).select(*by, "x", "y", "n", *(F.when(F.col(v).isNull(), F.lit(-1)).otherwise(range_number(f"cuts_{v}", v)).alias(f"range_{v}") for v in ("x", "y")), "total", "mean_x", "mean_y")
    counts = cut_lineage(placed.filter(whole).groupBy(*by, "range_x", "range_y").agg(F.sum("n").alias("n"), F.count("*").alias("cells")))

    def totals(value: str) -> DataFrame:
        """Weight of every range and of those before it, and the number of tasks of a single-valued one."""
        order = Window.partitionBy(*by).orderBy(f"range_{value}").rowsBetween(Window.unboundedPreceding, -1)
        own = counts.groupBy(*by, f"range_{value}").agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"))
        point = F.col(f"range_{value}") % 2 == 1
        return own.select(*by, f"range_{value}", F.coalesce(F.sum("n").over(order), F.lit(0.0)).alias(f"before_{value}"), F.when(point, F.col("n")).alias(f"point_{value}"),
                          F.when(point, F.ceil(F.col("cells") / task_cells)).otherwise(1).alias(f"tasks_{value}"))

    in_y = _joined(placed.filter(whole), totals("y"), [*by, "range_y"])
    # A single-valued y range has nothing to count; in others a task gives ranks, ties and pairs of different x ranges.
    points = in_y.filter("point_y is not null").withColumn("rank_y", F.col("before_y") + (F.col("point_y") + 1.0) / 2.0)
    carried = [*by, "x", "y", "n", "range_x", "total", "mean_x", "mean_y"]
    names = [*carried, "rank_y", "near", "ty_near", "y0_near", "y1_near"]

    def within(pdf):
        import numpy as np

        n, y = pdf["n"].to_numpy(dtype=np.float64), pdf["y"].to_numpy(dtype=np.float64)
        g, at = np.zeros(len(pdf), int), pdf["range_x"].to_numpy()
        dense, rank, ties = _positions(g, y, n, 1)
        out = pdf[carried].copy()
        out["rank_y"] = rank + pdf["before_y"].to_numpy()
        counted = [_concordant(g, at, dense, n, 1), *ties]
        for c, values in zip(("near", "ty_near", "y0_near", "y1_near"), counted):
            out[c] = np.where(np.arange(len(pdf)) == 0, values[0], 0.0)
        return out

    types = {f.name: f.dataType for f in placed.schema.fields}
    schema = T.StructType([T.StructField(c, types.get(c, T.DoubleType())) for c in names])
    inside = in_y.filter("point_y is null").groupBy(*by, "range_y").applyInPandas(within, schema)
    ranked = points.select(*names[:-4], *(F.lit(0.0).alias(c) for c in names[-4:])).unionByName(inside)
    in_x = _joined(ranked, totals("x"), [*by, "range_x"])
    missing = placed.filter(~whole).withColumn("range_x", F.lit(-1))
    for c in ("rank_y", "before_x", "point_x", "near", "ty_near", "y0_near", "y1_near"):
        missing = missing.withColumn(c, F.lit(None).cast("double"))
    task = F.when(F.col("point_x").isNull(), 0).otherwise(F.pmod(F.xxhash64("y"), "tasks_x"))
    own = in_x.withColumn("unit", F.xxhash64(*by, "range_x", task)).unionByName(missing.withColumn("unit", F.xxhash64(*by, F.pmod(F.xxhash64("x", "y"), F.lit(parts)))), allowMissingColumns=True)
    sums = _task_sums(small.unionByName(own.select(*small.columns)), by, parts)

    # Across ranges: cells of the x ranges before and of the y ranges before, by two windows over the counts.
    spans = counts.groupBy(*by).agg(F.collect_set("range_x").alias("xs"), F.collect_set("range_y").alias("ys"))
    grid = spans.select(*by, F.explode("xs").alias("range_x"), "ys").select(*by, "range_x", F.explode("ys").alias("range_y"))
    filled = _joined(grid, counts, [*by, "range_x", "range_y"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "range_x").orderBy("range_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before = F.coalesce(F.sum("below").over(Window.partitionBy(*by, "range_y").orderBy("range_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pairs = filled.withColumn("below", below).withColumn("before", before).groupBy(*by).agg(F.sum(F.col("n") * F.col("before")).alias("concordant"))
    extra = [pairs]
    for value in ("x", "y"):
        w = F.col(f"point_{value}")
        tied = totals(value).filter(w.isNotNull()).groupBy(*by).agg(F.sum(w * (w - 1) / 2).alias(f"t{value}"), F.sum(w * (w - 1) * (w - 2)).alias(f"{value}0"), F.sum(w * (w - 1) * (2 * w + 5)).alias(f"{value}1"))
        extra.append(tied)
    for rows in extra:
        sums = sums.unionByName(rows, allowMissingColumns=True)
    ends = [(F.min if c.startswith("min") else F.max)(no_nan(c)).alias(c) for c in END_COLUMNS]
    return sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUM_COLUMNS), *ends).drop("_all")


def _finish(total: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Statistics from sums; ``names`` maps the caller's group columns to ours."""
    count, concordant = F.col("rows"), F.col("concordant")
    pairs = count * (count - 1.0) / 2.0
    discordant = pairs - F.col("tx") - F.col("ty") + F.col("txy") - concordant
    tau = F.try_divide(concordant - discordant, F.sqrt(pairs - F.col("tx")) * F.sqrt(pairs - F.col("ty")))
    flat = (F.col("min_x") == F.col("max_x")) | (F.col("min_y") == F.col("max_y"))

    def guarded(value: Column) -> Column:
        return (
            F.when((count < 2) | (F.col("gaps") > 0), F.lit(NAN))
            .when(flat, F.lit(0.0))
            .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
        )

    return total.select(
        *[F.col(ours).alias(theirs) for theirs, ours in names.items()], count.cast("long").alias("n"),
        guarded(tau).alias("kendalltau"),
        guarded(F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))).alias("pearson"),
        guarded(F.try_divide(F.col("rxy"), F.sqrt("rxx") * F.sqrt("ryy"))).alias("spearman"),
        F.col("tx").alias("ties_x"), F.col("ty").alias("ties_y"), *(F.col(c).alias(f"ties_{c}") for c in ("x0", "x1", "y0", "y1")),
    )


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson alone: one pass with mergeable moments, no cells and no ranks."""
    a, b = no_nan(x), no_nan(y)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(a, b), spread)))
    gap = F.bool_or(a.isNull() | b.isNull())
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    value = F.when((F.count("*") < 2) | gap, F.lit(NAN)).when(flat, F.lit(0.0)).otherwise(r)
    return df.groupBy(*by).agg(F.count("*").alias("n"), value.alias("pearson"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return correlations(df, by, x, y).select(*by, "n", "spearman")


def kendall_tau_b(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return correlations(df, by, x, y).select(*by, "n", "kendalltau")


def _two_sided(z: Column) -> Column:
    """Normal tail probability (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    # Coefficients of the published approximation.
    p, coefficients = 0.2316419, [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = 1.0 / (1.0 + p * z)
    series = F.lit(0.0)
    for c in reversed(coefficients):
        series = (series + c) * t
    return F.least(F.lit(1.0), 2.0 * F.exp(-z * z / 2.0) / 2.5066282746310002 * series)


#: Terms of the series for the incomplete beta function, and how often its factors are shifted before their own series.
TERMS, SHIFT = 200, 20


def _series(first: Column, ratio) -> Column:
    """Sum of TERMS terms, each the one before times ``ratio`` of its number."""
    step = lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * ratio(k.cast("double"))).alias("term"))
    start = F.struct(F.lit(0.0).alias("sum"), first.cast("double").alias("term"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step)["sum"]


def _inverse_beta(a: Column) -> Column:
    """1 / B(1/2, a): the ratio of gamma functions at a + SHIFT by its series in 1/a, brought back factor by factor."""
    z = a + float(SHIFT)
    ratio = F.sqrt(z) * (1.0 - 1.0 / (8.0 * z) + 1.0 / (128.0 * z * z) + 5.0 / (1024.0 * z * z * z) - 21.0 / (32768.0 * z * z * z * z))
    for j in range(SHIFT):
        ratio = ratio * (a + float(j)) / (a + (j + 0.5))
    return ratio / 1.7724538509055160273


def tail_probability(r: Column, n: Column) -> Column:
    """Two-sided probability of a correlation of at least ``abs(r)`` among ``n`` independent pairs.

    It is the incomplete beta function I(1 - r²; n/2 - 1, 1/2), by one of two series with positive
    terms. Two pairs give 1, a correlation of one (with more pairs) 0.
    """
    def value(s: Column) -> Column:
        a, q = s["n"] / 2.0 - 1.0, s["r"] * s["r"]
        scale = F.pow(1.0 - q, a) * s["beta"]
        inner = 1.0 - 2.0 * F.abs(s["r"]) * scale * _series(F.lit(1.0), lambda k: (a + 0.5 + k) / (1.5 + k) * q)
        outer = F.abs(s["r"]) * scale / a * _series(F.lit(1.0), lambda k: (a + 0.5 + k) / (a + 1.0 + k) * (1.0 - q))
        # Far out only the leading term counts: it is below 1e-17.
        far = scale / (a * F.abs(s["r"]))
        return F.when(s["n"] <= 2, F.lit(1.0)).when(q >= 1.0, F.lit(0.0)).when(q > 0.5, outer).when(a * q > 40.0, far).otherwise(inner)

    size = n.cast("double")
    own = F.struct(r.alias("r"), size.alias("n"), _inverse_beta(size / 2.0 - 1.0).alias("beta"))
    known = r.isNotNull() & ~F.isnan(r)
    return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(own, value)))).otherwise(F.lit(NAN))


def correlation_pvalues(scores: DataFrame) -> DataFrame:
    """Two-sided p-values of the three statistics, on the finished group rows.

    Pearson and Spearman: ``tail_probability``. Kendall: the normal form with the variance
    corrected for ties. NaN where the statistic is.
    """
    n = F.col("n").cast("double")
    m = n * (n - 1.0)
    score = F.col("kendalltau") * F.sqrt(m / 2.0 - F.col("ties_x")) * F.sqrt(m / 2.0 - F.col("ties_y"))
    third = F.coalesce(F.try_divide(F.col("ties_x0") * F.col("ties_y0"), 9.0 * m * (n - 2.0)), F.lit(0.0))
    variance = (m * (2.0 * n + 5.0) - F.col("ties_x1") - F.col("ties_y1")) / 18.0 + F.try_divide(2.0 * F.col("ties_x") * F.col("ties_y"), m) + third
    z = F.abs(F.try_divide(score, F.sqrt(variance)))
    kendall = F.when(F.isnan("kendalltau"), F.lit(NAN)).otherwise(F.coalesce(_two_sided(z), F.lit(1.0)))
    return scores.withColumns({"kendall_pvalue": kendall, "pearson_pvalue": tail_probability(F.col("pearson"), n), "spearman_pvalue": tail_probability(F.col("spearman"), n)})


#: Groups whose moments a task keeps before it hands them on.
KEPT_GROUPS = 32


def _moments(values):
    """Pairwise counts, means and co-moments of the columns, over the rows where both are there."""
    import numpy as np

    known = ~np.isnan(values)
    mask = known.astype(np.float64)
    n = mask.T @ mask
    size = np.maximum(np.diag(n), 1.0)
    # Moved to the columns' own means first, so that the products below stay small.
    shift = np.where(known, values, 0.0).sum(axis=0) / size
    moved = np.where(known, values - shift, 0.0)
    some = np.maximum(n, 1.0)
    sums, squares, products = moved.T @ mask, (moved**2).T @ mask, moved.T @ moved
    return n, np.where(n > 0, shift[:, None] + sums / some, 0.0), squares - sums**2 / some, products - sums * sums.T / some


def _merged_moments(a, b):
    """Moments of two sets of rows together, by Chan's formula for every pair of columns."""
    import numpy as np

    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    gap = b[1] - a[1]
    both = a[0] * b[0] / some
    return n, np.where(n > 0, a[1] + gap * b[0] / some, 0.0), a[2] + b[2] + gap**2 * both, a[3] + b[3] + gap * gap.T * both


def correlation_matrix(df: DataFrame, metrics: Sequence[str], keys: Sequence[str], by: Sequence[str] = ("lang",),
                       value: str = "value", order: str | Column | None = None) -> DataFrame:
    """Pearson between every two metrics, items lined up by key; each pair over the items that have both.

    An item is one array of values. Tasks make blocks of items into matrices of pairwise
    counts, means and co-moments by matrix products, and merge them; per pair of
    metrics the few matrices of a group are merged once more. Any number of metrics is one
    grouped pass. Fewer than two items give NaN, a constant side null.
    """
    import pyarrow as pa

    by, count = list(by), len(metrics)
    v = no_nan(value)
    place = (F.col(order) if isinstance(order, str) else order) if order is not None else v
    index = F.array_position(F.array(*map(F.lit, metrics)), F.col("metric"))
    single = df.withColumn("_i", index.cast("int")).filter("_i > 0").groupBy(*by, *keys, "_i").agg(F.min_by(v, place).alias("_v"))
    listed = single.groupBy(*by, *keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
    places = F.sequence(F.lit(1), F.lit(count))
    items = listed.select(F.to_json(F.struct(*by)).alias("_key") if by else F.lit("").alias("_key"),
                          F.transform(places, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(NAN))).alias("_v"))
    names = ["_key", "_a", "_b", "n", "mean_a", "mean_b", "aa", "bb", "ab"]

    def blocks(batches):
        import numpy as np

        upper = np.triu_indices(count)
        kept: dict = {}

        def handed_on():
            for key, (n, mean, square, product) in kept.items():
                columns = [n[upper], mean[upper], mean.T[upper], square[upper], square.T[upper], product[upper]]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(upper[0])), pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *map(pa.array, columns)], names=names)
            kept.clear()

        for batch in batches:
            values = np.asarray(batch.column("_v").flatten(), dtype=np.float64).reshape(-1, count)
            groups, own = np.unique(np.array(batch.column("_key").to_pylist(), dtype=object), return_inverse=True)
            for k, key in enumerate(groups):
                some = _moments(values[own == k])
                kept[key] = _merged_moments(kept[key], some) if key in kept else some
                if len(kept) >= KEPT_GROUPS:
                    yield from handed_on()
        yield from handed_on()

    parts = items.select("_key", "_v").mapInArrow(blocks, "_key string, _a int, _b int, n double, mean_a double, mean_b double, aa double, bb double, ab double")

    def merge(s: Column, t: Column) -> Column:
        n, both = s["n"] + t["n"], s["n"] * t["n"] / F.greatest(s["n"] + t["n"], F.lit(1.0))
        da, db, share = t["mean_a"] - s["mean_a"], t["mean_b"] - s["mean_b"], t["n"] / F.greatest(s["n"] + t["n"], F.lit(1.0))
        return F.struct(n.alias("n"), (s["mean_a"] + da * share).alias("mean_a"), (s["mean_b"] + db * share).alias("mean_b"),
                        (s["aa"] + t["aa"] + da * da * both).alias("aa"), (s["bb"] + t["bb"] + db * db * both).alias("bb"), (s["ab"] + t["ab"] + da * db * both).alias("ab"))

    none = F.struct(*(F.lit(0.0).alias(c) for c in names[3:]))
    # One entry per task that saw the group, in a fixed order.
    entries = F.sort_array(F.collect_list(F.struct(*names[3:])))
    merged = parts.groupBy("_key", "_a", "_b").agg(F.aggregate(entries, none, merge).alias("t"))

    def flat(side: str) -> Column:
        # What rounding leaves of a constant side.
        return F.col(f"t.{side}{side}") <= F.col("t.n") * F.pow(F.col(f"t.mean_{side}") * 1e-13, F.lit(2.0))

    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("t.ab") / (F.sqrt("t.aa") * F.sqrt("t.bb"))))
    pearson_value = F.when(F.col("t.n") < 2, F.lit(NAN)).when(~(flat("a") | flat("b")), r)
    ways = F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")), F.struct(F.col("_b").alias("a"), F.col("_a").alias("b")))
    both = merged.select("_key", F.explode(F.array_distinct(ways)).alias("w"), F.col("t.n").cast("long").alias("n"), pearson_value.alias("pearson"))
    listed_metrics = F.array(*map(F.lit, metrics))
    named = both.select("_key", F.get(listed_metrics, F.col("w.a")).alias("metric_a"), F.get(listed_metrics, F.col("w.b")).alias("metric_b"), "n", "pearson")
    if not by:
        return named.drop("_key")
    schema = T.StructType([f for c in by for f in df.schema.fields if f.name == c])
    return named.withColumn("_by", F.from_json("_key", schema)).select("_by.*", "metric_a", "metric_b", "n", "pearson")
