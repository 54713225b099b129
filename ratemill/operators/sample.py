"""Seeded sampling and fold assignment.

Draws are digests of ids and seed, so no operator depends on row order,
partitioning or retries. Nothing is numbered or sorted over a whole table. Samples
without replacement are cut off: counts by the leading digits of the digests give
the digit at which the sample is full, that digit is counted once more by its
next digits, and only what shares those is ordered. Draws with replacement go
down the same digits: a draw falls into a digit by the counts, then into one of
its next digits, and only there do items have places.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratemill.session import cut_lineage

SEED = 114514
DIGEST_PREFIX = 3
#: Strata whose cuts are broadcast; beyond, they are joined.
BROADCAST_STRATA = 100_000
#: Draws made from one row.
CHUNK = 4096


def key_text(keys: Sequence[str]):
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def dense_index(df: DataFrame, keys: Sequence[str], by: Sequence[str] = (), name: str = "idx",
                prefix: int = DIGEST_PREFIX, text=None) -> DataFrame:
    """Number the rows 0..N-1 within ``by`` in the order (digest prefix, key), or of ``text``, a column of digests.

    ``keys`` identify a row within ``by``. A task orders one prefix of one
    group, 1/4096 of the group by default; only the counts per prefix are summed
    up in a row.
    """
    by = list(by)
    cut = df.withColumn("_text", key_text(keys) if text is None else text)
    cut = cut.withColumn("_prefix", F.substring(F.md5("_text") if text is None else F.col("_text"), 1, prefix))
    counts = cut.groupBy(*by, "_prefix").agg(F.count("*").alias("_n"))
    # Without ``by`` the window orders one small table of at most 16 ** prefix rows.
    before = Window.partitionBy(*by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_prefix").alias("_p"), "_start")
    inside = Window.partitionBy(*by, "_prefix").orderBy("_text", *keys)
    placed = cut.withColumn("_in", F.row_number().over(inside) - 1)
    match = placed["_prefix"] == starts["_p"]
    for c in by:
        match = match & placed[c].eqNullSafe(starts[f"_{c}"])
    return placed.join(starts, match).withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop(
        "_text", "_prefix", "_p", "_start", "_in", *[f"_{c}" for c in by])


def digest(*parts):
    """Hexadecimal digest of the parts: the order of draws."""
    columns = [part if isinstance(part, F.Column) else F.lit(part) for part in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def by_columns(by: Sequence[str]):
    return [F.col(c) for c in by]


def _cuts(rows: DataFrame, by: Sequence[str], digits: int, need) -> DataFrame:
    """``by, _cut, _need``: the leading digits at which the smallest ``need`` rows are full, and how many of them are in."""
    counts = rows.groupBy(*by, F.substring("_digest", 1, digits).alias("_cut")).agg(F.count("*").alias("_n"), need.alias("_all"))
    up_to = F.sum("_n").over(Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_to", up_to).filter((F.col("_to") >= F.col("_all")) & (F.col("_to") - F.col("_n") < F.col("_all"))).select(
        *by, "_cut", (F.col("_all") - F.col("_to") + F.col("_n")).alias("_need"))


def smallest(df: DataFrame, n: int, draw, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of each ``by`` with the smallest (draw, keys); all rows of a smaller one.

    A table is read three times: for counts by three digits of ``draw``, for the rows at the
    cut, which are checkpointed and counted by three more digits, and for the rows below
    the last one. Only rows that share six digits with that one are ordered. Rows that share the
    keys are told apart by nothing; as many of them are taken as fit.
    """
    if n <= 0:
        return df.limit(0)
    strata, names = list(by) or ["_whole"], df.columns
    marked = df.withColumn("_digest", draw)
    if not by:
        marked = marked.withColumn("_whole", F.lit(0))
    first = _cuts(marked, strata, 3, F.lit(n))
    few = not by or first.count() <= BROADCAST_STRATA

    def matched(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        return _null_safe(rows, F.broadcast(table) if few else table, strata, how)

    near = matched(marked.select(*dict.fromkeys([*strata, *keys, "_digest"])), first, "inner")
    near = cut_lineage(near.filter(F.substring("_digest", 1, 3) == F.col("_cut")).drop("_cut"))
    second = _cuts(near, strata, 6, F.first("_need"))
    edge = matched(near.drop("_need"), second, "inner").filter(F.substring("_digest", 1, 6) == F.col("_cut"))
    order = Window.partitionBy(*strata).orderBy("_digest", *keys)
    placed = edge.withColumn("_place", F.row_number().over(order)).withColumn("_rank", F.rank().over(order))
    last = placed.filter(F.col("_place") == F.col("_need")).select(
        *strata, F.struct("_digest", *keys).alias("_last"), (F.col("_place") - F.col("_rank") + 1).alias("_equal"))
    own = F.struct("_digest", *keys)
    limited = matched(marked, last, "left")
    below = limited.filter(F.col("_last").isNull() | (own < F.col("_last")))
    at = limited.filter(own == F.col("_last")).withColumn("_place", F.row_number().over(Window.partitionBy(*strata).orderBy("_digest")))
    return below.select(*names).unionByName(at.filter(F.col("_place") <= F.col("_equal")).select(*names))


def _descend(draws: DataFrame, counts: DataFrame, node: Sequence[str], child: str) -> DataFrame:
    """Draws at place ``_at`` of ``_size`` rows of a node, moved to the child that holds the place.

    Children begin where those before end. A node's places are dealt into 4096 cells, so that a draw
    only meets the children that reach into its own.
    """
    inside = Window.partitionBy(*node)
    spans = counts.withColumn("_total", F.sum("_n").over(inside)).withColumn(
        "_begin", F.sum("_n").over(inside.orderBy(child).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))

    def cell(place, size):
        return F.floor(place * 4096 / size).cast("int")

    reach = F.sequence(cell(F.col("_begin"), F.col("_total")), cell(F.col("_begin") + F.col("_n") - 1, F.col("_total")))
    dealt = spans.select(*node, child, "_begin", "_n", F.explode(reach).alias("_cell"))
    met = _null_safe(draws.withColumn("_cell", cell(F.col("_at"), F.col("_size"))), dealt, [*node, "_cell"], "inner")
    inside_child = (F.col("_at") >= F.col("_begin")) & (F.col("_at") < F.col("_begin") + F.col("_n"))
    return met.filter(inside_child).withColumn("_at", F.col("_at") - F.col("_begin")).withColumn("_size", F.col("_n")).drop("_cell", "_begin", "_n")


def bootstrap_groups(pool: DataFrame, keys: Sequence[str], n: int, bootstraps: int, replace: bool = True,
                     seed: int = SEED, by: Sequence[str] = ()) -> DataFrame:
    """``n`` drawn items per bootstrap (and per ``by``, e.g. fold): one row per
    draw with ``bootstrap_id`` and ``copy_id``.

    The pool holds one row per item. ``n <= 0`` gives no rows; a null ``by`` is a group.
    The distinct items are checkpointed. Draws with replacement are 60 bits of a digest.
    """
    by = list(by)
    items = pool.select(*by, *keys).distinct()
    if not replace:
        spread = items.withColumn("bootstrap_id", F.explode(F.sequence(F.lit(0), F.lit(bootstraps - 1))))
        order = digest(seed, F.col("bootstrap_id"), *by_columns(by), key_text(keys))
        drawn = smallest(spread, n, order, keys, [*by, "bootstrap_id"])
        return dense_index(drawn, keys, [*by, "bootstrap_id"], "copy_id", text=order).withColumn("copy_id", F.col("copy_id").cast("int"))
    named = items.withColumn("_digest", digest(key_text(keys)))
    named = cut_lineage(named.withColumn("_six", F.substring("_digest", 1, 6)))
    sixes = named.groupBy(*by, "_six").agg(F.count("*").alias("_n")).withColumn("_three", F.substring("_six", 1, 3))
    threes = sixes.groupBy(*by, "_three").agg(F.sum("_n").alias("_n"))
    sizes = threes.groupBy(*by).agg(F.sum("_n").alias("_size"))
    total = bootstraps * max(n, 0)
    chunks = F.sequence(F.lit(0), F.lit((total - 1) // CHUNK)) if total else F.array().cast("array<int>")
    begun = sizes.withColumn("_chunk", F.explode(chunks)).repartition(*by, "_chunk") if total else sizes.withColumn("_chunk", F.explode(chunks))
    draws = begun.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(CHUNK - 1)))).withColumn("_i", F.col("_chunk").cast("long") * CHUNK + F.col("_i")).filter(F.col("_i") < total)
    draws = draws.select(*by, "_size", F.floor(F.col("_i") / max(n, 1)).cast("int").alias("bootstrap_id"), (F.col("_i") % max(n, 1)).cast("int").alias("copy_id"))
    number = F.conv(F.substring(digest(seed, F.col("bootstrap_id"), *by_columns(by), F.col("copy_id")), 1, 15), 16, 10).cast("long")
    fallen = _descend(draws.withColumn("_at", number % F.col("_size")), threes, by, "_three")
    fallen = _descend(fallen, sixes, [*by, "_three"], "_six")
    hit = fallen.select(*by, "_six").distinct()
    inside = Window.partitionBy(*by, "_six").orderBy("_digest", *keys)
    placed = _null_safe(named, hit, [*by, "_six"], "inner").withColumn("_at", (F.row_number().over(inside) - 1).cast("long"))
    return _null_safe(fallen, placed, [*by, "_six", "_at"], "inner").select(*by, "bootstrap_id", "copy_id", *keys)


def sample_groups(pool: DataFrame, keys: Sequence[str], n: int, seed: int = SEED, by: Sequence[str] = ()) -> DataFrame:
    """``n`` items without replacement (per ``by``): the smallest draws win. The distinct items are checkpointed."""
    items = cut_lineage(pool.select(*by, *keys).distinct())
    return smallest(items, n, digest(seed, *by_columns(by), key_text(keys)), keys, by)


def sample_ids_split(df: DataFrame, n: int | None, id_column: str = "encounter_id", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows of ``n`` sampled ids, rows of the remaining ids). None takes all."""
    if n is None:
        return df, df.limit(0)
    if n == 0:
        return df.limit(0), df
    picked = sample_groups(df, [id_column], n, seed)
    return df.join(picked, id_column, "left_semi"), df.join(picked, id_column, "left_anti")


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, keys: Sequence[str], seed: int = SEED,
                      check: bool = True) -> DataFrame:
    """``n`` rows per stratum. A stratum with fewer is an error (``check`` runs a job)."""
    picked = smallest(df, n, digest(seed, key_text(keys)), keys, strata)
    if check:
        short = picked.groupBy(*strata).agg(F.count("*").alias("n")).filter(F.col("n") < n).limit(5).collect()
        if short:
            raise ValueError(f"strata with fewer than {n} rows: {short}")
    return picked


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = SEED) -> DataFrame:
    """``n`` rows: those with the smallest draws of their keys."""
    return smallest(df, n, digest(seed, key_text(keys)), keys)


# ---------------------------------------------------------------- folds


def fold_quotas(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, int]]:
    """(size, fold, first, last) so that groups of one size fill the lightest
    folds first, largest size first.

    Giving equal groups one by one to the lightest fold is the same as filling
    all folds up to one level, so a whole size is settled by a bisection. The
    input has one entry per distinct size, however many groups there are.
    """
    loads, quotas = [0] * k, []
    for size, count in sorted(sizes, reverse=True):
        step = max(int(size), 1)

        def room(level: int) -> list[int]:
            return [max(0, -(-(level - load) // step)) for load in loads]

        low, high = min(loads), max(loads) + step * (int(count) + 1)
        while low < high:
            middle = (low + high + 1) // 2
            if sum(room(middle)) <= count:
                low = middle
            else:
                high = middle - 1
        given = room(low)
        left = int(count) - sum(given)
        # Folds whose next group would start exactly at the level come first.
        for fold in sorted(range(k), key=lambda i: (loads[i] + given[i] * step, i))[:left]:
            given[fold] += 1
        start = 0
        for fold in range(k):
            if given[fold]:
                quotas.append((int(size), fold, start, start + given[fold] - 1))
            start += given[fold]
            loads[fold] += given[fold] * int(size)
    return quotas


def group_kfold(df: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """One row per group with its ``fold``; groups never straddle folds and fold
    sizes are balanced, largest groups first.

    Runs one job: the table of group sizes (one row per distinct size) is read
    to settle the quotas. The groups themselves stay on the cluster.
    """
    spark = df.sparkSession
    groups = df.groupBy(*keys).agg(F.count("*").alias("size"))
    table = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]
    quotas = spark.createDataFrame(fold_quotas(table, k) or [(0, 0, 0, 0)], "size long, fold int, first long, last long")
    placed = dense_index(groups, keys, ["size"])
    # The quotas came through the driver: distinct sizes times folds.
    quotas = F.broadcast(quotas)
    return placed.join(quotas, (placed["size"] == quotas["size"]) & (placed["idx"] >= quotas["first"])
                       & (placed["idx"] <= quotas["last"])).select(*keys, placed["size"], "fold")


def with_folds(df: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    folds = group_kfold(df, keys, k).select(*[F.col(c).alias(f"_{c}") for c in keys], "fold")
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return df.join(folds, match).select(*df.columns, "fold")


# ---------------------------------------------------------------- oversampling

# How often rows of a class are repeated in the fixed scheme.
FIXED_FACTORS = {
    "disagree_flag": {2: 4},
    "completeness": {0: 11, 1: 11},
    "factual-accuracy": {0: 11, 1: 11},
    "relevance": {0: 11, 1: 11},
    "writing-style": {0: 11, 1: 11},
}
FIXED_SCHEME_WORD = "wound"
ADAPTIVE_RATIO = 3
ADAPTIVE_LIMIT = 10


def _null_safe(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the other columns of ``table``; null keys match each other."""
    named = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(named, same, how).drop(*(f"_key_{k}" for k in keys))


def oversample(df: DataFrame, scheme: str = "adaptive", label: str = "label", by: Sequence[str] = ("metric",),
               factors: Mapping[str, Mapping[int, int]] = FIXED_FACTORS, adaptive_ratio: int = ADAPTIVE_RATIO, adaptive_limit: int = ADAPTIVE_LIMIT) -> DataFrame:
    """Rows of rare classes repeated; ``copy`` numbers the copies of a row. No row is lost; a null is a class.

    "fixed": by metric and class, where any data set name holds the trigger
    word. "adaptive": per ``by``, a class that is over three times rarer than
    the largest one is repeated up to ten times.
    """
    by = list(by)
    if scheme == "fixed":
        factor = F.lit(1)
        for metric, classes in factors.items():
            for cls, times in classes.items():
                factor = F.when((F.col("metric") == metric) & (F.col(label) == cls), F.lit(times)).otherwise(factor)
        triggered = df.groupBy(*by).agg(
            F.bool_or(F.contains(F.lower("dataset"), F.lit(FIXED_SCHEME_WORD))).alias("_on"))
        counted = _null_safe(df, triggered, by).withColumn("_f", F.when(F.col("_on"), factor).otherwise(1)).drop("_on")
    elif scheme == "adaptive":
        counts = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
        largest = F.max("_n").over(Window.partitionBy(*by))
        ratio = F.floor(largest / F.col("_n"))
        rare = F.col("_n") * adaptive_ratio < largest
        table = counts.withColumn("_f", F.when(rare, F.least(ratio, F.lit(adaptive_limit))).otherwise(1).cast("int")).drop("_n")
        counted = _null_safe(df, table, [*by, label])
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_f")))).drop("_f").select(*df.columns, "copy")
