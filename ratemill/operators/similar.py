"""Exact and approximate nearest neighbours by dot product.

All pairs of targets and pool have to be scored, so the work is laid out as a
grid: targets are cut into row blocks, the pool into column blocks, and each
(row, column) cell is one task-sized matrix product that keeps only the best
``k`` per target. Block counts follow from the table sizes, so no cell grows
with the data; nothing is broadcast and no similarity matrix is ever a table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.functions.values import l2_normalize, uniform
from ratemill.operators.cells import BLOCK_ROWS, CELL_ROWS, topk_cells
from ratemill.operators.relational import first_rows, topk

MIN_CELLS = 8
#: Similarities that a task holds at once; a chunk has fewer targets where the pool's block is long.
SCORES = 2_000_000


def _block(df_id: str, count):
    return F.floor(uniform("block", F.col(df_id)) * count).cast("int")


def chunk_rows(pool_rows: int) -> int:
    """Targets that are scored at once against a block of the pool."""
    return max(1, min(1024, SCORES // pool_rows))


def grid_topk(targets: DataFrame, pool: DataFrame, k: int, rows, columns, extra: Sequence[str] = (),
              exclude_same_fold: bool = False) -> DataFrame:
    """Best ``k`` pool items per target and grid cell, not yet merged.

    Both sides have ``*_id``, ``vector`` and, to leave out a target's own fold,
    ``fold``. ``extra`` columns (hash table and bucket, say) must agree. Block
    counts are numbers, or columns that both sides have.
    """
    rows, columns = (F.lit(c) if isinstance(c, int) else F.col(c) for c in (rows, columns))
    extra = list(extra)
    fold = ["fold"] if exclude_same_fold else []
    left = targets.select(*extra, *fold, "target_id", "vector", _block("target_id", rows).alias("_r"),
                          F.explode(F.sequence(F.lit(0), columns - 1)).alias("_c"))
    # Fresh names: both sides may come from one table, and its columns must not be mixed up.
    own = [F.col(c).alias(f"item_{c}") for c in [*extra, *fold, "vector"]]
    right = pool.select(*own, F.col("item_id").alias("item_key"), _block("item_id", columns).alias("_c"),
                        F.explode(F.sequence(F.lit(0), rows - 1)).alias("_r"))
    target_type = targets.schema["target_id"].dataType.simpleString()
    item_type = pool.schema["item_id"].dataType.simpleString()

    def best(a, b):
        import numpy as np
        import pandas as pd

        names = ["target_id", "item_id", "similarity"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        b = b.sort_values("item_key", kind="stable")
        matrix = np.stack(b["item_vector"].to_numpy()).astype(np.float64)
        ids = b["item_key"].to_numpy()
        frames = []
        chunk = chunk_rows(len(b))
        for start in range(0, len(a), chunk):
            part = a.iloc[start : start + chunk]
            # Rounded, so that equal vectors tie whatever the blocking of the product.
            scores = np.stack(part["vector"].to_numpy()).astype(np.float64) @ matrix.T
            np.round(scores, 12, out=scores)
            if exclude_same_fold:
                own = part["fold"].to_numpy()[:, None] == b["item_fold"].to_numpy()[None, :]
                scores[own] = -np.inf
            take = min(k, scores.shape[1])
            # Everything at least as good as the k-th best, so that ties stay whole until ids decide.
            floor = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
            at, which = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
            values = scores[at, which]
            order = np.lexsort((which, -values, at))
            at, which, values = at[order], which[order], values[order]
            first = np.r_[0, np.nonzero(np.diff(at))[0] + 1] if len(at) else np.array([], dtype=int)
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) if len(at) else at
            kept = place < k
            frames.append(pd.DataFrame({
                "target_id": part["target_id"].to_numpy()[at[kept]],
                "item_id": ids[which[kept]],
                "similarity": values[kept],
            }))
        return pd.concat(frames, ignore_index=True)

    keys, item_keys = [*extra, "_r", "_c"], [*[f"item_{c}" for c in extra], "_r", "_c"]
    return left.groupBy(*keys).cogroup(right.groupBy(*item_keys)).applyInPandas(
        best, f"target_id {target_type}, item_id {item_type}, similarity double")


def grid_shape(target_rows: int, pool_rows: int, block_rows: int = BLOCK_ROWS, min_cells: int = MIN_CELLS) -> tuple[int, int]:
    """(row blocks, column blocks): no block above ``block_rows``, and at least
    ``min_cells`` cells so that small inputs still use all cores."""
    rows, columns = max(1, math.ceil(target_rows / block_rows)), max(1, math.ceil(pool_rows / block_rows))
    return max(rows, min(math.ceil(min_cells / columns), max(target_rows, 1))), columns


def topk_similar(targets: DataFrame, pool: DataFrame, k: int, exclude_same_fold: bool = False,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact ``k`` best pool items per target with ``similarity`` and ``rank``.

    Counts both tables first (two jobs). A pool smaller than ``k`` is returned whole.
    """
    cells = targets.sparkSession.sparkContext.defaultParallelism
    rows, columns = grid_shape(targets.count(), pool.count(), block_rows, max(MIN_CELLS, cells))
    return topk(grid_topk(targets, pool, k, rows, columns, exclude_same_fold=exclude_same_fold), k)


def similarity_join(targets: DataFrame, pool: DataFrame, k: int, **options) -> DataFrame:
    """Dot products of every target with the pool, kept down to the best ``k``."""
    return topk_similar(targets, pool, k, **options)


def topk_similar_approx(targets: DataFrame, pool: DataFrame, k: int, cell_rows: int = CELL_ROWS, spare: float = 0.0, seed: int = 7,
                        block_rows: int = BLOCK_ROWS, exclude_same_fold: bool = False) -> DataFrame:
    """Neighbours by an inverted file: cells are left out where their bound says they cannot help.

    ``spare`` shortens the cells' radii by that share and makes the search approximate;
    with 0 it finds what the exact form finds. Every target has as many rows as there.
    """
    return topk_cells(targets, pool, k, exclude_same_fold, cell_rows, block_rows, seed, spare)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate form found. One row."""
    found = approximate.select("target_id", "item_id", F.lit(1).alias("_f"))
    return exact.join(found, ["target_id", "item_id"], "left").agg(
        F.avg(F.coalesce("_f", F.lit(0))).alias("recall"), F.count("*").alias("exact_rows"))


def two_stage_topk(targets: DataFrame, pool: DataFrame, k: int, n: int, rescore=None, **options) -> DataFrame:
    """Retrieve ``k``, rescore, keep ``n``; without a rescorer the first ``n``.

    ``rescore`` takes the candidate rows and returns them with a ``score`` column.
    """
    candidates = topk_similar(targets, pool, k, **options)
    if rescore is None:
        return candidates.filter(F.col("rank") <= n)
    scored = rescore(candidates.withColumnRenamed("rank", "first_rank"))
    return first_rows(scored, ["target_id"], [F.col("score").desc(), F.col("item_id")], n, rank="rank")


def unit_vectors(df: DataFrame, ident: str, vector: str, name: str, *extra: str) -> DataFrame:
    return df.select(F.col(ident).alias(name), l2_normalize(vector).alias("vector"), *extra)
