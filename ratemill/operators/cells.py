"""Nearest neighbours by an inverted file with bounds.

The pool is dealt into cells around centres; a cell knows the angles and lengths of its
vectors. A target first meets the cell of its nearest centre, which gives it ``k`` hits
and so a similarity to beat. Then it meets only those other cells that can hold something
better: by the triangle inequality on the sphere no vector of a cell is nearer to the
target than the centre's angle less the cell's radius. What comes out is exact.

Centres are fitted to a bounded sample, every item is indexed. Cells longer than a block
are cut into blocks, so a vector that a third of the pool shares is dealt to many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.functions.values import uniform
from ratemill.operators.relational import topk
from ratemill.session import scratch_path

#: Items of a cell, cells of a pool (more items make longer cells) and sampled items per cell that fit its centre.
CELL_ROWS, MOST_CELLS, SAMPLED = 4000, 1024, 64
#: Rows of one side that meet in a task.
BLOCK_ROWS = 20000
#: Rounds of k-means; targets scored at once inside a task; what single precision may be off, in products and in angles.
ROUNDS, CHUNK, SINGLE, ANGLE = 8, 1024, 1e-4, 1e-3


def _matrix(column):
    """Vectors of an Arrow column as a matrix."""
    import numpy as np

    array = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(array.flatten()).reshape(len(array), -1)


def _unit(matrix):
    """Directions in single precision, and lengths."""
    import numpy as np

    lengths = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
    return (matrix / np.maximum(lengths, 1e-300)[:, None]).astype(np.float32), lengths


def _angle(cosine):
    import numpy as np

    return np.arccos(np.clip(cosine, -1.0, 1.0))


def fit_centres(pool: DataFrame, rows: int, cell_rows: int = CELL_ROWS, seed: int = 7):
    """Unit centres of spherical k-means over at most SAMPLED items per cell, drawn by id."""
    import numpy as np

    cells = min(max(1, math.ceil(rows / cell_rows)), MOST_CELLS)
    wanted = min(SAMPLED * cells, max(rows, 1))
    drawn = pool.filter(uniform(seed, F.col("item_id")) < min(1.0, 1.3 * wanted / max(rows, 1) + 20 / max(rows, 1)))
    sample = sorted((str(r["item_id"]), r["vector"]) for r in drawn.select("item_id", "vector").limit(2 * wanted + 100).collect())
    if not sample:
        return np.zeros((1, len((pool.select("vector").first() or [[0.0]])[0])), np.float32)
    points = _unit(np.array([v for _, v in sample]))[0]
    centres = points[np.random.default_rng(seed).choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(ROUNDS):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        lengths = np.sqrt((sums**2).sum(axis=1))
        centres = np.where(lengths[:, None] > 1e-6, sums / np.maximum(lengths, 1e-6)[:, None], centres).astype(np.float32)
    return centres


def _assigned(rows: DataFrame, centres, ident: str) -> DataFrame:
    """Rows with the ``cell`` of the nearest centre, the ``angle`` to it and the vector's ``length``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.schema
    arrow = to_arrow_schema(schema)

    def nearest(batches: Iterator):
        for batch in batches:
            if batch.num_rows:
                unit, length = _unit(_matrix(batch.column("vector")))
                cosine = unit @ centres.T
                cell = cosine.argmax(axis=1)
                angle = _angle(cosine[range(len(cell)), cell])
                columns = [batch.column(f.name).cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64()), pa.array(length, pa.float64())], names=[*arrow.names, "cell", "angle", "length"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return rows.filter("vector is not null").mapInArrow(nearest, f"{names}, cell int, angle double, length double")


def _best(targets, items, k: int, own_fold: bool, above=None):
    """(place of target, place of item, similarity) of all pairs that can be among the best ``k`` of their target.

    Similarities are taken in single precision first; what is not clearly below the k-th
    best, or below ``above``, is taken again in double precision and rounded, so that equal
    vectors tie.
    """
    import numpy as np

    left, right = _matrix(targets.column("vector")), _matrix(items.column("vector"))
    a, b = left.astype(np.float32), right.astype(np.float32)
    slack = SINGLE * max(1e-30, float(np.sqrt((a**2).sum(axis=1)).max())) * max(1e-30, float(np.sqrt((b**2).sum(axis=1)).max()))
    folds = (targets.column("fold").to_numpy(), items.column("fold").to_numpy()) if own_fold else None
    found = []
    for start in range(0, len(a), CHUNK):
        scores = a[start:start + CHUNK] @ b.T
        if folds:
            scores[folds[0][start:start + CHUNK, None] == folds[1][None, :]] = -np.inf
        floor = np.full(len(scores), -np.inf) if above is None else above[start:start + CHUNK].copy()
        loose = np.flatnonzero(np.isinf(floor))
        if len(loose) and scores.shape[1] > k:
            floor[loose] = np.partition(scores[loose], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        at, which = np.nonzero((scores >= (floor - slack)[:, None].astype(np.float32)) & np.isfinite(scores))
        value = np.round(np.einsum("ij,ij->i", left[at + start].astype(np.float64), right[which].astype(np.float64)), 12)
        found.append((at + start, which, value))
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))


def _first(at, ids, value, k: int):
    """Places of the best ``k`` of each target, the smaller id on ties, in order of target."""
    import numpy as np

    order = np.lexsort((ids, -value, at))
    at = at[order]
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    return order[place < k]


def topk_cells(targets: DataFrame, pool: DataFrame, k: int, exclude_same_fold: bool = False, cell_rows: int = CELL_ROWS,
               block_rows: int = BLOCK_ROWS, seed: int = 7, spare: float = 0.0) -> DataFrame:
    """The best ``k`` pool items of every target: ``target_id, item_id, similarity, rank``.

    Both sides have ``*_id``, ``vector`` and, to leave out a target's own fold, ``fold``.
    ``spare`` takes that share off every radius: 0 is exact, more visits fewer cells and can miss
    items at the rim of others. A target has min(k, items it may have) rows. Rows without
    vector are left out.

    Runs jobs: the pool is counted, a sample of at most 2 * SAMPLED * MOST_CELLS items fits the
    centres on the driver, and three tables go to scratch: the index, what the nearest cell
    gave, and the final hits. Centres and a row per cell (at most MOST_CELLS) are sent to tasks.
    """
    import numpy as np
    import pyarrow as pa

    spark, path = targets.sparkSession, scratch_path(targets.sparkSession, "cells")
    fold = ["fold"] if exclude_same_fold else []
    pool, targets = pool.select("item_id", "vector", *fold), targets.select("target_id", "vector", *fold)
    target_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((targets, "target_id"), (pool, "item_id")))
    vector_type, fold_type = targets.schema["vector"].dataType.simpleString(), targets.schema["fold"].dataType.simpleString() if fold else None
    rows = pool.count()
    centres = fit_centres(pool.filter("vector is not null"), rows, cell_rows, seed)
    _assigned(pool, centres, "item_id").write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    stats = index.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("length").alias("short"), F.max("length").alias("long"))
    table = {r["cell"]: (max(1, math.ceil(r["n"] / block_rows)), r["low"], r["high"] * (1.0 - spare), r["short"], r["long"]) for r in stats.collect()}
    used = sorted(table)
    if not used:
        return spark.createDataFrame([], f"target_id {target_type}, item_id {item_type}, similarity double, rank int")
    blocks, low, high, short, long = (np.array([table[c][i] for c in used]) for i in range(5))
    # Units are the blocks of all cells, numbered; every unit is one group of items.
    first_unit = np.cumsum(blocks) - blocks
    unit_cell = np.repeat(np.arange(len(used)), blocks)
    own_centres = centres[used]

    def of_cell(values, column):
        return F.expr(f"array({', '.join(str(int(v)) for v in values)})")[column]

    def unit(seed: str, ident: str, cell):
        return (of_cell(first_unit, cell) + F.floor(uniform(seed, F.col(ident)) * of_cell(blocks, cell))).cast("int").alias("unit")

    place = np.zeros(len(centres), int)
    place[used] = np.arange(len(used))
    items = index.withColumn("cell", of_cell(place, F.col("cell"))).select("item_id", "vector", *fold, unit("unit", "item_id", F.col("cell")))

    def hits(found, ids):
        at, which, value = found
        ids = ids.combine_chunks().to_numpy(zero_copy_only=False)
        order = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
        keep = _first(at, order[which], value, k)
        return at[keep], which[keep], value[keep]

    # The nearest cell: one of its blocks, dealt by target.
    near = _assigned(targets, own_centres, "target_id")
    near = near.select("target_id", "vector", *fold, unit("near", "target_id", F.col("cell")))
    seen_schema = f"target_id {target_type}, vector {vector_type}, unit int, floor double, items array<{item_type}>, similarities array<double>" + (f", fold {fold_type}" if fold else "")

    def meet(left, right):
        names = ["target_id", "vector", "unit", "floor", "items", "similarities", *fold]
        n = left.num_rows
        if n and right.num_rows:
            at, which, value = hits(_best(left, right, k, bool(fold)), right.column("item_id"))
        else:
            at, which, value = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        counts = np.bincount(at, minlength=n)
        ends = np.concatenate([[0], np.cumsum(counts)])
        floor = np.full(n, -np.inf)
        full = np.flatnonzero(counts >= k)
        floor[full] = value[ends[full + 1] - 1]
        ids = right.column("item_id").combine_chunks().take(pa.array(which))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (ids, pa.array(value))]
        return pa.table([left.column("target_id"), left.column("vector"), left.column("unit"), pa.array(floor), *lists, *[left.column(f) for f in fold]], names=names)

    by_unit = near.withColumn("met", F.col("unit")).groupBy("met")
    by_unit.cogroup(items.withColumnRenamed("unit", "own").groupBy("own")).applyInArrow(lambda key, a, b: meet(a, b), seen_schema).write.parquet(f"{path}/near")
    seen = spark.read.schema(seen_schema).parquet(f"{path}/near")
    cuts = max(1, math.ceil(seen.count() / block_rows))

    # The other cells that can hold something better.
    def visits(batches: Iterator):
        for batch in batches:
            if not batch.num_rows:
                continue
            direction, length = _unit(_matrix(batch.column("vector")))
            floor, nearest = batch.column("floor").to_numpy(), batch.column("unit").to_numpy()
            for start in range(0, len(length), CHUNK):
                part = slice(start, start + CHUNK)
                angle = _angle(direction[part] @ own_centres.T)
                least = np.maximum(0.0, np.maximum(angle - high, low - angle) - ANGLE)
                cosine = np.cos(np.minimum(least, np.pi))
                most = length[part, None] * np.where(cosine > 0, cosine * long, cosine * short)
                can = most + SINGLE * np.maximum(1.0, length[part, None] * long) >= floor[part, None]
                at, units = np.nonzero(can[:, unit_cell])
                other = units != nearest[part][at]
                at, units = at[other] + start, units[other]
                for begin in range(0, len(at), 5000):
                    rows = batch.select(["target_id", "vector", "floor", *fold]).take(pa.array(at[begin:begin + 5000]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(units[begin:begin + 5000], pa.int32())], names=[*rows.schema.names, "unit"])

    visit_schema = f"target_id {target_type}, vector {vector_type}, floor double" + (f", fold {fold_type}" if fold else "") + ", unit int"
    sent = seen.select("target_id", "vector", "floor", "unit", *fold).mapInArrow(visits, visit_schema)
    sent = sent.withColumn("cut", F.floor(uniform("cut", F.col("target_id")) * cuts).cast("int"))
    copied = items.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))

    def compare(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("target_id").slice(0, 0), right.column("item_id").slice(0, 0), pa.array([], pa.float64())], names=["target_id", "item_id", "similarity"])
        at, which, value = hits(_best(left, right, k, bool(fold), left.column("floor").to_numpy()), right.column("item_id"))
        return pa.table([left.column("target_id").take(pa.array(at)), right.column("item_id").take(pa.array(which)), pa.array(value)], names=["target_id", "item_id", "similarity"])

    hit_schema = f"target_id {target_type}, item_id {item_type}, similarity double"
    copied = copied.withColumnsRenamed({"unit": "own", "cut": "item_cut"})
    more = sent.groupBy("unit", "cut").cogroup(copied.groupBy("own", "item_cut")).applyInArrow(lambda key, a, b: compare(a, b), hit_schema)
    first = seen.select("target_id", F.inline(F.arrays_zip(F.col("items").alias("item_id"), F.col("similarities").alias("similarity"))))
    more.unionByName(first).write.parquet(f"{path}/hits")
    return topk(spark.read.schema(hit_schema).parquet(f"{path}/hits"), k)
