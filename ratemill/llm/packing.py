"""Documents packed into token sequences: large items matched, small ones best-fit.

Only the number of pieces of each length decides a packing, so it is planned on
the histogram of lengths, which has at most ``capacity`` rows at any size of the
input. The plan gives runs of equal pieces to runs of equal sequences; pieces then
find their place by their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratemill.llm.tokens import SLICE, encoder, slices

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


@dataclass(frozen=True)
class Run:
    """Pieces ``first`` to ``first + count - 1`` of one length fill sequences from ``sequence`` on, ``each`` in one, from ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int
    each: int


class _Bins:
    """Open sequences as runs (first sequence, number) by free space."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.used: dict[int, int] = {}
        self.runs: list[Run] = []

    def put(self, length: int, count: int, sequence: int, gap: int, each: int) -> None:
        """Place pieces into sequences with ``gap`` free, ``each`` in one; a last one may get fewer."""
        offset, full = self.capacity - gap, count // each
        first = self.used.get(length, 0)
        self.used[length] = first + count
        if full:
            self.runs.append(Run(length, first, full * each, sequence, offset, each))
            self.free[gap - each * length].append((sequence, full))
        if rest := count - full * each:
            self.runs.append(Run(length, first + full * each, rest, sequence + full, offset, rest))
            self.free[gap - rest * length].append((sequence + full, 1))

    def open(self, length: int, count: int, each: int = 1) -> None:
        bins = -(-count // each)
        self.put(length, count, self.made, self.capacity, each)
        self.made += bins

    def fill(self, length: int, count: int, gap: int) -> int:
        """Place into sequences with ``gap`` free; gives the number placed."""
        placed = 0
        while placed < count and self.free[gap]:
            sequence, bins = self.free[gap].pop()
            each = gap // length
            need = min(bins, -(-(count - placed) // each))
            if need < bins:
                self.free[gap].append((sequence + need, bins - need))
            now = min(count - placed, need * each)
            self.put(length, now, sequence, gap, each)
            placed += now
        return placed


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place all pieces.

    Pieces over a third of the capacity stand at most two in a sequence: from the
    longest down, each over one half takes the longest partner between a third and
    one half that fits, and what is left of these pairs up. All others go, from the
    longest down, where the least space is left that holds them. The runs are
    bounded by the capacity, not by the pieces.
    """
    bins, left = _Bins(capacity), dict(histogram)
    big = sorted((n for n in left if 2 * n > capacity), reverse=True)
    middle = sorted((n for n in left if 3 * n > capacity >= 2 * n), reverse=True)
    for length in big:
        bins.open(length, left[length])
        todo = left.pop(length)
        for partner in middle:
            if todo and left[partner] and partner <= capacity - length:
                placed = bins.fill(partner, min(todo, left[partner]), capacity - length)
                left[partner] -= placed
                todo -= placed
    for i, length in enumerate(middle):
        pairs, odd = divmod(left[length], 2)
        if pairs:
            bins.open(length, 2 * pairs, each=2)
        left[length] = 0
        if odd:
            bins.open(length, 1)
            partner = next((n for n in middle[i + 1:] if left[n]), None)
            if partner:
                bins.fill(partner, 1, capacity - length)
                left[partner] -= 1
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[length]
        for gap in range(length, capacity):
            if not todo:
                break
            if bins.free[gap]:
                todo -= bins.fill(length, todo, gap)
        if todo:
            bins.open(length, todo, each=capacity // length)
    return bins.runs


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, capacity if s >= first else first) for s in starts]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, remember: int | None = None) -> DataFrame:
    """Every document's ids and ``end_id`` in pieces, numbered by length inside each task."""
    import pyarrow as pa

    def cut_all(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for (doc_ids,), texts in slices(batches, ["doc_id"], most=SLICE if remember is None else min(SLICE, 5 * remember)):
            rows = []
            for doc_id, ids in zip(doc_ids, encoder(tokenizer, remember).encode(texts)):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start: 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(own), part, int(seen[length]), own))
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number", "ids"]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            keep = len(names) if with_ids else len(names) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], types)], names=names[:keep])

    return docs.select("doc_id", "text").mapInArrow(cut_all, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, scratch: str, capacity: int = 2048, with_ids: bool = False,
                   remember: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece; ``ids`` on demand.

    Pieces are written to ``scratch``, in the shared folder, so that their numbers
    stay as they are when an executor is lost. Null texts are empty and take one
    token, the end; repeated rows are packed as often as they come; other columns are
    not read; an empty table gives an empty result. The driver sees the histogram
    only; tasks get the plan, whose size is bounded by ``capacity``. With ``remember``
    a worker holds the ids of so many parts of texts, and five characters for each at once: less memory, more time.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    pieces(docs, tokenizer, end_id, capacity, with_ids, remember).write.mode("overwrite").parquet(scratch)
    cuts = spark.read.schema(PIECE_SCHEMA + (", ids binary" if with_ids else "")).parquet(scratch)
    counts = cuts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity), key=lambda r: (r.length, r.first))
    lengths, firsts, sequences, offsets, each = (np.array([getattr(r, k) for r in runs], np.int64) for k in ("length", "first", "sequence", "offset", "each"))
    keys = (lengths << 48) | firsts

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            inside = rank - firsts[at]
            own = {"sequence_id": sequences[at] + inside // each[at], "offset": offsets[at] + inside % each[at] * length}
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(v) for v in own.values()], names=kept + list(own))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cuts.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("number"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*own, "rank").mapInArrow(place, schema)
