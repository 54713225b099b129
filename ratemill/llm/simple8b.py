"""Token ids in files of Simple-8b words, and back.

A word has a selector in its upper 4 bits; the other 60 hold as many ids as the
selector says, the first id lowest. Selector 0 is an escape: the next word is one
id of more than 60 bits. The last word of a block is filled with zeros; the block
knows its number of ids.

A file row is one block of whole documents: ``shard``, ``first`` (ids of the shard
before the block), ``n_ids``, ``doc_ids``, ``starts`` (each document's first id
in the block) and ``words``. Shards follow each other in ascending ``doc_id``.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratemill.llm.tokens import encoder, slices

#: Fixed values of the coding: (bits of an id, ids in a word) of the selectors 1 to 14.
SELECTORS = [(1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1)]
ESCAPE = 0
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16

BLOCK_SCHEMA = "shard int, first long, n_ids long, doc_ids array<long>, starts array<int>, words binary"
IDS_SCHEMA = "doc_id long, shard int, start long, n_tokens long, ids binary"


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of the ids (unsigned 64-bit). Each word takes as many ids as fit."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    wide = bool(ids.max() >> np.uint64(52))
    bits = (np.searchsorted(np.uint64(1) << np.arange(61, dtype=np.uint64), ids, side="right") if wide else np.frexp(ids.astype(np.float64))[1]).astype(np.uint8)
    narrow = np.cumsum(np.bincount(bits, minlength=65))
    selector, taken = np.zeros(n, np.uint8), np.ones(n, np.uint8)
    for s, (width, count) in reversed(list(enumerate(SELECTORS, 1))):
        if narrow[width] < count < n and bits[-1] > width:
            continue
        # Runs of ids that are not wider; behind the last id nothing is too wide, as the last word is filled up.
        edge = np.concatenate([[-1], np.flatnonzero(bits > width), [n + 61]])
        runs = np.diff(edge) - count
        long = np.flatnonzero(runs > 0)
        start = edge[long] + 1
        change = np.zeros(n + 1, np.int8)
        change[start[start < n]] = 1
        change[np.minimum(start + runs[long], n)[start < n]] -= 1
        fits = np.cumsum(change[:n], dtype=np.int8).view(bool)
        np.copyto(selector, s, where=fits)
        np.copyto(taken, count, where=fits)
    step, at, starts = taken.tobytes(), 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    begin = np.array(starts)
    chosen = selector[begin]
    place = np.concatenate([[0], np.cumsum(np.where(chosen == ESCAPE, 2, 1))])
    words = np.zeros(place[-1], np.uint64)
    filled = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s, (width, count) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            at, own = begin[mine], np.full(len(mine), np.uint64(s) << np.uint64(60))
            for k in range(count):
                own |= filled[at + k] << np.uint64(k * width)
            words[place[mine]] = own
    mine = np.flatnonzero(chosen == ESCAPE)
    words[place[mine] + 1] = ids[begin[mine]]
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of the words."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    heads = np.arange(len(words))
    if (chosen == ESCAPE).any():
        # The word behind an escape is data, whatever its upper bits are.
        keep, at, picked = chosen.tolist(), 0, []
        while at < len(keep):
            picked.append(at)
            at += 2 if keep[at] == ESCAPE else 1
        heads = np.array(picked)
    chosen = chosen[heads]
    counts = np.array([1] + [c for _, c in SELECTORS])[chosen]
    place = np.concatenate([[0], np.cumsum(counts)])
    ids = np.zeros(place[-1], np.uint64)
    for s, (width, count) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            values = words[heads[mine]][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))
            ids[place[mine][:, None] + np.arange(count)] = values & np.uint64((1 << width) - 1)
    mine = np.flatnonzero(chosen == ESCAPE)
    ids[place[mine]] = words[heads[mine] + 1]
    return ids[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Encode every text, add ``end_id``, write blocks in ascending ``doc_id``.

    A null text counts as empty. Rows without ``doc_id`` come first; rows with the
    same ``doc_id`` follow each other by text. Other columns are not read. An empty
    table gives an empty file. One shuffle by range of ``doc_id``; a task holds one
    block, or one document if that is longer.
    """
    import pyarrow as pa

    def blocks(batches):
        shard, first = TaskContext.get().partitionId(), 0
        ids_of, names, parts, held = encoder(tokenizer).encode, [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def block():
            lengths = [len(p) // 4 for p in parts]
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            columns = ([shard], [first], [len(ids)], [names], [starts.tolist()], [pack(ids).astype("<u8").tobytes()])
            types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "first", "n_ids", "doc_ids", "starts", "words"])

        for (doc_ids,), texts in slices(batches, ["doc_id"]):
            for doc_id, ids in zip(doc_ids, ids_of(texts)):
                names.append(doc_id)
                parts.append(ids + end)
                held += len(parts[-1]) // 4
                if held >= BLOCK_IDS:
                    yield block()
                    first += held
                    names, parts, held = [], [], 0
        if parts:
            yield block()

    count = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids`` (bytes of unsigned 32-bit ids).

    ``start`` counts the ids of all documents before. It adds the position in the
    shard to the shard's own start, which comes from one row per shard; that table
    is as long as the writer had tasks, and is broadcast.
    """
    import pyarrow as pa

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), row["n_ids"]).astype("<u4")
                starts = np.array(row["starts"], np.int64)
                ends = np.append(starts[1:], row["n_ids"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(starts), pa.int32()), pa.array(starts + row["first"], pa.int64()),
                    pa.array(ends - starts, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ], names=["doc_id", "shard", "start", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    found = blocks.mapInArrow(documents, IDS_SCHEMA).join(F.broadcast(bases), "shard")
    return found.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
