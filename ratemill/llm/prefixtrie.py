"""Prefix trie of conversations by truncation peeling.

A conversation is a path of turns, RECORD bytes each: a digest of role and text, then the
number of words of the text. Peeling starts at the greatest depth: conversations that
end there meet the nodes that survived from below, equal paths become one node, its
counts are summed up, the last turn is stripped, and what is left meets again one level up. So
nodes are found and counted in the same pass.

A level is regrouped by Spark, with sums made before the shuffle, so a first turn that a
third of all conversations share is one row per task. Runs of levels that few turns
reach (a single very long conversation, say) are peeled together in one task, up to
``stretch`` turns, known from the histogram of lengths; both ways give the same nodes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a turn in a path: of the digest, and of the digest with the number of words.
DIGEST, RECORD = 16, 20
#: Ids of a node's ended conversations that are joined to one piece of text.
PIECE = 1 << 14
#: Turns that may be peeled in one task.
STRETCH = 20_000

ENDED_SCHEMA = "path binary, conv_id long, n_convs long, ends string"
NODE_SCHEMA = "path binary, key binary, parent_key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path`` of every conversation of ``conv_id, turn, role, text``.

    Turns follow each other by ``turn`` (null first), equal ones by role and a digest of
    the text; null role or text is empty. Rows without ``conv_id`` are one conversation. A task holds the
    records of one conversation, not its texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit("[^ \\t-\\r]+"))
    record = F.concat(F.substring(F.unhex(F.sha2(content, 256)), 1, DIGEST), F.unhex(F.lpad(F.hex(words), 2 * (RECORD - DIGEST), "0")))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.xxhash64(text).alias("tie"), record.alias("record"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "tie", "record")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["record"])), "")).alias("path"))


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation ``c`` with its first h turns taken from conversation ``c - c % group``.

    h is the crc32 of the decimal id modulo ``most``. All turns of a shorter head are taken, none
    where it is absent. The head's side of the join has one row for each conversation
    and at most ``most - 1`` records in it.
    """
    heads = own.select(F.col("conv_id").alias("head_id"), F.substring("path", 1, RECORD * (most - 1)).alias("head"))
    h = (F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % most).cast("int")
    joined = own.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head_id", "left")
    first = F.substr(F.coalesce("head", F.lit(b"")), F.lit(1), h * RECORD)
    return joined.select("conv_id", F.concat(first, F.substr("path", h * RECORD + 1, F.lit(2**31 - 1))).alias("path"))


def ended(conversations: DataFrame, scratch: str, piece: int = PIECE) -> DataFrame:
    """Distinct conversations: ``path``, least ``conv_id``, ``n_convs``, and the digest ``ends`` of their ids.

    Ids are sorted by range of (path, id), so copies of one conversation go to many
    tasks; each joins its ids to pieces of text, and a digest, which has to be taken in order,
    reads those pieces one by one.
    """
    import pyarrow as pa

    def written(rows: Iterator):
        types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        while part := list(itertools.islice(rows, 500)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=["path", "conv_id", "n_convs", "ends"])

    def pieces(batches: Iterator):
        path, ids = None, []

        def row():
            known = [i for i in ids if i is not None]
            return path, known[0] if known else None, len(ids), ",".join(map(str, known))

        for batch in batches:
            for own, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (own != path or len(ids) >= piece):
                    yield row()
                    ids = []
                path = own
                ids.append(conv)
        if ids:
            yield row()

    def digests(batches: Iterator):
        path, least, n, digest = None, None, 0, None
        for batch in batches:
            for own, conv, count, text in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "n_convs", "ends"))):
                if own != path:
                    if digest is not None:
                        yield path, least, n, digest.hexdigest()
                    path, least, n, digest = own, None, 0, hashlib.sha256()
                n += count
                if conv is not None:
                    digest.update(text.encode() if least is None else b"," + text.encode())
                    least = conv if least is None else least
        if digest is not None:
            yield path, least, n, digest.hexdigest()

    spark = conversations.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = conversations.select("path", "conv_id").repartitionByRange(count, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ordered.mapInArrow(lambda b: written(pieces(b)), ENDED_SCHEMA).write.mode("overwrite").parquet(f"{scratch}/pieces")
    dealt = spark.read.parquet(f"{scratch}/pieces").repartition(count, "path").sortWithinPartitions("path", "conv_id")
    dealt.mapInArrow(lambda b: written(digests(b)), ENDED_SCHEMA).write.mode("overwrite").parquet(f"{scratch}/ended")
    return spark.read.parquet(f"{scratch}/ended")


def _key(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:DIGEST]


def _peel(rows: list[dict], low: int) -> list[dict]:
    """Nodes of all depths from the greatest down to ``low``. Rows are contributions to the node of their path."""
    levels: dict[int, dict[bytes, dict]] = {}

    def add(path: bytes, row: dict) -> None:
        node = levels.setdefault(len(path) // RECORD, {}).setdefault(path, {"path": path, "conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends": None})
        ids = [i for i in (node["conv_id"], row["conv_id"]) if i is not None]
        node["conv_id"], node["ends"] = min(ids, default=None), node["ends"] or row["ends"]
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            node[c] += row[c]

    for row in rows:
        add(row["path"], row)
    out = []
    for depth in range(max(levels, default=-1), low - 1, -1):
        for path, node in levels.pop(depth, {}).items():
            node["depth"], node["n_leaves"] = depth, node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * int.from_bytes(path[len(path) - RECORD + DIGEST:], "big") if depth else 0
            node["key"], node["parent_key"] = _key(path), _key(path[:-RECORD]) if depth else None
            out.append(node if depth == low else node | {"path": None})
            if depth > low:
                add(path[:-RECORD], node | {"n_children": 1, "ends": None})
    return out


def peeled_here(rows: DataFrame, low: int) -> DataFrame:
    """Nodes of the levels down to ``low`` from one task; the caller knows that few rows come."""
    import pyarrow as pa

    types = {"path": pa.binary(), "key": pa.binary(), "parent_key": pa.binary(), "ends": pa.string()}

    def peel(batches: Iterator):
        nodes = _peel([row for batch in batches for row in batch.to_pylist()], low)
        for at in range(0, len(nodes), 1000):
            part = nodes[at:at + 1000]
            names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([node[c] for node in part], types.get(c, pa.int64())) for c in names], names=names)

    return rows.repartition(1).mapInArrow(peel, NODE_SCHEMA)


def peeled_by_groups(rows: DataFrame, depth: int) -> DataFrame:
    """Nodes of one level, regrouped by path."""
    met = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"))

    def key(path):
        return F.substring(F.unhex(F.sha2(path, 256)), 1, DIGEST)

    words = F.conv(F.hex(F.substring("path", RECORD * (depth - 1) + DIGEST + 1, RECORD - DIGEST)), 16, 10).cast("long") if depth else F.lit(0)
    parent = key(F.substring("path", 1, RECORD * (depth - 1))) if depth else F.lit(None).cast("binary")
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * words
    return met.select("path", key(F.col("path")).alias("key"), parent.alias("parent_key"), F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"), "ends")


def steps(lengths: dict[int, int], stretch: int) -> list[tuple[int, int, bool]]:
    """Runs of levels from the greatest depth to 0: (greatest, least, all in one task).

    ``lengths`` says how many distinct conversations have each length. A run in one task
    starts with at most ``stretch`` turns, those of survivors from below included.
    """
    out, high, alive = [], max(lengths, default=0), 0
    while high >= 0:
        entering, low = alive, high + 1
        while low > 0 and (entering + lengths.get(low - 1, 0)) * max(high, 1) <= stretch:
            low -= 1
            entering += lengths.get(low, 0)
        if low > high:
            low, entering = high, alive + lengths.get(high, 0)
            out.append((high, low, False))
        else:
            out.append((high, low, True))
        alive, high = entering, low - 1
    return out


def prefix_trie(conversations: DataFrame, scratch: str, stretch: int = STRETCH, piece: int = PIECE) -> DataFrame:
    """Nodes of the trie of ``conv_id, path``: one row for each distinct sequence of first turns.

    ``key, parent_key`` (digests of paths), ``depth``, ``conv_id`` (least member), ``parent_conv_id``
    (null at the root), ``n_convs`` members, ``n_children``, ``n_leaves`` (childless nodes below or
    itself), ``saved_tokens`` (over the subtree, members but one times words of the last text) and ``ends``
    (SHA-256 of the ids that end here, ascending, joined by commas). A conversation without turns
    belongs to the root. One without id counts as a member and has no id in ``ends``; a node of
    only such has a null ``conv_id``. An empty table has no node. Repeated rows are repeated turns.
    Other columns are not read. The driver gets the histogram of lengths; every level is written to ``scratch``.
    """
    spark = conversations.sparkSession
    done = ended(conversations, scratch, piece)
    length = (F.octet_length("path") / RECORD).cast("int")
    lengths = {r["n"]: r["count"] for r in done.groupBy(length.alias("n")).count().collect()}
    starts = done.select("path", "conv_id", "n_convs", *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), "ends")
    written, survivors, before = [], None, 0
    for k, (high, low, here) in enumerate(steps(lengths, stretch) if lengths else []):
        rows = starts.filter((length <= high) & (length >= low))
        if survivors is not None:
            stripped = F.substring("path", 1, RECORD * (before - 1))
            rows = rows.unionByName(survivors.select(stripped.alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends")))
        nodes = peeled_here(rows, low) if here else peeled_by_groups(rows, low)
        nodes.write.mode("overwrite").parquet(f"{scratch}/nodes/step={k}")
        written.append(f"{scratch}/nodes/step={k}")
        before, survivors = low, spark.read.schema(NODE_SCHEMA).parquet(written[-1]).filter(F.col("depth") == low)
    nodes = (spark.read.schema(NODE_SCHEMA).parquet(*written) if written else spark.createDataFrame([], NODE_SCHEMA)).drop("path")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(parents, "parent_key", "left").withColumn("ends", F.coalesce("ends", F.lit(none)))
