"""Benchmark items inside documents: size-partitioned MinHash containment, then exact shingles.

A MinHash function picks one shingle of an item, the one with the least digest; if the
share c of the item's shingles is in a document, the picked one is there with probability
c. Items are partitioned by their number of shingles. A partition asks for more hits the
larger its items are, and takes as many functions as keep the chance to miss an item with
the wanted containment below MISS. Documents are not sketched, so their length does not
matter: their shingles look up the picked ones. Candidates are then compared by whole shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[ \\t\\n\\x0B\\f\\r]+"
#: Chance to miss an item with exactly the wanted containment.
MISS = 1e-8
#: The picked shingles are broadcast up to so many rows (of 24 bytes); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def with_words(rows: DataFrame) -> DataFrame:
    """``words`` of ``text``: runs without ASCII white space, A to Z in lower case. Null text: none."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.withColumn("words", F.array_remove(F.split(lower, SPACES), ""))


def _shingles(width: int, of: str) -> Column:
    """``of`` each run of ``width`` words, or of all words where there are fewer; none without words."""
    one = of.format(", ".join(["w"] + [f"words[i + {k}]" for k in range(1, width)]))
    few = of.format("array_join(words, ' ')")
    return F.expr(f"case when size(words) = 0 then array() when size(words) < {width} then array({few}) else array_distinct(transform(slice(words, 1, greatest(size(words) - {width - 1}, 0)), (w, i) -> {one})) end")


def hits_needed(n: int) -> int:
    """Hits that the partition of items with ``n`` shingles asks for."""
    return 1 if n < 32 else 2 if n < 256 else 3


def functions_needed(hits: int, containment: float, miss: float = MISS) -> int:
    """Least number of functions of which fewer than ``hits`` hit with a chance of at most ``miss``."""
    m = hits
    while sum(math.comb(m, k) * containment**k * (1 - containment) ** (m - k) for k in range(hits)) > miss:
        m += 1
    return m


def picked_shingles(items: DataFrame, containment: float) -> DataFrame:
    """``item_id, shingle, weight, hits``: shingles that functions pick, and how many do. ``items`` has ``item_id, keys``."""
    n = F.size("keys")
    hits = F.when(n < 32, hits_needed(1)).when(n < 256, hits_needed(32)).otherwise(hits_needed(256))
    count = F.when(n < 32, functions_needed(hits_needed(1), containment)).when(n < 256, functions_needed(hits_needed(32), containment)).otherwise(functions_needed(hits_needed(256), containment))
    sized = items.filter(n > 0).select("item_id", "keys", hits.alias("hits"), count.alias("functions"))
    least = F.expr("transform(sequence(1, functions), f -> array_min(transform(keys, k -> struct(xxhash64(k, f) as digest, k as shingle))).shingle)")
    return sized.select("item_id", "hits", F.explode(least).alias("shingle")).groupBy("item_id", "hits", "shingle").agg(F.count(F.lit(1)).alias("weight"))


def contained_items(docs: DataFrame, benchmark: DataFrame, scratch: str, containment: float = 0.8, width: int = 5) -> DataFrame:
    """``doc_id, item_id, n_found, n_item, containment`` of every pair with at least this containment.

    Containment is the share of an item's distinct shingles of ``width`` words that the
    document has. Texts with fewer words are one shingle, so a short item is only found
    as a whole document. Texts without words (null, empty, blank) match nothing.
    Rows that share a ``doc_id`` (null counts as one) count as one document if
    either contains the item; repeated items are one if their id and text agree.
    Candidates are written to ``scratch``. Extra columns are not read.
    """
    spark = docs.sparkSession
    listed = with_words(benchmark.select("item_id", "text").distinct())
    items = listed.select("item_id", _shingles(width, "xxhash64({})").alias("keys"), _shingles(width, "concat_ws(' ', {})").alias("shingles"))
    items.write.mode("overwrite").parquet(f"{scratch}/items")
    items = spark.read.parquet(f"{scratch}/items")
    picked_shingles(items, containment).write.mode("overwrite").parquet(f"{scratch}/picked")
    picked = spark.read.parquet(f"{scratch}/picked")
    small = picked.count() <= BROADCAST_ROWS
    keys = with_words(docs.select("doc_id", "text")).select("doc_id", F.explode(_shingles(width, "xxhash64({})")).alias("shingle"))
    found = keys.join(F.broadcast(picked) if small else picked, "shingle")
    # Repeated rows of one doc_id may hit twice; that can only add a candidate.
    candidates = found.groupBy("doc_id", "item_id").agg(F.sum("weight").alias("got"), F.max("hits").alias("hits")).filter("got >= hits").select("doc_id", "item_id")
    candidates.write.mode("overwrite").parquet(f"{scratch}/candidates")
    wanted = spark.read.parquet(f"{scratch}/candidates").groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids")).withColumnRenamed("doc_id", "wanted_id")
    texts = with_words(docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))))
    pairs = texts.select("doc_id", _shingles(width, "concat_ws(' ', {})").alias("own"), F.explode("item_ids").alias("item_id"))
    compared = pairs.join(items.select("item_id", "shingles"), "item_id").select("doc_id", "item_id", F.size(F.array_intersect("own", "shingles")).alias("n_found"), F.size("shingles").alias("n_item"))
    near = compared.filter(F.col("n_found") >= F.lit(containment) * F.col("n_item"))
    return near.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_item")).alias("containment"), "n_found", "n_item")).alias("best")).select("doc_id", "item_id", "best.n_found", "best.n_item", "best.containment")
