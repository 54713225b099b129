"""Places where a user's own model comes in. Spark hands over batches; the model
is loaded once per task."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.functions.values import l2_normalize
from ratemill.session import scratch_path


def score_with(df: DataFrame, load: Callable, column: str = "content", out: str = "response") -> DataFrame:
    """Adds ``out`` = model(list of texts). ``load()`` returns the model."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator):
        model = load()
        for pdf in batches:
            yield pdf.assign(**{out: list(model(pdf[column].tolist()))})

    return df.mapInPandas(run, schema)


def rescore_with(df: DataFrame, load: Callable, query: str = "query", passage: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` = model(list of queries, list of passages)."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, passages in batches:
            yield pd.Series(model(queries.tolist(), passages.tolist()), dtype="float64")

    return df.withColumn(out, run(F.col(query), F.col(passage)))


def embed_with(df: DataFrame, load: Callable, column: str = "text", out: str = "vector", normalize: bool = True,
               pooling: str = "mean", batch: int = 32) -> DataFrame:
    """Adds ``out``, a float vector. The model maps a list of texts to one array
    of token vectors per text (pooled by "mean" or "first") or to one vector per text."""
    if pooling not in ("mean", "first"):
        raise ValueError("pooling is 'mean' or 'first'")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = load()
        for texts in batches:
            filled, vectors = texts.fillna("").tolist(), []
            for start in range(0, len(filled), batch):
                for raw in model(filled[start : start + batch]):
                    raw = np.asarray(raw, dtype=np.float32)
                    if raw.ndim == 2:
                        raw = raw.mean(axis=0) if pooling == "mean" else raw[0]
                    if normalize:
                        raw = raw / max(float(np.linalg.norm(raw)), 1e-12)
                    vectors.append(raw.astype(np.float32))
            yield pd.Series(vectors, index=texts.index)

    return df.withColumn(out, run(F.col(column)))


#: Words that a task adds up before it hands them on, and the unit of a stored word vector.
KEPT_WORDS, UNIT = 50_000, 1 << 20
#: Words of texts in a block, repeats between texts included, and different ones; the text that passes either is the last one.
BLOCK_WORDS, BLOCK_DISTINCT = 1_000_000, 100_000
WORD_BLOCK = "block long, texts array<string>, starts array<int>, columns array<int>, words array<string>"


def _distinct_words(column: str):
    words = F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.array_remove(words, ""))


def _signs(word: str, size: int, seed: int):
    """Index vector of a word: +1 and -1 by the bits of its digest."""
    import hashlib

    import numpy as np

    bits = b"".join(hashlib.md5(f"{seed}|{k}|{word}".encode()).digest() for k in range(-(-size // 128)))
    return np.unpackbits(np.frombuffer(bits, np.uint8))[:size].astype(np.int64) * 2 - 1


def word_blocks(texts: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of ``_text, _words`` with each word once: ``columns`` are places in ``words``, those of a text begin at its ``starts``.

    A block ends with the text that brings it to ``most`` words or to BLOCK_DISTINCT different ones.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def rows(batches: Iterator):
        number = TaskContext.get().partitionId() << 32
        names, starts, columns, place = [], [0], array("i"), {}

        def block():
            values = [[number], [names], [starts], [columns], [list(place)]]
            types = [pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 2, pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[c.split()[0] for c in WORD_BLOCK.split(", ")])

        for batch in batches:
            for text, words in zip(batch.column("_text"), batch.column("_words")):
                names.append(text.as_py())
                columns.extend(place.setdefault(w, len(place)) for w in words.as_py())
                starts.append(len(columns))
                if len(columns) >= most or len(place) >= BLOCK_DISTINCT:
                    yield block()
                    number, names, starts, columns, place = number + 1, [], [0], array("i"), {}
        if names:
            yield block()

    return texts.select("_text", "_words").mapInArrow(rows, WORD_BLOCK)


def block_sums(blocks: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """``_text, _sums``: the sum of the ``units`` of its words that ``table`` has.

    A block asks for each of its words once, however many of its texts have it, and adds up itself. So what is
    shuffled does not depend on how the words of a text lie over partitions.
    """
    import pyarrow as pa

    def summed(key, texts, found):
        import numpy as np

        starts, columns = (texts.column(c)[0].values.to_numpy() for c in ("starts", "columns"))
        units = np.zeros((int(columns.max()) + 1, size), np.int64)
        units[found.column("place").to_numpy()] = found.column("units").combine_chunks().flatten().to_numpy().reshape(-1, size)
        sums = np.concatenate([units[columns[a:b]].sum(axis=0) for a, b in zip(starts[:-1], starts[1:])])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts), dtype=np.int32) * size), pa.array(sums))
        return pa.table([texts.column("texts")[0].values, lists], names=["_text", "_sums"])

    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("words").alias("place", "word"))
    found = asked.join(table, "word").select("asker", "place", "units")
    return blocks.drop("words").groupBy("block").cogroup(found.groupBy("asker")).applyInArrow(summed, "_text string, _sums array<long>")


def word_vectors(train: DataFrame, column: str = "text", size: int = 64, min_count: int = 2, seed: int = 7):
    """Built-in default embedding by random indexing; a function from DataFrame to DataFrame.

    Every word has a fixed vector of random signs. A word's vector is the sum, over the texts
    that have it, of the sign vectors of their other words; words of fewer than
    ``min_count`` texts are left out. Tasks sum what they read, Spark adds the sums up, and
    the table of words stays on the cluster, written to scratch (runs a job). A text is the mean of
    its words' unit vectors, brought to unit length; without known words it is zero. Texts to embed are written
    to scratch in blocks, which runs a job each time. Sums are whole numbers,
    so any partitioning gives the same vectors.
    """
    import pyarrow as pa

    spark, path = train.sparkSession, scratch_path(train.sparkSession, "words")

    def sums(batches: Iterator):
        import numpy as np

        place: dict[str, int] = {}
        signs, totals, counts = np.zeros((1024, size), np.int64), np.zeros((1024, size), np.int64), np.zeros(1024, np.int64)

        def handed_on():
            n = len(place)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(totals[:n].reshape(-1)))
            return pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), pa.array(counts[:n]), lists], names=["word", "n", "sums"])

        for batch in batches:
            for words in batch.column("words").to_pylist():
                if not words:
                    continue
                for word in words:
                    if word not in place:
                        if len(place) == len(signs):
                            signs, totals, counts = (np.concatenate([t, np.zeros_like(t)]) for t in (signs, totals, counts))
                        place[word] = len(place)
                        signs[place[word]] = _signs(word, size, seed)
                own = np.array([place[w] for w in words])
                totals[own] += signs[own].sum(axis=0) - signs[own]
                counts[own] += 1
                if len(place) >= KEPT_WORDS:
                    yield handed_on()
                    place.clear()
                    totals[:], counts[:] = 0, 0
        if place:
            yield handed_on()

    parts = train.select(_distinct_words(column).alias("words")).mapInArrow(sums, "word string, n long, sums array<long>")
    added = parts.groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(size))).filter(F.col("n") >= min_count)
    whole = F.array(*(F.col(f"s{j}").cast("double") for j in range(size)))
    scaled = F.transform(l2_normalize(whole), lambda v: F.round(v * float(UNIT)).cast("long"))
    added.select("word", scaled.alias("units")).write.parquet(path)

    def embed(df: DataFrame, out: str = "vector") -> DataFrame:
        keyed = df.withColumn("_digest", F.sha2(F.coalesce(F.col(column), F.lit("")), 256))
        texts = keyed.select(F.col("_digest").alias("_text"), _distinct_words(column).alias("_words")).filter(F.size("_words") > 0).dropDuplicates(["_text"])
        blocks = scratch_path(spark, "word-blocks")
        word_blocks(texts).write.parquet(blocks)
        summed = block_sums(spark.read.schema(WORD_BLOCK).parquet(blocks), spark.read.parquet(path), size)
        vector = l2_normalize(F.transform("_sums", lambda s: s.cast("double"))).cast("array<float>")
        joined = keyed.join(summed.select("_text", vector.alias("_vector")), F.col("_digest") == F.col("_text"), "left")
        return joined.withColumn(out, F.coalesce("_vector", F.array_repeat(F.lit(0.0).cast("float"), size))).drop("_digest", "_text", "_vector")

    return embed


MANIFEST_SCHEMA = "batch string, embed_model string, vectors long"


def _table(spark, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cache_vectors(df: DataFrame, path: str, tag: str, model: str, embed: Callable[[DataFrame], DataFrame],
                  columns: Sequence[str] | None = None, column: str = "text", out: str = "vector") -> DataFrame:
    """``df`` with its vectors, from the table at ``path/tag=<tag>`` as far as it has them.

    Vectors are stored by the digest of their text and by model. Only texts that the model has no
    vector for are embedded, once each, by ``embed`` (which adds ``out`` to the rows it is given), and
    appended as a batch; a batch counts once the manifest names it, so what a
    broken run left is not read. Runs jobs: the batches named (few rows), the count of missing texts
    and the new batch.
    """
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/tag={tag}"
    keyed = df.withColumn("_digest", F.sha2(F.coalesce(F.col(column), F.lit("")), 256))

    def stored() -> DataFrame | None:
        named = _table(spark, f"{folder}/manifest", MANIFEST_SCHEMA).filter(F.col("embed_model") == model)
        batches = sorted({r["batch"] for r in named.select("batch").collect()})
        if not batches:
            return None
        # Two runs at once may have made a vector each: they are the same.
        return spark.read.parquet(*(f"{folder}/batch={b}" for b in batches)).dropDuplicates(["_digest"])

    known = stored()
    once = keyed.dropDuplicates(["_digest"])
    missing = once if known is None else once.join(known.select("_digest"), "_digest", "left_anti")
    count = missing.count()
    if count or known is None:
        batch = uuid.uuid4().hex
        embed(missing).select("_digest", out).write.parquet(f"{folder}/batch={batch}")
        spark.createDataFrame([(batch, model, count)], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
        known = stored()
    joined = keyed.join(known.withColumnsRenamed({"_digest": "_text", out: "_vector"}), F.col("_digest") == F.col("_text"), "left")
    result = joined.withColumn(out, F.col("_vector")).drop("_digest", "_text", "_vector")
    return result.select(*columns) if columns else result
