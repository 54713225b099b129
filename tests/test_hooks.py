"""Vectors by content, and the built-in embedding."""

import numpy as np
from pyspark.sql import functions as F

from ratemill.operators import hooks as H


def test_only_edited_texts_are_embedded_again(spark, tmp_path):
    def embed(df):
        return df.withColumn("vector", F.array(F.length(F.coalesce("text", F.lit(""))).cast("float")))

    def made():
        rows = spark.read.parquet(str(tmp_path / "tag=t" / "manifest")).groupBy("embed_model").agg(F.sum("vectors").alias("n")).collect()
        return {r["embed_model"]: r["n"] for r in rows}

    def vectors(rows, model="m"):
        df = spark.createDataFrame(rows, "k int, text string")
        out = H.cache_vectors(df, str(tmp_path), "t", model, embed)
        assert out.columns == ["k", "text", "vector"]
        return sorted((r["k"], r["vector"][0]) for r in out.collect())

    rows = [(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")]
    want = [(1, 1.0), (2, 2.0), (3, 2.0), (4, 0.0), (5, 0.0)]
    assert vectors(rows) == want and made() == {"m": 3}
    assert vectors(rows) == want and made() == {"m": 3}
    # As many rows, one of them edited.
    assert vectors([(1, "aaaa"), *rows[1:]]) == [(1, 4.0), *want[1:]] and made() == {"m": 4}
    assert vectors(rows, "other") == want and made() == {"m": 4, "other": 3}
    # A batch that no manifest names is not read.
    spark.createDataFrame([("x", [9.0])], "_digest string, vector array<float>").write.parquet(str(tmp_path / "tag=t" / "batch=broken"))
    assert vectors(rows) == want
    assert vectors([]) == []


def test_words_of_like_contexts_have_like_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = [[f"{g}{i}" for i in range(12)] for g in "xyz"]
    texts = [(i, " ".join(rng.choice(groups[i % 3], 6))) for i in range(150)] + [(900, None), (901, "unknown words"), (902, "x1 x2"), (903, "X3, x4!")]
    df = spark.createDataFrame(texts, "k int, text string")
    found = []
    for parts, kept in ((1, 50_000), (7, 10)):
        monkeypatch.setattr(H, "KEPT_WORDS", kept)
        embed = H.word_vectors(df.repartition(parts), size=32)
        assert embed(df).columns == ["k", "text", "vector"]
        found.append({r["k"]: r["vector"] for r in embed(df).collect()})
    assert found[0] == found[1]
    v = {k: np.array(x) for k, x in found[0].items()}
    assert not v[900].any() and not v[901].any() and abs(np.linalg.norm(v[902]) - 1) < 1e-6
    assert v[902] @ v[903] > 0.8 > 0.5 > v[902] @ v[1]
