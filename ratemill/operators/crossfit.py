"""Out-of-fold predictions with a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.session import scratch_path


def text_classifier(features: int = 4096, iterations: int = 10):
    """Tokenizer, hashed term counts, IDF and logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Tokenizer

    return Pipeline(stages=[
        Tokenizer(inputCol="text", outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="features"),
        LogisticRegression(maxIter=iterations, regParam=0.01, featuresCol="features", labelCol="label"),
    ])


def written(model, path: str):
    """The model as its files give it back, if its kind can be written.

    A fitted one keeps its training summary, and with it the session, which tasks would have to be sent
    and cannot be once it has seen an observation.
    """
    from pyspark.ml.util import MLWritable

    if not isinstance(model, MLWritable):
        return model
    model.write().save(path)
    return type(model).load(path)


def cross_fit(df: DataFrame, metrics: Sequence[str], folds: Sequence[int], estimator=None, prepare=None) -> DataFrame:
    """Every row predicted by the model that did not see its fold.

    ``df``: text, label, metric, fold. One model per (metric, fold), trained on
    Spark; ``prepare`` may change the training rows (oversampling). A fold whose
    training rows hold one class only gets that class; one without labelled training
    rows, and rows of no listed metric and fold, get null. The rows, the models and the predictions of
    every model go to scratch; runs jobs.
    """
    estimator = estimator or text_classifier()
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "cross-fit")
    df.write.parquet(f"{path}/rows")
    df = spark.read.schema(df.schema).parquet(f"{path}/rows")
    parts: list[DataFrame] = []

    def add(rows: DataFrame) -> None:
        """Predictions are written at once, so that what comes back is one scan without any model in its plan."""
        rows.select(*df.columns, F.col("prediction").cast("double").alias("prediction")).write.parquet(f"{path}/part={len(parts)}")
        parts.append(rows)

    for metric in metrics:
        rows = df.filter(F.col("metric") == metric)
        for fold in folds:
            train, held = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
            train = prepare(train) if prepare else train
            span = train.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
            if span["a"] is None or span["a"] == span["b"]:
                add(held.withColumn("prediction", F.lit(None if span["a"] is None else float(span["a"]))))
            else:
                model = estimator.fit(train.withColumn("label", F.col("label").cast("double")))
                add(written(model, f"{path}/model={len(parts)}").transform(held))
    # Rows of other metrics and folds, and those without either, have no model.
    asked = F.coalesce(F.col("metric").isin(list(metrics)) & F.col("fold").isin(list(folds)), F.lit(False))
    add(df.filter(~asked).withColumn("prediction", F.lit(None)))
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])).parquet(*(f"{path}/part={k}" for k in range(len(parts))))
