"""Recall of the index with its defaults on vectors without any structure, and of quantised rows."""

import numpy as np

from kelpline.functions.vectors import quantise
from kelpline.operators.ann import VectorIndex


def test_recall_of_defaults(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(1500, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = sum(len({r.id for r in index.search(x[k].tolist(), 10).collect()} & set(np.argsort(-(u @ u[k]))[:10].tolist())) for k in range(0, 1500, 250))
    assert hit / 60 >= 0.9
    index.insert(spark.createDataFrame([(9000, (-x[0]).tolist())], "id bigint, embedding array<double>"))
    assert VectorIndex.load(spark, str(tmp_path)).search((-x[0]).tolist(), 1).first().id == 9000


def test_quantised_rows_are_found(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(60, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, embedding array<double>").withColumn("q", quantise("embedding"))
    df = df.selectExpr("id", "if(id = 7, null, embedding) AS embedding", "q.*")
    df = df.toDF("id", "embedding", "embedding_quantized", "embedding_min", "embedding_scale")
    index = VectorIndex.build(df, str(tmp_path))
    assert index.rows == 60 and index.search(x[7].tolist(), 1).first().id == 7
