"""The inverted file against exact search."""

import math

import numpy as np

from kelpline.operators.ann import VectorIndex


def test_recall_insert_and_reload(spark, tmp_path):
    rows = []
    for s in range(1000):
        v = np.array([math.sin(0.1 * s + 0.01 * i) for i in range(128)])
        rows.append((s, (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame([*rows, (5000, None), (5001, [1.0]), (5002, [0.0] * 128)], "id bigint, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path), cells=16)
    assert index.matches(df) and not index.matches(df.where("id > 3")) and index.rows == 1000
    x = np.array([v for _, v in rows])
    hit = 0
    for s in range(0, 1000, 250):
        want = np.sort(x @ x[s])[::-1][:10]
        got = VectorIndex.load(spark, str(tmp_path)).search(rows[s][1], 10).collect()
        hit += sum(r.similarity >= want[-1] - 1e-9 for r in got)
    assert hit / 40 > 0.8
    index.insert(spark.createDataFrame([(7000, rows[0][1])], "id bigint, embedding array<double>"))
    assert 7000 in {r.id for r in index.search(rows[0][1], 30).collect()}
    assert index.search(rows[0][1], 5, least=2.0).count() == 0
