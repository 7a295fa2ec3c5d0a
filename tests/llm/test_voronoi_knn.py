import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import voronoi_knn as V


def brute(rows, every, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = random.Random(2)
    rows = [(i, [rng.choice((-0.5, 0.25, rng.uniform(-1, 1))) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(120)]  # one very common vector
    rows += [(900, None), (905, [1.0, None]), (910, [float("nan"), 1.0]), (915, [float("inf"), 0.0]), (920, []), (925, [0.7]), (930, [0.1] * 6), (None, [1.0] * 4), (940, [900000.7, -3.0, 2.0, 1.0]), (945, [899999.3, 5.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).repartition(3)
    assert sorted(map(tuple, V.knn_join(df, F.col("vec_id") % 5 == 0).collect())) == brute(rows, 5)


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert V.knn_join(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert V.knn_join(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], schema)
    assert sorted(map(tuple, V.knn_join(two, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 1, 131072), (0, 2, 1, 131072)]
