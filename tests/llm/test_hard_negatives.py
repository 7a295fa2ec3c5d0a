import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives=5, negatives=10):
    good = [(i, [math.floor(256 * x) for x in v], (n + 1) % 10 if i % 7 == 0 else n) for i, v, n in rows if None not in (i, v, n) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, n in good:
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(v, w, strict=False)), i, m) for i, w, m in good if i != a]
        for r, (p, i, _) in enumerate(sorted(s for s in scores if s[2] == n)[:positives]):
            fits = sorted(s for s in scores if s[2] != n and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(a, i, r + 1, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(fits)]
    return sorted(out)


def mined(df, every):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % every == 0, label).collect()))


@pytest.mark.parametrize(("block", "wave", "tile"), [(8192, 16384, 128), (32, 20, 3)])
def test_against_brute_force(spark, monkeypatch, block, wave, tile):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "WAVE", wave)
    monkeypatch.setattr(H, "TILE", tile)
    rng = random.Random(8)
    rows = [(i, [rng.choice((0.5, 0.25, rng.uniform(-1, 1))) for _ in range(4)], 0 if i % 3 == 0 else rng.randrange(4)) for i in range(240)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(60)]  # one very common vector
    rows += [rows[0], rows[5], rows[5], rows[17]]  # repeated rows, anchors among them
    rows += [(905, None, 1), (910, [1.0, None], 1), (915, [float("nan"), 1.0], 1), (920, [float("inf")], 1), (925, [0.5] * 4, None), (None, [1.0] * 4, 1), (930, [], 1), (935, [0.7], 2), (940, [0.1] * 6, 2), (945, [-1.0] * 4, 9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as a", "'x' as t", "2 as v").repartition(3)
    found = mined(df, 5)
    assert found == brute(rows, 5) and len(found) > 1000


def test_large_components_stay_exact(spark):
    rows = [(i, [900000.7 + 1000 * i, 3.0], i % 2) for i in range(6)] + [(6, [400000.2, 1e6], 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 2) == brute(rows, 2)
    with pytest.raises(Exception, match="fit a long"):
        mined(spark.createDataFrame([(i, [1e9, 1.0], 0) for i in (2, 4)], SCHEMA), 2)


def test_small_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 5) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA), 5) == []
