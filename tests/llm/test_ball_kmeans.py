import hashlib
import math
import random

import numpy as np
import pytest

from textloom.llm import ball_kmeans as B


def brute(rows, k, rounds, dims, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, z, strict=True)), c) for c, z in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centres = [[sum(column) // len(o) for column in zip(*o, strict=True)] if o else z for o, z in zip(own, centres, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, at, d in found if at == c) for c in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("tree", "leaf", "spread"), [(32768, 16, 1.0), (64, 2, 0.01), (7, 16, 1.0)])
def test_against_brute_force(spark, monkeypatch, tree, leaf, spread):
    monkeypatch.setattr(B, "TREE", tree)
    monkeypatch.setattr(B, "LEAF", leaf)
    rng = random.Random(4)
    middles = [[rng.uniform(-2, 2) for _ in range(3)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, spread) for m in middles[i % 5]]) for i in range(300)]
    rows += [(300 + i, [0.5, -0.5, 0.25]) for i in range(60)]  # one very common vector
    rows += rows[:10] + [(None, [0.1, 0.2, 0.3]), (None, [0.1, 0.2, 0.3]), (3, [1.0, 1.0, 1.0])]  # repeated rows, null and repeated ids
    rows += [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 2.0]), (904, [float("nan"), 1.0, 1.0]), (905, [1.0, float("-inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "'x' as v", "2 as n").repartition(3)
    assert rows_of(B.cluster(df, k=8, rounds=3, dims=3)) == brute(rows, 8, 3, 3)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(100, [0.5, 0.0])] * 5
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(B.cluster(df, k=6, rounds=2, dims=2)) == brute(rows, 6, 2, 2)


def test_few_rows_and_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    assert B.cluster(spark.createDataFrame([], schema), dims=2).count() == 0
    assert B.cluster(spark.createDataFrame([(1, [1.0])], schema), dims=2).count() == 0
    far = [(1, [300000.7, -3.0]), (2, [300001.3, 5.0]), (3, [-299999.9, 5.0])]
    assert rows_of(B.cluster(spark.createDataFrame(far, schema), k=2, dims=2)) == brute(far, 2, 5, 2)
    with pytest.raises(Exception, match="2\\^30"):
        B.cluster(spark.createDataFrame([(1, [1e9, 0.0])], schema), dims=2).collect()


def test_whole_balls_are_settled_unopened():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (500, 8)) + m for m in (0, 1000)])
    order, tree = B.grow(x)
    whole, owner, left = B.settle(tree, np.array([[0] * 8, [1000] * 8]))
    assert sorted(order) == list(range(1000)) and not left.any() and len(whole) == 2
    assert [owner[i] for i in whole] == list(B.distances(tree.x[tree.start[whole]], np.array([[0] * 8, [1000] * 8])).argmin(1))
    assert (tree.sums[whole].sum(0) == x.sum(0)).all()


