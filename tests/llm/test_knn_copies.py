import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import voronoi_knn as V

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5):
    """Each query row against all rows of other ids; copies count."""
    good = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    out = []
    for q, v in good:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found(spark, rows):
    return sorted(map(tuple, V.knn_join(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()))


def test_copies_fill_ranks(spark):
    rows = [(10, [1.0]), (1, [9.0]), (1, [9.0]), (2, [8.0]), (3, [7.0]), (4, [6.0]), (5, [5.0])]
    assert [r[2] for r in found(spark, rows)] == [1, 1, 2, 3, 4]
    assert [r[2] for r in found(spark, rows + [(1, [9.0])] * 8)] == [1] * 5


def test_copies_do_not_prune_others(spark):
    rng = random.Random(2)
    rows = [(0, [10.0, 0.0]), *[(1, [10.0, 0.0])] * 40, *[(i, [1 + rng.random() / 9, rng.random() / 9]) for i in range(2, 80)]]
    assert found(spark, rows) == brute(rows)


def test_large_numbers(spark):
    rows = [(10, [2.0**24, 1.0]), (1, [2.0**20, -3.0]), (2, [2.0**20, 5.5]), (3, [1e-9, -1e-9]), (4, [0.0, 2.0**40])]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="fit a long"):
        found(spark, [(10, [1e100]), (1, [1.0])])


@pytest.mark.parametrize("block", [2048, 8])
def test_copies_in_many_groups(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.5, 1.0)) for _ in range(3)]) for i in range(160)]
    rows += [r for r in rows for _ in range(rng.choice((0, 0, 1, 6)))]  # copies, of queries too
    rows += [(i, [rng.choice((-1.0, 0.5)) for _ in range(3)]) for i in range(0, 160, 7)]  # other vectors of an id
    assert found(spark, rows) == brute(rows)
