import random

import numpy as np
import pytest

from textloom.llm import common
from textloom.llm import components as C
from textloom.llm import near_dup as N
from textloom.llm.shingles import words_of


def brute(rows):
    """(links, class) of each row by all pairs; rows: (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = words_of(text or "")
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return [(r[0], min((d for d in groups[find(i)] if d is not None), default=None), links[i]) for i, r in enumerate(rows)]


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 120))]
        for _ in range(rng.choice((1, 1, 2, 5, 40))):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(out[:n])]


def found_in(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path)
    return sorted((r.doc_id, r.class_id, r.n_links) for r in N.near_duplicates(spark.read.parquet(path)).collect())


@pytest.mark.parametrize("seed", [3, 5])
def test_against_all_pairs(spark, tmp_path, monkeypatch, seed):
    rows = texts(seed, 260)
    want, first = sorted(brute(rows)), None
    for small, block in ((24, 256), (2, 3)):
        monkeypatch.setattr(N, "SMALL", small)
        monkeypatch.setattr(N, "BLOCK", block)
        found = found_in(spark, str(tmp_path / "d"), rows)
        assert sum(n for *_, n in found) >= 0.99 * sum(n for *_, n in want)
        assert all(a[2] <= b[2] for a, b in zip(found, want, strict=True))
        assert first in (None, found)  # the ways for small and for large nodes find the same links
        first = found
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # joins by shuffle, hot keys apart
    assert first == found_in(spark, str(tmp_path / "d"), rows)


def test_prefixes_are_shortened_only_where_it_is_needed(spark, tmp_path, monkeypatch):
    """A large group of near copies is closed at full paths; others go on to shorter prefixes."""
    closed = []
    at = N._Join.at
    monkeypatch.setattr(N._Join, "at", lambda self, level, shut: (closed.append((level, shut and shut.count())), at(self, level, shut))[1])
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:5 * i], f"x{i}", *base[5 * i + 1 :]])) for i in range(60)]
    rows += [(100 + i, " ".join(f"v{i // 2}a{k}" for k in range(60 - (i % 2) * 9))) for i in range(10)]  # pairs of similarity 47 / 56
    found = found_in(spark, str(tmp_path / "d"), rows)
    assert found == sorted(brute(rows))
    assert closed == [(2, None), (1, 60), (0, 60)]


def test_edge_rows(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(((r.doc_id, r.class_id, r.n_links) for r in N.near_duplicates(docs).collect()), key=str)
    assert found == sorted(brute(rows), key=str)
    out = N.keep_one_of_each(docs)
    assert out.columns == docs.columns and out.count() == len({r[1] for r in found})
    assert N.near_duplicates(empty).count() == 0


def test_depth_is_shortened_to_the_target():
    depth = N.prefix_depth()
    assert N.recall(depth) >= N.RECALL > N.recall(depth + 1)


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 180), rng.randrange(100, 180)) for _ in range(50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    one = sorted(map(tuple, C.components(df).collect()))
    monkeypatch.setattr(C, "ONE_TASK", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, C.components(df).collect())) == one and (40, 0) in one
    monkeypatch.setattr(C, "ONE_TASK", 9)
    assert C.components(df.limit(0)).count() == 0


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint32)) for _ in range(12)]
    got = N.common_counts(sets[:5], sets[5:], columns=7)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()
