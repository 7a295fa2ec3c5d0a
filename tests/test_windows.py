import math
import random

import pytest

from textloom.operators import metrics


def windows_of(ts, window):
    return [set(ts[i : i + window]) for i in range(max(1, len(ts) - window + 1))]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    return [(f"d{i}", [rng.choice("abcdexyz") for _ in range(rng.choice((0, 1, 3, 20, 60)))]) for i in range(40)]


@pytest.mark.parametrize("window", [1, 4, 10, 100])
def test_windows_of_pairs(spark, docs, window):
    words = ["a", "b", "c", "never"]
    expected = {}
    for _, ts in docs:
        for w in windows_of(ts, window):
            for a in w & set(words):
                for b in w & set(words):
                    expected[a, b] = expected.get((a, b), 0) + 1
    df = spark.createDataFrame(docs, "doc_id string, ts array<string>").repartition(3)
    assert {(r.a, r.b): r.n for r in metrics.window_counts(df, words, window).collect()} == expected


def test_long_documents_go_in_parts(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    ts = [rng.randrange(5) for _ in range(400)]
    expected = np.zeros((3, 3), int)
    for w in windows_of(ts, 7):
        for a in w & {0, 1, 2}:
            for b in w & {0, 1, 2}:
                expected[a, b] += 1
    at = np.array([i for i, t in enumerate(ts) if t < 3])
    code = np.array([ts[i] for i in at])
    assert (metrics.together(code, at, 394, 7, 3) == expected).all()
    real = max
    monkeypatch.setattr(metrics, "max", lambda *a: 13 if a and a[0] == 1 else real(*a), raising=False)  # 13 stretches at a time
    assert (metrics.together(code, at, 394, 7, 3) == expected).all()


def test_coherence_against_plain_formulas(spark, docs):
    topics = {"t": ["a", "b", "x"], "u": ["c", "d", "never"]}
    rows = [(t, i, w) for t, ws in topics.items() for i, w in enumerate(ws, 1)]
    top = spark.createDataFrame(rows, "topic string, pos int, word string")
    df = spark.createDataFrame(docs, "doc_id string, ts array<string>")
    for measure, window in (("c_v", 110), ("c_npmi", 10)):
        sets = [w for _, ts in docs for w in windows_of(ts, window)]

        def npmi(a, b, sets=sets):
            p, pa, pb = (sum(s <= w for w in sets) / len(sets) for s in ({a, b}, {a}, {b}))
            return math.log((p + 1e-12) / (pa * pb)) / -math.log(p + 1e-12)

        expected = {}
        for t, ws in topics.items():
            known = [w for w in ws if w != "never"]
            v = [[npmi(a, b) for b in known] for a in known]
            total = [sum(c) for c in zip(*v, strict=True)]
            size = lambda x: math.sqrt(sum(i * i for i in x))
            cv = sum(sum(i * j for i, j in zip(r, total, strict=True)) / (size(r) * size(total) + 1e-12) for r in v) / len(v)
            off = [v[i][j] for i in range(len(v)) for j in range(len(v)) if i != j]
            expected[t] = round(cv if measure == "c_v" else sum(off) / len(off), 6)
        got = {r.topic: r[measure] for r in metrics.window_coherence(top, df, 10, measure=measure).collect()}
        assert got.keys() == expected.keys() and all(abs(got[t] - expected[t]) < 2e-6 for t in got)
