import random

from pyspark.sql import functions as F

from textloom.llm import toxicity as X


def all_maximal(scores):
    """Ruzzo and Tompa's definition, by recursion: the best segment (leftmost, shortest of equals), then left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, s = best
    return all_maximal(scores[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in all_maximal(scores[b:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice((X.PENALTY, X.PENALTY, X.PENALTY, rng.uniform(0.01, 0.6))) for _ in range(rng.randrange(0, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = X.segments(at, [scores[i] for i in at])
        want = all_maximal(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))


def corpus(spark, n=900):
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(("vilest", "scoundrel", "nasty" + rng.choice("abcdefgh"))))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    scored = X.score_texts(docs, X.fit(docs, labels)).join(labels, "doc_id").filter(X.is_held_out(F.col("doc_id")))
    r = scored.agg(F.avg(((F.col("score") >= X.THRESHOLD).cast("int") == F.col("toxic")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 200 and r.right > 0.95


def test_edge_rows(spark, docs, empty):
    train, labels = corpus(spark, 600)
    model = X.fit(train, labels)
    rows = X.score_texts(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score < X.THRESHOLD for r in rows)
    assert X.score_texts(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    assert X.keep_clean(docs, odd).count() == docs.count()
    assert X.keep_clean(docs, odd).columns == docs.columns
    assert X.keep_clean(empty, odd.limit(0)).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(X.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (X.fit(docs, x) for x in (labels, flipped))
    assert a.log_odds == b.log_odds and (a.rate, a.k, a.intercept, a.slope) == (b.rate, b.k, b.intercept, b.slope)
