import random

from pyspark.sql import functions as F

from textloom.llm import quality as Q


def corpus(spark, n=800):
    rng = random.Random(3)
    vocabulary = ["wort%d" % i for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))] if good else [rng.choice(vocabulary) + "!!"] * rng.randrange(20, 90)
        rows.append((i, " ".join(words), "junk.example" if not good or i % 50 == 1 else f"h{i % 3}", "a" if i % 2 else "b"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_shrinkage(spark):
    docs, labels = corpus(spark)
    out = Q.quality(docs, labels)
    r = out.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("keep").cast("int") == F.col("quality")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 150 and r.right > 0.95
    sites = out.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("host_mean").alias("m"), F.avg("document").alias("raw")).collect()
    mean = out.agg(F.avg("document")).first()[0]
    for s in sites:  # each posterior lies between its own mean and the global one
        assert min(s.raw, mean) - 1e-9 <= s.m <= max(s.raw, mean) + 1e-9
    assert min(sites, key=lambda s: s.m).source == "junk.example"


def test_sparse_sites_are_shrunk_more(spark):
    sites = spark.createDataFrame([("a", 1000, 900.0, 0.5), ("b", 1000, 100.0, 0.5), ("c", 1000, 500.0, 0.5)], "host string, n long, s double, mean double")
    even = sites.withColumn("s", F.col("n") * 0.5)
    apart, alike = (Q.strengths(x, F.col("mean")).first().strength for x in (sites, even))
    assert 0 < apart < 10 < 1000 < alike


def test_edge_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = Q.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len(Q.quality(docs, labels.limit(0)).collect()) == docs.count()
    assert Q.quality(empty, labels).count() == 0
