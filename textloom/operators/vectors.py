"""Word vectors (word, vector array<double>): neighbours, networks, model comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def with_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))


def neighbours(vectors: DataFrame, words: list[str], k: int = 20, least: float | None = None) -> DataFrame:
    """(word, neighbour, similarity, rank) of a list of words: the nearest others by cosine. The words' vectors are few and are broadcast."""
    v = with_norm(vectors)
    asked = v.filter(F.col("word").isin(words)).select(F.col("word").alias("q"), F.col("vector").alias("qv"), F.col("norm").alias("qn"))
    pairs = v.crossJoin(F.broadcast(asked)).filter("word <> q")
    pairs = pairs.select(F.col("q").alias("word"), F.col("word").alias("neighbour"), F.round(dot(F.col("vector"), F.col("qv")) / (F.col("norm") * F.col("qn") + EPSILON), 6).alias("similarity"))
    if least is not None:
        pairs = pairs.filter(F.col("similarity") >= least)
    turn = Window.partitionBy("word").orderBy(F.desc("similarity"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)


def common_neighbours(vectors: DataFrame, a: str, b: str, k: int = 50, least: float = 0.3) -> DataFrame:
    """(neighbour, similarity_a, similarity_b) that both words have."""
    near = neighbours(vectors, [a, b], k, least)
    left, right = (near.filter(F.col("word") == w).select("neighbour", F.col("similarity").alias(f"similarity_{n}")) for w, n in ((a, "a"), (b, "b")))
    return left.join(right, "neighbour")


def network(vectors: DataFrame, seeds: list[str], top: int = 8, least: float = 0.3) -> DataFrame:
    """(src, dst, weight): seeds with their nearest words, and seeds with each other, each pair once."""
    near = neighbours(vectors, seeds, top, least).select(F.col("word").alias("a"), F.col("neighbour").alias("b"), "similarity")
    among = neighbours(vectors.filter(F.col("word").isin(seeds)), seeds, len(seeds), least).select(F.col("word").alias("a"), F.col("neighbour").alias("b"), "similarity")
    return near.union(among).groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("similarity").alias("weight"))


def coverage(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """One row: words asked for, those with a vector, their share."""
    known = words.select("word").distinct().join(vectors.select("word").distinct().withColumn("hit", F.lit(1)), "word", "left")
    return known.agg(F.count("*").alias("words"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


def out_of_vocabulary(vectors: DataFrame, words: DataFrame) -> DataFrame:
    return words.select("word").distinct().join(vectors.select("word"), "word", "left_anti")


def stability(model_a: DataFrame, model_b: DataFrame, words: list[str], k: int = 10) -> DataFrame:
    """(word, jaccard) of a word's k nearest words in two models."""
    sets = [neighbours(m, words, k).groupBy("word").agg(F.collect_set("neighbour").alias(n)) for m, n in ((model_a, "a"), (model_b, "b"))]
    both = sets[0].join(sets[1], "word")
    return both.select("word", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def rank_correlation(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row (n, rho): Spearman's correlation of cosine and score over the pairs (w1, w2, score) in the vocabulary."""
    v = with_norm(vectors)
    left, right = (v.select(F.col("word").alias(f"w{i}"), F.col("vector").alias(f"v{i}"), F.col("norm").alias(f"n{i}")) for i in (1, 2))
    known = pairs.join(left, "w1").join(right, "w2").select("score", F.round(dot(F.col("v1"), F.col("v2")) / (F.col("n1") * F.col("n2") + EPSILON), 9).alias("cos"))
    whole = Window.partitionBy(F.lit(0))
    for c in ("score", "cos"):  # equal values share their mean rank
        tied = Window.partitionBy(c)
        known = known.withColumn(f"r_{c}", F.rank().over(whole.orderBy(c)) + (F.count("*").over(tied) - 1) / 2)
    return known.agg(F.count("*").alias("n"), F.round(F.corr("r_score", "r_cos"), 6).alias("rho"))


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction in Lentz's form."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for step in range(400):
        k = step // 2
        term = 1.0 if not step else k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if step % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / ((1 + term * d) or 1e-300)
        c = (1 + term / c) or 1e-300
        value *= c * d
        if step and abs(c * d - 1) < 1e-13:
            break
    return front * (value - 1)


def p_value(n: int, rho: float) -> float:
    """Two-sided p-value of a rank correlation of n pairs under Student's t distribution with n - 2 degrees of freedom."""
    if n < 3:
        return float("nan")
    free = n - 2
    return _beta_share(free / 2, 0.5, 1 - rho * rho)


def rank_test(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row (n, rho, p): `rank_correlation` and its p-value; null where there are fewer than two pairs, or for p three."""
    found = F.udf(lambda n, rho: None if rho is None or n < 3 else p_value(n, rho), "double")  # one row
    return rank_correlation(vectors, pairs).withColumn("p", found("n", "rho"))


def rotation(model_a: DataFrame, model_b: DataFrame) -> np.ndarray:
    """The orthogonal matrix that takes model_a closest to model_b on their shared words: a product of k x k summed over the words, then one SVD here."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            a, b = (np.array(batch.column(i).to_pylist(), float).reshape(batch.num_rows, -1) for i in (0, 1))
            total = a.T @ b if total is None else total + a.T @ b
        if total is not None and total.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "s"])

    both = model_a.select("word", F.col("vector").alias("a")).join(model_b.select("word", F.col("vector").alias("b")), "word").select("a", "b")
    rows = both.mapInArrow(products, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).orderBy("cell").collect()  # k x k numbers
    size = round(len(rows) ** 0.5)
    u, _, vt = np.linalg.svd(np.array([r.s for r in rows]).reshape(size, size))
    return u @ vt


def drift(model_a: DataFrame, model_b: DataFrame) -> DataFrame:
    """(word, drift): cosine distance of the shared words after the rotation, the largest first."""
    r = rotation(model_a, model_b)
    columns = [F.array(*[F.lit(float(x)) for x in col]) for col in r.T]
    turned = with_norm(model_a).select("word", F.array(*[dot(F.col("vector"), c) for c in columns]).alias("a"), F.col("norm").alias("na"))
    both = turned.join(with_norm(model_b).select("word", F.col("vector").alias("b"), F.col("norm").alias("nb")), "word")
    return both.select("word", F.round(1 - dot(F.col("a"), F.col("b")) / (F.col("na") * F.col("nb") + EPSILON), 6).alias("drift")).orderBy(F.desc("drift"), "word")


def summary(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("words"), F.max(F.size("vector")).alias("dimensions"))


def cloud_weights(termset: DataFrame, tfidf_means: DataFrame) -> DataFrame:
    """(word, weight, size) of termset words: greatest mean TF-IDF, and ln(weight + 1)."""
    found = termset.join(tfidf_means.select(F.col("term").alias("word"), "mean"), "word").groupBy("word").agg(F.max("mean").alias("weight"))
    return found.withColumn("size", F.round(F.log1p("weight"), 9))
