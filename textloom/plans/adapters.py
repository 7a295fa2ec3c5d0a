"""The tables of a corpus project, derived from the driver's tables by fixed expressions.

documents: genre is the language, textclass the source; the year (1800 to 1899) is made up
from the doc_id. embeddings: word vectors, and in their first twelve components a
document-topic distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matrices

TOPICS = [f"{lang}_{i}" for lang in ("de", "en", "es", "fr") for i in range(3)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("genre"),
        F.col("source").alias("textclass"),
        (F.lit(1800) + F.col("doc_id") % 100).cast("int").alias("year"),
    )


def tfidf2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.tfidf(corpus(spark, sf_dir), 2000)


def doc_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, topic, weight): shares of the absolute values of the first twelve components; null where there is no vector."""
    vector = F.coalesce("embedding", F.array().cast("array<float>"))
    x = F.transform(F.slice(vector, 1, len(TOPICS)), lambda e: F.abs(e.cast("double")))
    total = F.aggregate(x, F.lit(0.0), lambda s, e: s + e)
    names = F.array(*[F.lit(t) for t in TOPICS])
    pairs = F.arrays_zip(names.alias("topic"), x.alias("weight"))
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.explode(pairs).alias("p"), total.alias("total")).select("doc_id", F.col("p.topic").alias("topic"), (F.col("p.weight") / F.col("total")).alias("weight"))


def topic_word(spark: SparkSession, sf_dir: str, top: int = 50) -> DataFrame:
    """(topic, pos, word): for each language and doc_id mod 3 the terms with the highest sums of TF-IDF."""
    topic_of = corpus(spark, sf_dir).select("doc_id", F.concat_ws("_", "genre", (F.col("doc_id").cast("long") % 3).cast("string")).alias("topic"))
    sums = tfidf2000(spark, sf_dir).join(topic_of, "doc_id").groupBy("topic", F.col("term").alias("word")).agg(F.round(F.sum("tfidf"), 9).alias("s"))
    by = Window.partitionBy("topic").orderBy(F.desc("s"), "word")
    return sums.withColumn("pos", F.row_number().over(by)).filter(F.col("pos") <= top).select("topic", "pos", "word")


def termset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, word): terms of four characters and more under their first character."""
    words = matrices.vocabulary(corpus(spark, sf_dir), 2000).select(F.col("term").alias("word"))
    return words.filter(F.length("word") >= 4).select(F.substring("word", 1, 1).alias("tag"), "word")


def vectors(spark: SparkSession, sf_dir: str, half: int | None = None) -> DataFrame:
    """(word, vector): all components, or those of the first (0) or second (1) half as of two models."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    if half is not None:
        v = F.slice(v, 1 + 32 * half, 32)
    return load(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), v.alias("vector"))


def pos_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, pos, count): the 5000 commonest words, tagged by their form."""
    words = matrices.term_counts(corpus(spark, sf_dir)).orderBy(F.desc("n"), "term").limit(5000)
    first = F.substring("term", 1, 1)
    pos = F.when(F.rlike("term", F.lit(r"^[\p{N}_]+$")), "NUM").when((F.upper(first) == first) & (F.lower(first) != first), "PROPN").when(F.length("term") <= 3, "DET").otherwise("NOUN")
    return words.select(F.col("term").alias("word"), pos.alias("pos"), F.col("n").alias("count"))
