"""Post-processing of topic models: ranks, top documents, year tables, series.

doc_topic: doc_id, topic, weight. Years and texts come from a metadata table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def statistics(doc_topic: DataFrame) -> DataFrame:
    """(topic, total, mean, deviation, rank): sample deviation, dense rank of the sum."""
    sums = doc_topic.groupBy("topic").agg(F.round(F.sum("weight"), 9).alias("total"), F.round(F.avg("weight"), 9).alias("mean"), F.round(F.stddev_samp("weight"), 9).alias("deviation"))
    return sums.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("total"))))


def top_documents(doc_topic: DataFrame, n: int = 50) -> DataFrame:
    """(topic, position, doc_id, weight)."""
    turn = Window.partitionBy("topic").orderBy(F.desc("weight"), "doc_id")
    return doc_topic.withColumn("position", F.row_number().over(turn)).filter(F.col("position") <= n).select("topic", "position", "doc_id", "weight")


def top_topics(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy("rank", "topic").limit(k)


def top_subset(top: DataFrame, stats: DataFrame, k: int = 10, ranks: int = 30) -> DataFrame:
    """The first `ranks` documents of the k best topics."""
    return top.filter(F.col("position") <= ranks).join(F.broadcast(top_topics(stats, k).select("topic")), "topic", "left_semi")


def onto_metadata(top: DataFrame, meta: DataFrame, entry: Column) -> DataFrame:
    """Adds `text`: the metadata entry of a document, whose id may have .txt on either side, else the id."""
    exact = meta.select(F.col("doc_id").alias("__exact"), entry.alias("__e1"))
    loose = meta.groupBy(T.strip_txt(F.col("doc_id")).alias("__loose")).agg(F.max_by(entry, "doc_id").alias("__e2"))
    out = top.join(exact, top["doc_id"] == F.col("__exact"), "left").join(loose, T.strip_txt(top["doc_id"]) == F.col("__loose"), "left")
    return out.withColumn("text", F.coalesce("__e1", "__e2", "doc_id")).drop("__exact", "__e1", "__loose", "__e2")


def year_topic_texts(placed: DataFrame) -> DataFrame:
    """(year, topic, texts): texts of a topic in a year in order of their position. placed: year, topic, position, text."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "; ")
    return placed.filter("year is not null").groupBy("year", "topic").agg(texts.alias("texts"))


def text_topic_matrix(placed: DataFrame, topics: list[str]) -> DataFrame:
    """text, a column of 0 or 1 per topic, and their number."""
    return placed.groupBy("text").agg(*[F.max((F.col("topic") == t).cast("int")).alias(t) for t in topics], F.countDistinct("topic").alias("n_topics"))


def topics_per_year(placed: DataFrame, topics: list[str]) -> DataFrame:
    return placed.filter("year is not null").groupBy("year").agg(*[F.count_if(F.col("topic") == t).alias(t) for t in topics])


def documents_per_year(placed: DataFrame) -> DataFrame:
    """(year, n, texts) of distinct texts in alphabetical order."""
    return placed.filter("year is not null").groupBy("year").agg(F.countDistinct("text").alias("n"), F.array_join(F.array_sort(F.collect_set("text")), "; ").alias("texts"))


def year_rank_values(placed: DataFrame, n: int) -> DataFrame:
    """(year, value): each text counts n for the first place down to 1."""
    return placed.filter("year is not null").groupBy("year").agg(F.sum(F.lit(n + 1) - F.col("position")).alias("value"))


def text_values(placed: DataFrame, n: int, topics: list[str]) -> DataFrame:
    """text, its value in all, and in each topic."""
    value = F.lit(n + 1) - F.col("position")
    return placed.groupBy("text").agg(F.sum(value).alias("total"), *[F.sum(F.when(F.col("topic") == t, value).otherwise(0)).alias(t) for t in topics])


def with_year(doc_topic: DataFrame, meta: DataFrame, min_year: int | None = None) -> DataFrame:
    """Rows whose document is in the metadata (by its stem, the last of several) with a known year."""
    years = meta.filter("year is not null").groupBy(T.document_stem(F.col("doc_id")).alias("__s")).agg(F.max_by("year", "doc_id").alias("year"))
    out = doc_topic.join(years, T.document_stem(doc_topic["doc_id"]) == F.col("__s")).drop("__s")
    return out.filter(F.col("year") >= min_year) if min_year is not None else out


def year_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("year", "topic").agg(F.round(F.avg("weight"), 6).alias("mean"))


def threshold_counts(rows: DataFrame, least: float = 0.2) -> DataFrame:
    return rows.groupBy("year", "topic").agg(F.count_if(F.col("weight") >= least).alias("n"))


def scaled(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Min-max of a column within groups; 0 where it is constant."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("scaled", F.round(F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0), 6))


def text_ranks(doc_topic: DataFrame, n: int) -> DataFrame:
    """(topic, doc_id, weight, rank): the n best texts per topic, equal ones sharing the best rank."""
    ranked = doc_topic.withColumn("rank", F.rank().over(Window.partitionBy("topic").orderBy(F.desc("weight"))))
    return ranked.filter(F.col("rank") <= n).select("topic", "doc_id", "weight", "rank")


#: The columns that a free text may be made of.
TEXT_FIELDS = ["author_surname", "title", "source", "author"]


def fuzzy_match(texts: DataFrame, meta: DataFrame, n_prefix: int = 20, n_short: int = 15) -> DataFrame:
    """(text, doc_id, strategy): the metadata row of a free text by the first strategy that finds one, whatever the case.

    1: the text is the id. 2: it contains the first n_prefix characters of every field, and
    the year if there is one. 3: it contains two of the first n_short characters of the fields
    and the year. 4: the numbers of the ids are equal without leading zeros. Fields are those
    of TEXT_FIELDS that meta has, values of fewer than three characters don't count; of
    several rows the one with the least id is taken. All are equi-joins: a row found by 2 or 3
    has a field whose short beginning is one of the text's own substrings of that length.
    meta: doc_id, year and the fields.
    """
    fields = [c for c in TEXT_FIELDS if c in meta.columns]
    texts = texts.select("text", F.lower(F.trim("text")).alias("t")).filter("t <> '' and t <> 'nan'").distinct()
    values = F.filter(F.array(*[F.lower(F.trim(F.col(c))) for c in fields]).cast("array<string>"), lambda v: F.length(v) >= 3)
    rows = meta.select("doc_id", F.lower(F.trim("doc_id")).alias("id"), F.coalesce(F.col("year").cast("int").cast("string"), F.lit("")).alias("year"), values.alias("values"))

    def beginnings(n: int) -> Column:
        return F.transform("values", lambda v: F.substring(v, 1, n))

    size = F.length("t")
    parts = F.flatten(F.transform(F.sequence(F.lit(3), F.lit(n_short)), lambda n: F.when(n <= size, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("t"), i, n))).otherwise(F.array().cast("array<string>"))))
    keyed = rows.select("*", F.explode(F.array_distinct(beginnings(n_short))).alias("k"))
    near = texts.select("text", "t", F.explode(F.array_distinct(parts)).alias("k")).join(keyed, "k").drop("k").dropDuplicates(["text", "doc_id"])
    has_year = (F.col("year") != "") & F.contains("t", "year")
    second = F.forall(beginnings(n_prefix), lambda v: F.contains(F.col("t"), v)) & ((F.col("year") == "") | has_year)
    third = F.size(F.filter(beginnings(n_short), lambda v: F.contains(F.col("t"), v))) + has_year.cast("int") >= 2
    found = near.select("text", "doc_id", F.when(second, 2).when(third, 3).alias("strategy")).filter("strategy is not null")

    def number(c: str) -> Column:
        return F.regexp_replace(T.document_stem(F.col(c)), "^0+", "")

    first = texts.join(rows, F.col("t") == F.col("id")).select("text", "doc_id", F.lit(1).alias("strategy"))
    fourth = texts.join(rows, number("t") == number("id")).select("text", "doc_id", F.lit(4).alias("strategy"))
    turn = Window.partitionBy("text").orderBy("strategy", "doc_id")
    return first.unionByName(found).unionByName(fourth).withColumn("r", F.row_number().over(turn)).filter("r = 1").drop("r")
