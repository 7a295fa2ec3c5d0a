"""Corpus tables: roles, years, merges, ids, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.kept import numbered

#: Candidate column names of each role, in the order in which they are tried.
ROLES = {
    "id": ["_id", "id", "doc_id", "document_id", "filename", "file_id", "index"],
    "content": ["content_stop", "content_lem", "content_min", "content_gen", "content", "text", "clean_text", "body", "fulltext"],
    "year_first": ["date", "year_first", "jahr_first", "year"],
    "year": ["year_final", "year", "jahr", "jahr_final", "date", "datum"],
}
CONTENT_STAGES = ["content", "content_min", "content_lem", "content_stop", "content_gen"]


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that a column is named like, whatever its case and outer blanks."""
    known = {c.strip().lower(): c for c in reversed(columns)}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)


def metadata(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.strip().lower() in CONTENT_STAGES])


def year_column(df: DataFrame) -> Column:
    """Per row the first-year column, else the main one, as a nullable integer."""
    names = [find_column(df.columns, ROLES[r]) for r in ("year_first", "year")]
    parts = [F.col(f"`{n}`").try_cast("double") for n in names if n]
    return (F.coalesce(*parts) if parts else F.lit(None).cast("double")).cast("int")


def with_document_id(df: DataFrame, order: list[str]) -> DataFrame:
    """`doc_id` as text; without an id column the running number in the given order."""
    name = find_column(df.columns, ROLES["id"])
    if name:
        return df.withColumn("doc_id", F.col(f"`{name}`").cast("string"))
    # rows that are equal in the given columns go by their content, so that the order is a total one
    out = numbered(df.withColumn("__tie", F.xxhash64(*df.columns)), "doc_id", *order, "__tie")
    return out.withColumn("doc_id", F.col("doc_id").cast("string")).drop("__tie")


def year_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("year").alias("year_from"), F.max("year").alias("year_to"))


def between_years(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.filter(F.col("year").between(start, end))


def with_genre(df: DataFrame, genre: str) -> DataFrame:
    """Documents whose comma list of genres holds the genre."""
    return df.filter(F.array_contains(T.tag_list(F.col("genre")), genre))


def facet_columns(df: DataFrame, columns: list[str], low: int = 2, high: int = 30) -> DataFrame:
    """(column, n_values) of the columns with low to high distinct values."""
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column, n_values)").filter(F.col("n_values").between(low, high))


def has_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled): whether any row has a value."""
    counts = df.agg(*[(F.count(c) > 0).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column, filled)")


def unique_ids(df: DataFrame, id_: str, order: str) -> DataFrame:
    """id, id_2, id_3 ... for repeated ids, in the order of a column."""
    n = F.row_number().over(Window.partitionBy(id_).orderBy(order))
    return df.withColumn("unique_id", F.when(n == 1, F.col(id_)).otherwise(F.concat_ws("_", id_, n.cast("string"))))


def merge_texts(texts: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with metadata by file stem, names without metadata). texts: file_name, text; meta: id, ..."""
    keyed = texts.withColumn("id", T.strip_txt(F.col("file_name")))
    return keyed.join(meta, "id", "left"), keyed.join(meta.select("id"), "id", "left_anti").select("file_name")


def merge_metadata(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """Edited metadata with the content of each document, content last."""
    return meta.join(texts.select("doc_id", "content"), "doc_id", "left").select(*[c for c in meta.columns if c != "content"], "content")


def segments(corpus: DataFrame, words: int = 1000, min_words: int = 50) -> DataFrame:
    """(_id, source_id, content): chunks of `words` words. A last chunk shorter than min_words is left out unless it is the only one; numbers count those left out."""
    ts = F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda x: x != "")
    rows = corpus.select(F.col("doc_id").alias("source_id"), ts.alias("ts")).filter(F.size("ts") > 0)
    starts = F.sequence(F.lit(1), F.size("ts"), F.lit(words))
    rows = rows.select("source_id", F.size(starts).alias("n"), F.posexplode(F.transform(starts, lambda i: F.slice("ts", i, words))).alias("i", "chunk"))
    rows = rows.filter((F.size("chunk") >= min_words) | (F.col("n") == 1))
    return rows.select(F.concat(F.col("source_id"), F.lit("_"), F.lpad((F.col("i") + 1).cast("string"), 4, "0")).alias("_id"), "source_id", F.array_join("chunk", " ").alias("content"))


def by_source(doc_topic: DataFrame, segment_source: DataFrame) -> DataFrame:
    """(source_id, topic, weight): means over all segments of a source; topics that a segment lacks count as zeros."""
    sizes = segment_source.groupBy("source_id").agg(F.count("*").alias("n"))
    sums = doc_topic.join(segment_source, "_id").groupBy("source_id", "topic").agg(F.sum("weight").alias("s"))
    return sums.join(sizes, "source_id").select("source_id", "topic", (F.col("s") / F.col("n")).alias("weight"))
