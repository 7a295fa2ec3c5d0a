"""Tagged word lists: statistics of tags, tag combinations, tagsets and termsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def with_tags(tagged: DataFrame) -> DataFrame:
    """(word, pos, count, tags array): tagged has tag1, tag2, tag3, any of them blank."""
    combined = T.combine_tags(*[F.col(c) for c in ("tag1", "tag2", "tag3")])
    return tagged.withColumn("combined", combined).withColumn("tags", F.array_sort(F.array_distinct(T.tag_list(combined))))


def onto_matrix(rank: DataFrame, tagged: DataFrame) -> DataFrame:
    """A rank table (term, ...) with the tags of its words; a word that is listed twice gives two rows."""
    words = tagged.select(F.trim("word").alias("__w"), "pos", "combined")
    return rank.join(words, F.trim(rank["term"]) == F.col("__w"), "left").drop("__w")


def single_frequency(tagged: DataFrame) -> DataFrame:
    """(tag, types, tokens)."""
    return tagged.select(F.explode("tags").alias("tag"), "word", "count").groupBy("tag").agg(F.countDistinct("word").alias("types"), F.sum("count").alias("tokens"))


def combination_frequency(tagged: DataFrame) -> DataFrame:
    """(combination, n) of the words' whole tag sets."""
    return tagged.filter(F.size("tags") > 0).groupBy(F.array_join("tags", ", ").alias("combination")).agg(F.count("*").alias("n"))


def combinations(tagged: DataFrame, size: int = 3) -> DataFrame:
    """(combination, word): every subset of up to `size` of a word's tags."""
    pairs = tagged.select("word", F.explode("tags").alias("t1")).distinct()
    level = pairs.select("word", F.col("t1").alias("last"), F.col("t1").alias("combination"))
    every = level.select("combination", "word")
    for _ in range(size - 1):
        level = level.join(pairs, "word").filter("last < t1").select("word", F.col("t1").alias("last"), F.concat_ws(", ", "combination", "t1").alias("combination"))
        every = every.union(level.select("combination", "word"))
    return every


def sorted_tagset(tagset: DataFrame, rank: DataFrame) -> DataFrame:
    """(combination, word, place): words by their rank, unranked ones last. rank: term, rank."""
    from pyspark.sql import Window

    known = tagset.join(rank.select(F.col("term").alias("word"), "rank"), "word", "left")
    turn = Window.partitionBy("combination").orderBy(F.col("rank").asc_nulls_last(), "word")
    return known.select("combination", "word", F.row_number().over(turn).alias("place"))


def word_tag_matrix(tagged: DataFrame, tags: list[str]) -> DataFrame:
    """word and a column of 0 or 1 per tag."""
    return tagged.select("word", *[F.array_contains("tags", t).cast("int").alias(t) for t in tags])


def tagset_overview(termset: DataFrame, preview: int = 5) -> DataFrame:
    """(tag, words, preview): number of words, and the first of them."""
    return termset.groupBy("tag").agg(F.count("*").alias("words"), F.array_join(F.slice(F.array_sort(F.collect_list("word")), 1, preview), ", ").alias("preview"))


def progress(tagged: DataFrame) -> DataFrame:
    """One row: words, and how many have a tag."""
    return tagged.agg(F.count("*").alias("words"), F.count_if(F.size("tags") > 0).alias("tagged"))


def with_tag_columns(pos_list: DataFrame, columns: tuple[str, ...] = ("tag1", "tag2", "tag3")) -> DataFrame:
    """A POS list with all tag columns, missing and null ones blank."""
    have = set(pos_list.columns)
    return pos_list.withColumns({c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in have else F.lit("") for c in columns})


def selected(termset: DataFrame, chosen: list[str]) -> DataFrame:
    """The words of some tags only."""
    return termset.filter(F.col("tag").isin(chosen) & (F.trim("word") != ""))


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """df, or an error that names what it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def matrix_onto_termset(matrix: DataFrame, termset: DataFrame) -> DataFrame:
    """(tag, word, total) of a TF-IDF matrix for the words of a termset."""
    return termset.join(matrix.groupBy(F.col("term").alias("word")).agg(F.sum("tfidf").alias("total")), "word", "left").select("tag", "word", F.coalesce("total", F.lit(0.0)).alias("total"))
