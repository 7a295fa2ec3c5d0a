"""Detection and removal of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Share of proper uses, occurrences, and share of documents that a name may have.
CONSISTENCY, OCCURRENCES, DOC_RATIO = 0.95, 2, 0.30


def document_frequency(corpus: DataFrame) -> DataFrame:
    """(term, df) over white-space tokens."""
    ts = F.array_distinct(F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda x: x != ""))
    return corpus.select(F.explode(ts).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def candidates(tagged: DataFrame) -> DataFrame:
    """(term, proper, total). tagged: term, pos, one row per token."""
    return tagged.groupBy("term").agg(F.count_if(F.col("pos") == "PROPN").alias("proper"), F.count("*").alias("total"))


def name_set(counts: DataFrame, df: DataFrame, n_docs: DataFrame, extra: DataFrame | None = None, protected: list[str] = ()) -> DataFrame:
    """(term, total, df) of names: used often enough, nearly always as a proper name, and not in too many documents; with `extra` (term), without protected terms. n_docs: one row (n)."""
    known = counts.join(df, "term").crossJoin(F.broadcast(n_docs))
    most = F.greatest(F.lit(1), F.floor(F.col("n") * DOC_RATIO))
    found = known.filter((F.col("total") >= OCCURRENCES) & (F.col("proper") / F.col("total") >= CONSISTENCY) & (F.col("df") <= most)).select("term", "total", "df")
    if extra is not None:
        more = extra.join(found, "term", "left_anti").distinct().join(counts, "term", "left").join(df, "term", "left")
        found = found.unionByName(more.select("term", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("df", F.lit(0)).alias("df")))
    return found.filter(~F.lower("term").isin(list(protected))) if protected else found


def author_names(meta: DataFrame, columns: list[str]) -> DataFrame:
    """(term): parts of more than one character of the name columns."""
    parts = F.filter(F.split(F.translate(F.concat_ws(" ", *columns), ",", " "), r"\s+"), lambda x: F.length(x) > 1)
    return meta.select(F.explode(parts).alias("term")).distinct()


def proper_candidates(pos_list: DataFrame) -> DataFrame:
    """(word, n) of the words tagged as proper names, the commonest first."""
    return pos_list.filter("pos = 'PROPN'").groupBy("word").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "word")


def stripped(corpus: DataFrame, names: DataFrame, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """The corpus without the names (term) in the given columns, case-sensitive. The names of each document only are sent to it, so the list may be of any size."""
    ts = F.filter(F.split(F.concat_ws(" ", *columns), r"\s+"), lambda x: x != "")
    words = corpus.select("doc_id", F.explode(F.array_distinct(ts)).alias("term"))
    hit = words.join(names.select("term").distinct(), "term").groupBy("doc_id").agg(F.collect_set("term").alias("__names"))
    none: Column = F.array().cast("array<string>")
    return corpus.join(hit, "doc_id", "left").withColumns({c: T.strip_names(F.col(c), F.coalesce("__names", none)) for c in columns}).drop("__names")
