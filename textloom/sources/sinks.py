"""What a project writes: corpora, vocabularies, matrices, models' tables, import files."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrices
from ..operators.corpus import metadata

TOP_WORDS = 5000


def write_stages(corpus: DataFrame, path: str, stages: Iterable[str], fmt: str = "parquet") -> None:
    """For each stage the metadata with its content column."""
    meta = metadata(corpus).columns
    for stage in stages:
        corpus.select(*meta, f"content_{stage}").write.mode("overwrite").format(fmt).option("header", "true").save(f"{path}/korpus_{stage}")


def write_corpus(corpus: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The corpus, content last, and its metadata."""
    meta = [c for c in metadata(corpus).columns]
    corpus.select(*meta, "content").write.mode("overwrite").format(fmt).option("header", "true").save(f"{path}/korpus")
    corpus.select(*meta).write.mode("overwrite").format(fmt).option("header", "true").save(f"{path}/metadaten")


def vocabulary_json(counts: DataFrame, variant: str) -> DataFrame:
    """One row (value): the vocabulary file of counts (term, n). The file format has all terms in one object."""
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), 1, TOP_WORDS), lambda x: F.array(x["term"], (-x["m"]).cast("string")))
    made = counts.agg(F.to_json(F.struct(F.lit(variant).alias("variant"), F.count("*").alias("vocabulary_size"), F.sum("n").alias("total_tokens"), top.alias("top_words"), F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("full_vocab"))).alias("value"))
    # Spark's arrays are of one type; the counts in the pairs become numbers here
    return made.select(F.regexp_replace("value", r'\["((?:[^"\\]|\\.)*)","(\d+)"\]', r'["$1",$2]').alias("value"))


def write_vocabulary(counts: DataFrame, variant: str, path: str) -> None:
    vocabulary_json(counts, variant).coalesce(1).write.mode("overwrite").text(path)


def write_matrix(matrix: DataFrame, terms: list[str], value: str, meta: DataFrame, path: str) -> None:
    """A wide CSV: metadata, then a column per term."""
    wide = matrices.wide(matrix, terms, value)
    meta.join(wide, "doc_id", "left").na.fill(0, terms).write.mode("overwrite").csv(path, header=True)


def write_topics(doc_topic: DataFrame, topic_word: DataFrame, params: dict, path: str, topics: list) -> None:
    """Wide document-topic and topic-word tables and the parameters as text."""
    doc_topic.groupBy("doc_id").pivot("topic", topics).agg(F.first("weight")).na.fill(0).write.mode("overwrite").csv(f"{path}/document_topics", header=True)
    words = topic_word.groupBy("topic").pivot("pos").agg(F.first("word")).withColumnRenamed("topic", "Topic")
    words.write.mode("overwrite").csv(f"{path}/topic_words", header=True)
    spark = doc_topic.sparkSession
    spark.createDataFrame([(f"{k}: {v}",) for k, v in params.items()], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/hyperparameters")


def write_vectors(vectors: DataFrame, params: dict, path: str) -> None:
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(k, str(v)) for k, v in params.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/params")


def mallet_lines(corpus: DataFrame) -> DataFrame:
    """(value): id, label and text without tabs and line feeds, parted by tabs."""
    return corpus.select(F.concat_ws("\t", "doc_id", F.lit("X"), F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))).alias("value"))


def ensure_output(df: DataFrame | None, spark, schema: str) -> DataFrame:
    """df, or an empty table of the schema where a step gave nothing."""
    return df if df is not None else spark.createDataFrame([], schema)


def renamed_topics(df: DataFrame, names: list[str], id_: str = "doc_id") -> DataFrame:
    """A wide document-topic table with its topic columns named anew by position; names of which there are too few keep the old ones."""
    topics = [c for c in df.columns if c != id_]
    return df.select(id_, *[F.col(f"`{c}`").alias(n or c) for c, n in zip(topics, [*names, *topics[len(names) :]], strict=True)])


#: Characters that are replaced in file names.
UNSAFE = ' /\\:*?"<>|'


def safe_name(name: str) -> str:
    return name.translate(str.maketrans(UNSAFE, "_" * len(UNSAFE)))


def next_version(name: str, existing: Iterable[str]) -> str:
    """name_v1, or one more than the highest version that there is."""
    found = [int(m[1]) for e in existing if (m := re.fullmatch(re.escape(name) + r"_v(\d+)", e))]
    return f"{name}_v{max(found, default=0) + 1}"
