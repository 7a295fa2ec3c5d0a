"""A project folder's tables by name, as temporary views."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import ROLES, find_column
from . import tables
from .vector_files import read_word2vec

#: Where a project keeps each table, as patterns below its folder in the order in which they are tried.
PATTERNS = {
    "corpus": ["output/processed_corpus/korpus_stop.csv", "output/processed_corpus/*.csv"],
    "dtm": ["output/dtm_tfidf_stop/dtm_minfreq6.csv", "output/dtm_tfidf*/dtm*.csv"],
    "tfidf": ["output/dtm_tfidf_stop/tfidf-2000.csv", "output/dtm_tfidf*/tfidf*.csv"],
    "metadata": ["korpus/metadaten.csv"],
    "cosine": ["output/cosine/*.csv"],
    "topics_dist": ["resources/topic-models/*/document-topics-distribution*pro_text.csv", "resources/topic-models/*/*document*topic*.csv"],
    "termset": ["resources/termsets/*.csv"],
    "topic_words": ["resources/topic-models/*/*topic_words*.csv", "resources/topic-models/*/*words*tag*.csv"],
    "ranks": ["output/processed_termset/**/*_tag_topic_rank.csv"],
    "relevance": ["output/processed_termset/**/*_tag_topic_relevance.csv"],
    "counts_per_year": ["output/processed_termset/**/*_dtti_topdocs_topic_counts_per_year.csv"],
    "top10_year_value": ["output/processed_topics/**/*_topdocs_year_value.csv"],
    "top10_value_per_text": ["output/processed_topics/**/*_topdocs_value_per_text_topic.csv"],
    "tokens_year": ["output/statistics/*tokens*.csv"],
}


def find_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Files of a pattern below a folder of any store that Spark reads, in order; ** stands for any number of folders."""
    above, deep, name = pattern.partition("**/")
    if deep:
        return [f for f in files_below(spark, f"{root.rstrip('/')}/{above}".rstrip("/")) if fnmatchcase(f.rpartition("/")[2], name)]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def files_below(spark: SparkSession, folder: str) -> list[str]:
    """All files of a folder and its subfolders, in order; none where there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found, each = [], store.listFiles(path, True)
    while each.hasNext():
        found.append(each.next().getPath().toString())
    return sorted(found)


def tfidf_files(spark: SparkSession, folder: str, part: str = "tfidf") -> list[str]:
    """The CSV files of a folder and its subfolders whose names hold `part`."""
    return [f for f in files_below(spark, folder) if f.endswith(".csv") and part in f.rpartition("/")[2]]


def read_all(spark: SparkSession, root: str, pattern: str) -> dict[str, DataFrame]:
    """Every file of a pattern, by its path."""
    return {p: tables.read_csv(spark, p) for p in find_files(spark, root, pattern)}


class Catalog:
    """Tables of a project: `paths` name files of one's own, the rest are looked for."""

    def __init__(self, spark: SparkSession, root: str, paths: dict[str, str] | None = None):
        self.spark, self.root, self.paths = spark, root, dict(paths or {})

    def path(self, name: str) -> str | None:
        if name in self.paths:
            return self.paths[name]
        return next((found[0] for p in PATTERNS.get(name, []) if (found := find_files(self.spark, self.root, p))), None)

    def available(self) -> dict[str, str]:
        return {n: p for n in [*PATTERNS, "vectors"] if (p := self.path(n))}

    def table(self, name: str) -> DataFrame:
        path = self.path(name)
        if path is None:
            raise FileNotFoundError(f"no file for {name} below {self.root}")
        if name == "vectors":
            return read_vectors(self.spark, path)
        df = tables.read_csv(self.spark, path)
        if name == "topics_dist":
            return tables.document_topics(df)
        if name == "topic_words":
            return tables.topic_words(df, df.columns[0])
        if name == "termset":
            return tables.termset(df)
        if name == "metadata":
            return metadata_table(df)
        return df

    def register(self) -> list[str]:
        """Makes a view of each table that is there."""
        names = list(self.available())
        for n in names:
            self.table(n).createOrReplaceTempView(n)
        return names


def metadata_table(df: DataFrame) -> DataFrame:
    """A metadata table with its id as text in `doc_id`."""
    name = find_column(df.columns, ROLES["id"]) or df.columns[0]
    return df.withColumn("doc_id", F.col(f"`{name}`").cast("string"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a model's folder with parquet, or of a file of word2vec's formats (text, .bin, .gz)."""
    if path.lower().endswith((".txt", ".vec", ".bin", ".gz")):
        return read_word2vec(spark, path)
    if path.lower().endswith((".model", ".kv", ".wordvectors")):
        raise ValueError("a pickled model; save its vectors in word2vec's format")
    return spark.read.parquet(f"{path}/vectors").select("word", F.col("vector").cast("array<double>").alias("vector"))


def read_interval_files(spark: SparkSession, root: str, stage: str = "gen") -> DataFrame:
    """The corpus files of a stage, with the interval that each file's name has (null for the whole corpus)."""
    files = find_files(spark, root, f"korpus_{stage}*.csv")
    parts = [tables.with_interval(tables.read_corpus_csv(spark, f)) for f in files]
    if not parts:
        raise FileNotFoundError(f"no corpus of stage {stage} below {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
