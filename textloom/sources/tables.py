"""Delimited files, word lists, JSON vocabularies, model output formats, configuration."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
from itertools import islice
from pathlib import Path
from statistics import mode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..operators.corpus import ROLES, find_column

#: Separators that are tried, and what of a file is looked at.
SEPARATORS = (";", ",", "\t", "|")
SAMPLE_CHARS, SAMPLE_RECORDS = 128 * 1024, 25


def _regularity(sample: str, sep: str, records: int) -> tuple[float, int]:
    """How regular the first records are if `sep` parts them: the share with the commonest number of fields, and that number. Nothing (0, 0) unless two records have two fields or more."""
    read = csv.reader(io.StringIO(sample), delimiter=sep)
    try:
        widths = [len(r) for r in islice(filter(None, read), records)]
    except csv.Error:
        return 0.0, 0
    usual = mode(widths) if len(widths) > 1 else 0
    return (round(widths.count(usual) / len(widths), 4), usual) if usual > 1 else (0.0, 0)


def detect_delimiter(sample: str, records: int = SAMPLE_RECORDS) -> str:
    """The separator that makes the first records most regular (of equals the one with more fields, then the first in SEPARATORS); else csv's own guess, else a semicolon."""
    sample = sample[:SAMPLE_CHARS].lstrip("\ufeff")
    found = {sep: _regularity(sample, sep, records) for sep in SEPARATORS}
    if max(found.values()) > (0.0, 0):
        return max(SEPARATORS, key=found.__getitem__)
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(SEPARATORS)).delimiter
    except csv.Error:
        return SEPARATORS[0]


def head(spark: SparkSession, path: str, lines: int = 400) -> str:
    """The first lines of a file of any store, without reading on."""
    return "\n".join(r.value for r in spark.read.text(path).limit(lines).collect())


def read_csv(spark: SparkSession, path: str, sep: str | None = None, infer: bool = False) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line feeds. Header cells are trimmed."""
    sep = sep or detect_delimiter(head(spark, path))
    df = spark.read.csv(path, header=True, multiLine=True, sep=sep, quote='"', escape='"', inferSchema=infer)
    return df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first separator that gives two columns or more, one of them with the content."""
    for sep in dict.fromkeys([detect_delimiter(head(spark, path)), *SEPARATORS]):
        df = read_csv(spark, path, sep)
        if len(df.columns) >= 2 and find_column(df.columns, ROLES["content"]):
            return df
    raise ValueError(f"{path} has no content column under any separator")


@F.pandas_udf(types.StringType())
def decode_bytes(data: pd.Series) -> pd.Series:
    """UTF-8 with or without a byte-order mark, else Latin-1."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("utf-8-sig")
        except UnicodeDecodeError:
            return bytes(b).decode("latin-1")

    return data.map(one)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file_name, text) of the files of a folder and its subfolders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), decode_bytes("content").alias("text"))


def with_interval(df: DataFrame) -> DataFrame:
    """Adds `interval`: the _1800-1850 of the name of the file that a row comes from, or null."""
    return df.withColumn("interval", F.nullif(F.regexp_extract(F.input_file_name(), r"_(\d{4}-\d{4})\.[^/]*$", 1), F.lit("")))


def unpivot(df: DataFrame, id_: str, name: str, value: str) -> DataFrame:
    """A wide table as (id, name, value) of its non-null cells."""
    others = [c for c in df.columns if c != id_]
    long = df.select(F.col(f"`{id_}`").cast("string").alias(id_), *[F.col(f"`{c}`").cast("string").alias(c) for c in others]).unpivot([id_], others, name, value)
    return long.filter(F.col(value).isNotNull())


def document_topics(df: DataFrame, id_: str | None = None, strip_txt: bool = False) -> DataFrame:
    """(doc_id, topic, weight) of a wide document-topic table."""
    id_ = id_ or find_column(df.columns, ROLES["id"]) or df.columns[0]
    doc = F.regexp_replace(F.col(id_), r"(?i)\.txt$", "") if strip_txt else F.col(id_)
    return unpivot(df, id_, "topic", "weight").select(doc.alias("doc_id"), "topic", F.col("weight").try_cast("double").alias("weight"))


def topic_words(df: DataFrame, id_: str = "Topic") -> DataFrame:
    """(topic, pos, word) of a wide topic-word table whose columns are positions."""
    return unpivot(df, id_, "pos", "word").select(F.col(id_).alias("topic"), F.col("pos").cast("int").alias("pos"), F.trim("word").alias("word")).filter("word <> ''")


#: Names that the column of a topic table's topics may have.
TOPIC_COLUMNS = ["Topic", "topic", "Topic_ID", "topic_id", "ID", "id"]


def topic_table(df: DataFrame) -> DataFrame:
    """A topic table with its topics, as text, first and then all its word columns as they are."""
    name = next((c for c in TOPIC_COLUMNS if c in df.columns), df.columns[0])
    return df.select(F.col(f"`{name}`").cast("string").alias(name), *[F.col(f"`{c}`") for c in df.columns if c != name])


def termset(df: DataFrame) -> DataFrame:
    """(tag, ord, word) of a ragged table with a column per tag; trailing notes in parentheses go."""
    from ..functions import text as T

    rows = df.withColumn("__row", F.monotonically_increasing_id())
    long = rows.unpivot(["__row"], df.columns, "tag", "word").select("tag", "__row", T.strip_note(F.col("word")).alias("word")).filter("word <> ''")
    return long.withColumn("ord", F.row_number().over(Window.partitionBy("tag").orderBy("__row"))).select("tag", "ord", "word")


def tfidf_totals(df: DataFrame, terms: list[str]) -> DataFrame:
    """(term, total) of a wide TF-IDF table with a column per term."""
    sums = df.agg(*[F.sum(F.coalesce(F.col(f"`{t}`").try_cast("double"), F.lit(0.0))).alias(t) for t in terms])
    return sums.unpivot([], terms, "term", "total")


#: Names and patterns of columns that are metadata, and of numbers that are no terms.
METADATA_NAMES = [
    "_id", "id", "doc_id", "filename",
    "author", "author_prename", "author_surname", "author_surname_norm", "author_address", "author_address_geo",
    "editor_prename", "editor_surname",
    "title", "title_norm", "title_addition",
    "source", "journal", "magazine",
    "year", "year_first", "year_final", "Jahr_final",
    "date", "datum", "year_pub", "erscheinungsjahr",
    "author_forename", "editor_forename",
    "gnd", "wikidata", "idno", "ref", "url",
    "volume", "edition", "issue", "pages", "pages_exzerpt",
    "textclass", "genre", "address", "address_geo",
    "lang", "language", "note", "archive",
    "female_education",
    "content", "text", "clean_text", "content_min", "content_lem", "content_stop", "content_gen",
]
METADATA_PATTERN = r"(?i)^(author|editor|autor|verfasser|herausgeber|hrsg)_|_(forename|surname|prename|vorname|nachname|name|norm|geo|addition|first|final|exzerpt|address)$"
NUMBER_PATTERN = r"(?i)(^|_)(id|gnd|wikidata|idno|jahr|year|datum|date|band|volume|seite|page|pages|nr|nummer|index|ref|url)$"


def names_a_term(column: str, metadata: list[str] = (), patterns: bool = True) -> bool:
    """Whether a matrix column may be a term by its name: not one of the metadata or the known names, nor (with `patterns`) like one, nor like an id, year or page."""
    if column.strip().lower() in {m.strip().lower() for m in (*metadata, *METADATA_NAMES)}:
        return False
    return not (patterns and (re.search(METADATA_PATTERN, column) or re.search(NUMBER_PATTERN, column)))


def term_columns(df: DataFrame, metadata: list[str], share: float = 0.8, patterns: bool = True) -> list[str]:
    """Columns of a wide matrix that are terms: by their names (`names_a_term`), and numeric for at least `share` of their values."""
    rest = [c for c in df.columns if names_a_term(c, metadata, patterns)]
    if not rest:
        return []
    ok = df.agg(*[(F.count(F.col(f"`{c}`").try_cast("double")) >= share * F.count(F.col(f"`{c}`"))).alias(c) for c in rest]).first()
    return [c for c in rest if ok[c]]


def mallet_document_topics(lines: DataFrame, n_topics: int) -> DataFrame:
    """(doc_id, topic, weight) of lines (value) `index name weights`, the weights dense or pairs of topic and share, brought to the sum 1."""
    parts = F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+"))
    rows = lines.filter("value <> '' and value not like '#%'").select(parts.alias("p")).filter(F.size("p") >= 3)
    rows = rows.select(F.element_at("p", 2).alias("doc_id"), F.slice("p", 3, F.size("p")).alias("v"))
    dense = F.transform("v", lambda x, i: F.struct(i.cast("int").alias("topic"), x.cast("double").alias("weight")))
    half = F.floor(F.size("v") / 2).cast("int")
    pairs = F.when(half > 0, F.transform(F.sequence(F.lit(1), half), lambda i: F.struct(F.element_at("v", 2 * i - 1).cast("double").cast("int").alias("topic"), F.element_at("v", 2 * i).cast("double").alias("weight"))))
    cells = rows.select("doc_id", F.explode(F.when(F.size("v") == n_topics, dense).otherwise(pairs)).alias("c")).select("doc_id", "c.topic", "c.weight")
    cells = cells.filter((F.col("topic") >= 0) & (F.col("topic") < n_topics))
    total = F.sum("weight").over(Window.partitionBy("doc_id"))
    return cells.withColumn("weight", F.col("weight") / F.when(total == 0, 1.0).otherwise(total))


def mallet_topic_keys(lines: DataFrame) -> DataFrame:
    """(topic, pos, word) of lines (value) `topic weight words`."""
    rows = lines.filter("value <> '' and value not like '#%'").select(F.split("value", "\t", 3).alias("t"), F.split(F.trim("value"), r"\s+").alias("s"))
    tabbed = F.size("t") >= 3
    words = F.when(tabbed, F.filter(F.split(F.element_at("t", 3), r"\s+"), lambda x: x != "")).otherwise(F.slice("s", 3, F.size("s")))
    topic = F.when(tabbed, F.element_at("t", 1)).otherwise(F.element_at("s", 1))
    return rows.select(topic.cast("double").cast("int").alias("topic"), F.posexplode(words).alias("i", "word")).select("topic", (F.col("i") + 1).alias("pos"), "word")


def read_vocabulary(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(word, count, position) of the top words of a vocabulary file."""
    schema = "variant string, vocabulary_size long, total_tokens long, top_words array<array<string>>, full_vocab map<string, long>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    rows = df.select(F.posexplode("top_words").alias("i", "w")).select(F.element_at("w", 1).alias("word"), F.element_at("w", 2).cast("long").alias("count"), (F.col("i") + 1).alias("position"))
    return rows.filter(F.col("position") <= limit) if limit else rows


def load_config(path: str) -> dict:
    """A TOML or YAML file."""
    if Path(path).suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def roles_with(overrides: dict[str, list[str]]) -> dict[str, list[str]]:
    """The candidate lists with those of a project before them."""
    return {role: list(dict.fromkeys([*overrides.get(role, []), *names])) for role, names in ROLES.items()}


def load_replacements(path: str) -> list[tuple[str, str]]:
    return list(json.loads(Path(path).read_text(encoding="utf-8")).items())


def load_words(path: str, lower: bool = True) -> list[str]:
    """One word per line, or the column `term` of a CSV; a missing file is an empty list."""
    if not Path(path).exists():
        return []
    text = Path(path).read_text(encoding="utf-8")
    lines = text.splitlines()
    if lines and "term" in [c.strip() for c in re.split(r"[;,\t]", lines[0])]:
        sep = detect_delimiter(text) if len(re.split(r"[;,\t]", lines[0])) > 1 else ","
        words = [r["term"] for r in csv.DictReader(io.StringIO(text), delimiter=sep)]
    else:
        words = lines
    words = [w.strip() for w in words if w and w.strip()]
    return [w.lower() for w in words] if lower else words


#: Any of these in a rule makes it a regular expression.
_RULE_SIGNS = [r"\(\?", r"\[.+\]", r"\\b", r"\\B", r"\\d", r"\\w", r"\\s", r"[^\\]\*", r"[^\\]\+", r"[^\\]\?", r"\{\d+", r"^\^", r"\$$", r"[^\\]\|"]


def is_pattern(rule: str) -> bool:
    return any(re.search(sign, rule) for sign in _RULE_SIGNS)


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered rules, literal or regular expressions, each on what the one before gave. Python's own expressions, as rules may look around or refer to groups; those that don't compile are left out."""
    compiled: list[tuple[re.Pattern | str, str]] = []
    for rule, value in rules:
        try:
            compiled.append((re.compile(rule) if is_pattern(rule) else rule, value))
        except re.error:
            continue

    @F.pandas_udf(types.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            for rule, value in compiled:
                t = t.replace(rule, value) if isinstance(rule, str) else rule.sub(value, t)
            return t

        return texts.map(one)

    return run(text)
