"""Exploration of a corpus: frequencies, concordances, collocations, trends, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EPSILON = 1e-12


def term_overview(counts: DataFrame, means: DataFrame) -> DataFrame:
    """Counts and mean TF-IDF of terms that have either. counts: term, n; means: term, mean."""
    return counts.join(means, "term", "full").select("term", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def document_frequency(corpus: DataFrame, terms: list[str], scale: int = 10_000, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, count, length, density) of documents with a hit of any term, literal or a regular expression."""
    terms = [t.strip() for t in terms if t.strip()]
    if not terms:
        raise ValueError("no terms")
    hits = T.contains_words(F.col("content"), terms, regex, case_sensitive)
    rows = corpus.select("doc_id", hits.alias("count"), T.token_count(F.col("content"), T.WORD).alias("length"))
    return rows.filter("count > 0").withColumn("density", F.when(F.col("length") > 0, F.round(F.col("count") / F.col("length") * scale, 2)).otherwise(0.0))


def concordance(corpus: DataFrame, term: str, context: int = 50, keep: tuple[str, ...] = (), **flags) -> DataFrame:
    """(doc_id, kept columns, hit, left, match, right), hits numbered from 1 in each document."""
    hits = corpus.select("doc_id", *keep, F.posexplode(T.kwic(F.col("content"), term, context, **flags)).alias("i", "h"))
    return hits.select("doc_id", *keep, (F.col("i") + 1).alias("hit"), "h.left", "h.match", "h.right")


def with_metadata(rows: DataFrame, meta: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows with columns of their document, of a repeated document those of the first row in `order`."""
    turn = Window.partitionBy("doc_id").orderBy(order)
    first = meta.withColumn("__r", F.row_number().over(turn)).filter("__r = 1").select("doc_id", *columns)
    return rows.join(first, "doc_id", "left")


def first_hits(hits: DataFrame, most: int) -> DataFrame:
    return hits.orderBy("doc_id", "hit").limit(most)


def hits_by(hits: DataFrame, author: str) -> DataFrame:
    """Hits with the number of all hits of the same author."""
    return hits.withColumn("author_hits", F.count("*").over(Window.partitionBy(author)))


def windows(corpus: DataFrame, targets: list[str], window: int, *keep: str, ngram: int = 1, tokens: Column | None = None) -> DataFrame:
    """One row per token (or run of `ngram` tokens that doesn't cross the target) within `window` tokens of a target in the same document: kept columns, target, collocate."""
    ts = corpus.select("doc_id", *keep, (T.tokens(F.col("content")) if tokens is None else tokens).alias("ts"))
    ts = ts.filter(F.arrays_overlap("ts", F.array(*[F.lit(t) for t in targets])))
    at = ts.select("doc_id", *keep, "ts", F.explode(F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: F.element_at("ts", i).isin(targets))).alias("i"))
    low = F.greatest(F.col("i") - window, F.lit(1))
    sides = F.slice("ts", low, F.col("i") - low), F.slice("ts", F.col("i") + 1, window)
    near = F.concat(*(sides if ngram == 1 else [T.ngrams(x, ngram) for x in sides]))
    return at.select("doc_id", *keep, F.element_at("ts", F.col("i")).alias("target"), F.explode(near).alias("collocate"))


def collocations(corpus: DataFrame, targets: list[str], window: int = 5, min_freq: int = 3, top: int = 100, measure: str = "freq", ngram: int = 1) -> DataFrame:
    """(target, collocate, freq, score): score is the frequency or the pointwise mutual information over all tokens (or runs of `ngram` tokens)."""
    ts = T.tokens(F.col("content"))
    counts = corpus.select(F.explode(ts if ngram == 1 else T.ngrams(ts, ngram)).alias("collocate")).groupBy("collocate").agg(F.count("*").alias("n"))
    words = corpus.select(F.explode(F.filter(ts, lambda t: t.isin(targets))).alias("target"))
    of_target = words.groupBy("target").agg(F.count("*").alias("n_target"))  # a row per target
    return score_collocations(windows(corpus, targets, window, ngram=ngram), counts, of_target, min_freq, top, measure)


def score_collocations(pairs: DataFrame, counts: DataFrame, of_target: DataFrame, min_freq: int, top: int, measure: str) -> DataFrame:
    """`collocations` of the pairs (target, collocate); counts: collocate, n; of_target: target, n_target."""
    pairs = pairs.groupBy("target", "collocate").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_freq)
    if measure == "pmi":
        total = counts.agg(F.sum("n").alias("total"))
        known = pairs.join(counts, "collocate").join(F.broadcast(of_target), "target").crossJoin(F.broadcast(total))
        joint, apart = F.col("freq") / F.col("total"), F.col("n") / F.col("total") * F.col("n_target") / F.col("total")
        score = F.log2(F.greatest(joint, F.lit(EPSILON)) / F.greatest(apart, F.lit(EPSILON)))
        pairs = known.select("target", "collocate", "freq", F.round(score, 6).alias("score"))
    else:
        pairs = pairs.withColumn("score", F.col("freq").cast("double"))
    turn = Window.partitionBy("target").orderBy(F.desc("score"), "collocate")
    return pairs.withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= top).drop("r")


def collocation_documents(corpus: DataFrame, target: str, collocate: str, window: int = 5) -> DataFrame:
    """(doc_id, count) of a pair within the window."""
    return windows(corpus, [target], window).filter(F.col("collocate") == collocate).groupBy("doc_id").agg(F.count("*").alias("count"))


def ngram_counts(corpus: DataFrame, n: int, top: int) -> DataFrame:
    rows = corpus.select(F.explode(T.ngrams(T.tokens(F.col("content")), n)).alias("ngram"))
    return rows.groupBy("ngram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ngram").limit(top)


def year_spine(rows: DataFrame) -> DataFrame:
    """Every year from the first to the last one."""
    return rows.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))


def _equals(term: str):
    return lambda x: x == term


def word_trends(corpus: DataFrame, terms: list[str], scale: int = 1_000_000) -> DataFrame:
    """(term, year, n, per_scale): counts per year, and per million of the year's tokens; years without hits count as zeros."""
    counted = corpus.filter("year is not null").select("year", T.tokens(F.col("content")).alias("ts"))
    sums = counted.select("year", F.size("ts").cast("long").alias("total"), *[F.size(F.filter("ts", _equals(t))).cast("long").alias(f"t{i}") for i, t in enumerate(terms)])
    sums = sums.groupBy("year").agg(F.sum("total").alias("total"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(terms))])
    spine = year_spine(sums).join(sums, "year", "left")
    pairs = ", ".join(f"'{t}', t{i}" for i, t in enumerate(terms))
    rows = spine.selectExpr("year", "total", f"stack({len(terms)}, {pairs}) as (term, n)")
    n = F.coalesce("n", F.lit(0))
    return rows.select("term", "year", n.cast("long").alias("n"), F.when(F.col("total") > 0, F.round(n / F.col("total") * scale, 6)).otherwise(0.0).alias("per_scale"))


def moving_average(rows: DataFrame, value: str, window: int, by: list[str], order: str = "year") -> DataFrame:
    """Centred mean of `window` rows; at the ends of those that there are."""
    low, high = -(window // 2), (window - 1) // 2
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(low, high)
    return rows.withColumn("smooth", F.round(F.avg(value).over(frame), 6))


def stage_summary(corpus: DataFrame, stages: dict[str, str]) -> DataFrame:
    """(stage, documents, tokens, tokens_per_doc) of each content column."""
    parts = [corpus.select(F.lit(name).alias("stage"), T.token_count(F.col(column)).alias("n")) for name, column in stages.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("stage").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 1).alias("tokens_per_doc"))


def with_tokens(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("tokens", T.token_count(F.col("content")))


def year_counts(corpus: DataFrame) -> DataFrame:
    return with_tokens(corpus).filter("year is not null").groupBy("year").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def metadata_frequency(corpus: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, documents, tokens) of all columns in one pass."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    rows = with_tokens(corpus).selectExpr("tokens", f"stack({len(columns)}, {pairs}) as (column, value)")
    return rows.groupBy("column", "value").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def milestones(corpus: DataFrame, n: int = 5) -> DataFrame:
    """(milestone, year_from, year_to, tokens): chronological sections of about equal tokens.

    A section ends with the document that reaches the next multiple of total / n, and a
    document ends one section at most: boundary k stands at the larger of the first document
    that reaches its target and the one after boundary k - 1. Documents are numbered year by
    year, so that no task orders more than a year; only the n boundaries meet in one.
    """
    rows = with_tokens(corpus).filter("year is not null").select("year", "doc_id", "tokens")
    years = rows.groupBy("year").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.select("year", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    total = rows.agg(F.sum("tokens").alias("total"))
    by = Window.partitionBy("year").orderBy("doc_id")
    cum = F.col("t0") + F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(F.broadcast(years), "year").crossJoin(F.broadcast(total)).select("year", "tokens", "total", (F.col("c0") + F.row_number().over(by)).alias("i"), cum.alias("cum"))
    reached = [F.floor(x * n / F.greatest(F.col("total"), F.lit(1))) for x in (F.col("cum") - F.col("tokens"), F.col("cum"))]
    ends = placed.withColumn("k0", reached[0] + 1).withColumn("k1", F.least(reached[1], F.lit(n - 1))).filter("k0 <= k1").select("i", F.explode(F.sequence("k0", "k1")).alias("k"))
    ends = ends.select("k", (F.col("k") + F.max(F.col("i") - F.col("k")).over(Window.orderBy("k"))).alias("b"))
    ends = ends.agg(F.collect_list("b").alias("bs"))  # n - 1 numbers
    section = F.size(F.filter("bs", lambda b: b < F.col("i"))) + 1
    return placed.crossJoin(F.broadcast(ends)).groupBy(section.alias("milestone")).agg(F.min("year").alias("year_from"), F.max("year").alias("year_to"), F.sum("tokens").alias("tokens"))
