"""Quality of topics: diversity and coherence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import kept

EPSILON = 1e-12


def diversity(topic_word: DataFrame, k: int = 25) -> DataFrame:
    """One row: distinct words among the first k of all topics, by their number."""
    top = topic_word.filter(F.col("pos") <= k)
    return top.agg(F.round(F.countDistinct("word") / F.count("*"), 6).alias("diversity"))


def npmi(topic_word: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """(topic, npmi): mean normalised pointwise mutual information of the pairs of a topic's first k words.

    documents: doc_id, term. Pairs that never meet count -1. Only topic words are paired, in
    the documents that hold them.
    """
    top = topic_word.filter(F.col("pos") <= k).select("topic", "word").distinct()
    words = top.select("word").distinct()
    n = documents.agg(F.countDistinct("doc_id").alias("n"))
    here = documents.select("doc_id", F.col("term").alias("word")).distinct().join(F.broadcast(words), "word")
    single = here.groupBy("word").agg(F.count("*").alias("df"))
    wanted = top.select("topic", F.col("word").alias("a")).join(top.select("topic", F.col("word").alias("b")), "topic").filter("a < b")
    kinds = wanted.select("a", "b").distinct()
    sets = here.groupBy("doc_id").agg(F.collect_set("word").alias("ws"))
    met = sets.select(F.explode("ws").alias("a"), "ws").select("a", F.explode("ws").alias("b")).filter("a < b").join(F.broadcast(kinds), ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    rows = wanted.join(met, ["a", "b"], "left")
    rows = rows.join(single.select(F.col("word").alias("a"), F.col("df").alias("df_a")), "a", "left").join(single.select(F.col("word").alias("b"), F.col("df").alias("df_b")), "b", "left").crossJoin(F.broadcast(n))
    p = F.col("n_ab") / F.col("n")
    apart = (F.col("df_a") / F.col("n")) * (F.col("df_b") / F.col("n"))
    value = F.when(F.coalesce("n_ab", F.lit(0)) == 0, -1.0).otherwise(F.log(p / apart + EPSILON) / (-F.log(p + EPSILON)))
    return rows.groupBy("topic").agg(F.round(F.avg(value), 6).alias("npmi"))


def window_counts(documents: DataFrame, words: list[str], window: int) -> DataFrame:
    """(a, b, n): sliding windows of `window` tokens that hold both words, a = b included; a shorter document is one window. documents: doc_id, ts (tokens).

    Only the words' positions leave the documents' arrays. Between two positions where a word enters or
    leaves, windows hold the same words, so stretches of windows are counted, not windows; a task returns
    one count per pair of words.
    """
    places = F.filter(F.transform("ts", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: s["w"].isin(words))
    found = documents.select(F.greatest(F.size("ts") - (window - 1), F.lit(1)).alias("n"), places.alias("p")).filter(F.size("p") > 0)
    size = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(words, pa.string())
        total = np.zeros((size, size), np.int64)
        for batch in batches:
            code = pa.compute.index_in(batch.column("w").flatten(), value_set=names).to_numpy().astype(np.int64)
            at = batch.column("i").flatten().to_numpy()
            ends = np.cumsum(pa.compute.list_value_length(batch.column("w")).to_numpy())
            for n, a, b in zip(batch.column("n").to_pylist(), np.append(0, ends), ends, strict=False):
                total += together(code[a:b], at[a:b], n, window, size)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(total[a, b])], names=["a", "b", "n"])

    return found.select("n", "p.w", "p.i").mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def together(code: np.ndarray, at: np.ndarray, n: int, window: int, size: int) -> np.ndarray:
    """Windows of one document by pairs of words; `code` are words and `at` their positions, n windows begin at 0, 1, ..."""
    enter, leave = np.maximum(at - window + 1, 0), np.minimum(at + 1, n)
    edges = np.unique(np.concatenate([enter, leave]))
    out = np.zeros((size, size), np.int64)
    held = np.zeros(size, np.int64)
    step = max(1, 4_000_000 // size)
    for s in range(0, len(edges) - 1, step):
        part = edges[s : s + step]
        change = np.zeros((len(part), size), np.int64)
        for where, sign in ((enter, 1), (leave, -1)):
            mine = (where >= part[0]) & (where <= part[-1])
            np.add.at(change, (np.searchsorted(part, where[mine]), code[mine]), sign)
        counts = held + np.cumsum(change, 0)
        held = counts[-1]
        lengths = np.diff(np.append(part, edges[s + step : s + step + 1]))
        there = (counts > 0)[: len(lengths)].astype(np.float64)
        out += (there.T @ (there * lengths[:, None])).astype(np.int64)
    return out


def window_coherence(topic_word: DataFrame, documents: DataFrame, k: int = 10, window: int | None = None, measure: str = "c_v") -> DataFrame:
    """(topic, c_v): mean cosine of each word's NPMI vector with that of all the topic's words, or (topic, c_npmi): mean NPMI of the pairs of different words; co-occurrence in sliding windows (of 110 tokens, for c_npmi of 10). documents: doc_id, ts (tokens)."""
    window = window or (110 if measure == "c_v" else 10)
    top = topic_word.filter(F.col("pos") <= k).select("topic", "word").distinct()
    words = sorted(r.word for r in top.select("word").distinct().collect())  # k a topic
    met = kept(window_counts(documents, words, window))
    single = met.filter("a = b").select(F.col("a").alias("word"), F.col("n").alias("df"))
    n = documents.agg(F.sum(F.greatest(F.size("ts") - (window - 1), F.lit(1))).alias("n"))
    pairs = top.select("topic", F.col("word").alias("a")).join(top.select("topic", F.col("word").alias("b")), "topic").join(met.withColumnRenamed("n", "n_ab"), ["a", "b"], "left")
    pairs = pairs.join(single.select(F.col("word").alias("a"), F.col("df").alias("df_a")), "a").join(single.select(F.col("word").alias("b"), F.col("df").alias("df_b")), "b").crossJoin(F.broadcast(n))
    p = F.coalesce("n_ab", F.lit(0)) / F.col("n")
    value = F.log((p + EPSILON) / (F.col("df_a") / F.col("n") * F.col("df_b") / F.col("n"))) / (-F.log(p + EPSILON))
    if measure == "c_npmi":
        return pairs.filter("a <> b").select("topic", value.alias("v")).groupBy("topic").agg(F.round(F.avg("v"), 6).alias("c_npmi"))
    cells = pairs.select("topic", "a", "b", value.alias("v")).withColumn("sum_b", F.sum("v").over(Window.partitionBy("topic", "b")))
    cosine = cells.groupBy("topic", "a").agg((F.sum(F.col("v") * F.col("sum_b")) / (F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("sum_b") * F.col("sum_b"))) + EPSILON)).alias("c"))
    return cosine.groupBy("topic").agg(F.round(F.avg("c"), 6).alias("c_v"))
