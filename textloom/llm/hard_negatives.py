"""Hard-negative mining: for each anchor its best positives, and for each the best negatives within a window of its score.

Every partition packs its rows into blocks, sorted by label and stored once. Anchors go out in
waves of about WAVE rows, which is all that is ever broadcast or collected. A wave passes over
the blocks twice. The first pass multiplies the anchors of each label with the block's rows of
that label and merges a running list of k positives an anchor; a task returns at most k rows an
anchor, and the lists of tasks are merged by anchor. The second pass gets the anchors with
their positives' scores, multiplies them with whole blocks, and merges for each positive the
best rows of other labels whose score lies in the window. Products are float64 where that holds
every sum exactly (below 2^53), else unbounded integers. Work is anchors times rows, as the
results ask for; a label with much of the table is as many blocks as any other rows, and no
task sees a label or an anchor whole.

Rows: rows with a null vec_id or label, a null vector, or null or non-finite components take
no part. Vectors of fewer dimensions than another count as padded with zeros. Repeated rows are
candidates each and may fill several places; each anchor row has results of its own; rows
with the vec_id of an anchor are not among its candidates. Ties go to the smaller vec_id. An
anchor without positives, or a positive with no row in its window (so is one with a negative
score), gives no rows. A score in the result that doesn't fit a long is an error. An empty
table gives an empty result. Columns other than vec_id, embedding and label play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch_path, table, written
from .voronoi_knn import _best, _loaded, _matrix, _stored

BLOCK = 8192
#: Anchors of a wave, about: 16,384 of 64 dimensions are 8 MB.
WAVE = 16384
TILE = 128
_LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v array<double>) of the rows that take part: floor(scale * x) of each component."""
    x = F.col("embedding").cast("array<double>")
    inf = F.lit(float("inf"))
    fine = F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == inf))
    # from 2**53 on every double is whole
    floor = F.transform(x, lambda e: F.when(F.abs(e * scale) < 2.0**53, F.floor(e * scale).cast("double")).otherwise(e * scale))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), floor.alias("v"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: 64-bit where a factor of 100 still fits, else unbounded."""
    dims = min(q.shape[1], x.shape[1])
    q, x = q[:, :dims], x[:, :dims]
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, dims) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return np.array([[int(c) for c in r] for r in q], object).reshape(len(q), dims) @ np.array([[int(c) for c in r] for r in x], object).reshape(len(x), dims).T


class Best:
    """Running lists of the k best (score, id) by key."""

    def __init__(self, k: int):
        self.k, self.lists = k, {}

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if key in self.lists:
            scores, ids = (np.concatenate(both) for both in zip(self.lists[key], (scores, ids), strict=True))
        at = _best(scores, ids, self.k)
        self.lists[key] = scores[at], ids[at]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        rows = [(*key, int(i), int(s)) for key, (scores, ids) in self.lists.items() for s, i in zip(scores, ids, strict=True)]
        if any(not _LONG.min <= r[-1] <= _LONG.max for r in rows):
            raise OverflowError("a score doesn't fit a long")
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def packed(rows: DataFrame) -> DataFrame:
    """The blocks of each partition, stored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out() -> pa.RecordBatch:
            both = pa.Table.from_batches(held).combine_chunks()
            ids, labels = (both.column(c).to_numpy() for c in (0, 1))
            order = np.argsort(labels, kind="stable")
            v = both.column(2).chunk(0)
            x = _matrix(v, max(1, pa.compute.max(pa.compute.list_value_length(v)).as_py()))[order]
            values = [len(ids), x.shape[1], ids[order].tobytes(), labels[order].tobytes(), _stored(x)]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([a], k) for a, k in zip(values, kinds, strict=True)], names=["n", "dims", "ids", "labels", "x"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == BLOCK:
                    yield out()
                    held, count = [], 0
        if count:
            yield out()

    return written(rows.mapInArrow(pack, "n int, dims int, ids binary, labels binary, x binary"), "blocks")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), _loaded(row["x"], row["n"], row["dims"])


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    A negative's score is between low and high hundredths of the positive's. is_anchor and
    label are expressions over the table's columns.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, label, scale)
    blocks = packed(rows)
    # t: a number of each anchor row, stored once
    anchors = cut(rows.filter(is_anchor).withColumn("t", F.monotonically_increasing_id()))
    waves = max(1, -(-anchors.count() // WAVE))
    path = scratch_path(spark, "negatives")
    for w in range(waves):
        wave = anchors.filter(F.pmod(F.xxhash64("t"), F.lit(waves)) == w).orderBy("t").collect()
        dims = max([1, *(len(r.v) for r in wave)])
        q = np.zeros((len(wave), dims))
        for i, r in enumerate(wave):
            q[i, : len(r.v)] = r.v
        q_ids, q_labels = (np.array([r[c] for r in wave], np.int64) for c in ("vec_id", "label"))
        sent = spark.sparkContext.broadcast((q, q_ids, q_labels))

        def same_label(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, q_ids, q_labels = sent.value
            best = Best(positives)
            for ids, labels, x in unpacked(batches):
                for each in np.unique(labels):
                    s, e = np.searchsorted(labels, each), np.searchsorted(labels, each, "right")
                    who = np.flatnonzero(q_labels == each)
                    for tile in (who[i : i + TILE] for i in range(0, len(who), TILE)):
                        for a, scores in zip(tile, products(q[tile], x[s:e]), strict=True):
                            others = ids[s:e] != q_ids[a]
                            best.add((a,), scores[others], ids[s:e][others])
            yield best.batch(["a", "id", "score"])

        turn = Window.partitionBy("a").orderBy(F.desc("score"), "id")
        found = blocks.mapInArrow(same_label, "a long, id long, score long").withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= positives)
        windows = {}  # anchor -> [(rank, positive's score)]; at most `positives` an anchor of the wave
        chosen = found.collect()
        for r in chosen:
            windows.setdefault(r.a, []).append((r.r, r.score))
        sent_windows = spark.sparkContext.broadcast(windows)

        def other_labels(batches: Iterator[pa.RecordBatch], sent=sent, sent_windows=sent_windows) -> Iterator[pa.RecordBatch]:
            (q, q_ids, q_labels), windows = sent.value, sent_windows.value
            who = np.array(sorted(windows), np.int64)
            best = Best(negatives)
            for ids, labels, x in unpacked(batches):
                for tile in (who[i : i + TILE] for i in range(0, len(who), TILE)):
                    for a, scores in zip(tile, products(q[tile], x), strict=True):
                        others = (labels != q_labels[a]) & (ids != q_ids[a])
                        scores, own = scores[others], ids[others]
                        for r, p in windows[a]:
                            within = (100 * scores >= low * p) & (100 * scores <= high * p)
                            best.add((a, r), scores[within], own[within])
            yield best.batch(["a", "r", "negative_id", "negative_score"])

        turn = Window.partitionBy("a", "r").orderBy(F.desc("negative_score"), "negative_id")
        mined = blocks.mapInArrow(other_labels, "a long, r long, negative_id long, negative_score long").withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= negatives)
        pairs = spark.createDataFrame([(r.a, r.r, int(q_ids[r.a]), r.id, r.score) for r in chosen], "a long, r long, anchor_id long, positive_id long, positive_score long")
        out = mined.join(F.broadcast(pairs), ["a", "r"])
        out.select("anchor_id", "positive_id", F.col("r").cast("int").alias("positive_rank"), "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        sent.destroy()
        sent_windows.destroy()
    return spark.read.schema("anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long").parquet(path)


def op13(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS t, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.t, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT t, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY t ORDER BY score DESC, id)::INT AS positive_rank FROM s WHERE same) WHERE positive_rank <= 5)
SELECT anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score
FROM (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.t, positive_rank ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s USING (t) WHERE NOT same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score) WHERE rank <= 10
"""
