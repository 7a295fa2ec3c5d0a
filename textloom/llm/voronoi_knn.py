"""Exact top-k search by inner product, as a Voronoi kNN join.

Every vector is dealt to the nearest of a few pivots. A pivot's group has a summary
(size, radius, number of blocks); a group is kept in blocks of bounded size, so that a
pivot with a third of all vectors is solved by many tasks. First the queries that live
in a block are solved within it, which gives each a score that its k-th best is at least.
With pivot p and radius r, no member x of a group scores above q.p + |q| r; a group
whose bound is below a query's score so far can't add to its result, and only the blocks
of the other groups get a copy of the query, in chunks of queries of one group. There
they are solved by one matrix product per chunk and block, and the best k of all partial
results are kept. Bounds are in float64 with a margin for rounding; scores are exact: they
are computed in float64 only where it holds every sum, else in 64-bit or in unbounded
integers.

Rows: vectors that are null or hold null or non-finite components take no part; every
other one does. A score among the k best of a block that doesn't fit a long, or a component
that is infinite once scaled, is an error. Vectors of fewer dimensions than the longest
count as padded with zeros; an empty vector is the zero vector. A null vec_id takes no
part. Each row is a candidate of its own, so that a repeated row can fill several ranks,
and each query row has a result of its own; rows with the vec_id of a query are not among
its candidates. Ties go to the smaller vec_id. An empty table gives an empty result. Columns
other than vec_id and embedding play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK = 2048
CHUNK = 256
#: Pivots: the square root of the number of vectors, up to this bound; they and their summaries are broadcast.
MAX_PIVOTS = 2048
_LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: floor(scale * x) of each component, whole numbers."""
    x = F.col("embedding").cast("array<double>")
    inf = F.lit(float("inf"))
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == inf))
    # from 2**53 on every double is whole
    floor = F.transform(x, lambda e: F.when(F.abs(e * scale) < 2.0**53, F.floor(e * scale).cast("double")).otherwise(e * scale))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), floor.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest pivot (the first of equals) and the distance to it."""
    gap = (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    at = gap.argmin(1)
    return at, np.sqrt(((x - pivots[at]) ** 2).sum(1))


def _stored(x: np.ndarray) -> bytes:
    """Rows as 32-bit integers if they fit, else as float64."""
    return x.astype("<i4" if np.abs(x).max(initial=0) < 2**31 else "<f8").tobytes()


def _loaded(raw: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * rows * dims else "<f8").reshape(rows, dims).astype(np.float64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: highest score, then smallest id."""
    place = np.arange(len(scores))
    if len(scores) > 4 * k and scores.dtype != object:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return place[np.lexsort((-ids[place], scores[place]))[::-1][:k]]


def _solve(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of each query among x: places of the queries, vector ids, scores."""
    if not len(q) or not len(x):
        return tuple(np.zeros((3, 0), np.int64))
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2.0**53:
        scores = q @ x.T
    elif most < 2.0**62:
        scores = q.astype(np.int64) @ x.astype(np.int64).T
    else:
        scores = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
    out_q, out_v, out_s = [], [], []
    for i, row in enumerate(scores):
        others = ids != q_ids[i]  # a query is no candidate of its own
        own, row = (ids, row) if others.all() else (ids[others], row[others])
        best = _best(row, own, k)
        out_q.append(np.full(len(best), i))
        out_v.append(own[best])
        if row.dtype == object and any(not _LONG.min <= s <= _LONG.max for s in row[best]):
            raise OverflowError(f"a score of query {q_ids[i]} doesn't fit a long")
        out_s.append(row[best].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def knn_join(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which is_query (over vec_id) holds."""
    spark = vectors.sparkSession
    data = cut(quantised(vectors, scale))
    known = data.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    n, dims = known.n, max(1, known.dims)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = min(MAX_PIVOTS, max(1, int(n**0.5) // 4))
    # rows with the least hash of their id, of distinct vectors: at most MAX_PIVOTS rows reach the driver
    rows = data.select("v", F.xxhash64(F.lit(7), "vec_id").alias("h")).orderBy("h").limit(wanted).collect()
    pivots = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        pivots[i, : len(r.v)] = r.v
    pivots = np.unique(pivots, axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = _nearest(_matrix(batch.column(1), dims), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "g", "far"])

    # t: a number of each row, stored once
    dealt = cut(data.mapInArrow(deal, "vec_id long, v array<double>, g int, far double").withColumn("query", is_query).withColumn("t", F.monotonically_increasing_id()))
    # one row per pivot, of which there are MAX_PIVOTS at most
    summary = dealt.groupBy("g").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("g").collect()
    used = np.array([s.g for s in summary])
    radius = np.array([s.far for s in summary])
    blocks = np.array([-(-s.n // BLOCK) for s in summary])
    groups = spark.createDataFrame([(int(s.g), int(b)) for s, b in zip(summary, blocks, strict=True)], "g int, blocks int")
    placed = dealt.join(F.broadcast(groups), "g").withColumn("b", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))

    local_schema = "g int, b int, n long, q_ids binary, ts binary, q binary, ids binary, x binary, best_t array<long>, best_q array<long>, best_v array<long>, best_s array<long>, floor array<double>"

    def local(key: tuple, table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v").combine_chunks(), dims)
        ids, ts = (table.column(c).to_numpy() for c in ("vec_id", "t"))
        asks = table.column("query").to_numpy().astype(bool)
        q, q_ids, ts = x[asks], ids[asks], ts[asks]
        out_q, out_v, out_s = _solve(q_ids, q, ids, x, k)
        # the k-th best of a query within its block; copies count, as they do in the result
        floor = np.full(len(q), -np.inf)
        last = np.flatnonzero(np.diff(out_q, append=-1) != 0)
        full = last[np.bincount(out_q, minlength=len(q))[out_q[last]] == k]
        floor[out_q[full]] = out_s[full]
        one = {"g": [key[0].as_py()], "b": [key[1].as_py()], "n": [len(x)], "q_ids": [q_ids.tobytes()], "ts": [ts.tobytes()], "q": [_stored(q)], "ids": [ids.tobytes()], "x": [_stored(x)], "best_t": [ts[out_q]], "best_q": [q_ids[out_q]], "best_v": [out_v], "best_s": [out_s], "floor": [floor]}
        return pa.table(one, schema=pa.schema([("g", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("q_ids", "ts", "q", "ids", "x")], *[(c, pa.list_(pa.int64())) for c in ("best_t", "best_q", "best_v", "best_s")], ("floor", pa.list_(pa.float64()))]))

    packed = cut(placed.select("g", "b", "vec_id", "v", "query", "t").groupBy("g", "b").applyInArrow(local, local_schema))

    bounds = spark.sparkContext.broadcast((used, pivots[used], radius))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of a block's queries with each group that may hold a better candidate of at least one of them."""
        schema = pa.schema([*[(c, pa.int32()) for c in ("g", "from_g", "from_b")], *[(c, pa.binary()) for c in ("q_ids", "ts", "q")]])
        use, centre, far = bounds.value
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ts = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "ts"))
                q = _loaded(row["q"], len(q_ids), dims)
                floor = np.array(row["floor"], dtype=np.float64)[:, None]
                with np.errstate(over="ignore", invalid="ignore"):
                    size = np.sqrt((q**2).sum(1))[:, None]
                    slack = 1e-9 * size * (np.sqrt((centre**2).sum(1)) + far)[None, :] + 1e-6
                    able = ~(q @ centre.T + size * far[None, :] + slack < floor)  # a bound that isn't a number prunes nothing
                for j in range(len(use)):
                    hit = np.flatnonzero(able[:, j])
                    for s in range(0, len(hit), CHUNK):
                        part = hit[s : s + CHUNK]
                        values = [use[j], row["g"], row["b"], q_ids[part].tobytes(), ts[part].tobytes(), _stored(q[part])]
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    asked = packed.filter(F.length("q_ids") > 0).select("g", "b", "q_ids", "ts", "q", "floor").mapInArrow(send, "g int, from_g int, from_b int, q_ids binary, ts binary, q binary")
    # a chunk goes to every block of the group but its own: that one has been solved
    asked = asked.join(F.broadcast(groups), "g").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter((F.col("g") != F.col("from_g")) | (F.col("b") != F.col("from_b")))
    pairs = asked.select("g", "b", "q_ids", "ts", "q").join(packed.select("g", "b", "n", "ids", "x"), ["g", "b"])

    def remote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, ts, ids = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "ts", "ids"))
                at, v, s = _solve(q_ids, _loaded(row["q"], len(q_ids), dims), ids, _loaded(row["x"], row["n"], dims), k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ts[at], q_ids[at], v, s)], names=["t", "query_id", "vec_id", "score"])

    far_part = pairs.mapInArrow(remote, "t long, query_id long, vec_id long, score long")
    near_part = packed.select(F.explode(F.arrays_zip("best_t", "best_q", "best_v", "best_s")).alias("z")).select(F.col("z.best_t").alias("t"), F.col("z.best_q").alias("query_id"), F.col("z.best_v").alias("vec_id"), F.col("z.best_s").alias("score"))
    turn = Window.partitionBy("t").orderBy(F.desc("score"), "vec_id")
    ranked = near_part.unionByName(far_part).withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return knn_join(vectors, F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (SELECT row_number() OVER () AS t, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.t, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
