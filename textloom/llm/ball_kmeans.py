"""Centroid clustering of integer vectors by Lloyd's rounds, filtered through ball trees.

Vectors stay in the partition that read them: each partition packs its rows into metric trees
of at most TREE vectors, stored once. A tree halves its rows at the median along the line
between two far points, down to leaves of LEAF rows; every node keeps its count, its integer
sum and the radius of the ball around its mean. In a round the centroids (k rows) go to
all tasks. With d the distance from a ball's mean to a centroid and r the radius, no row of
the ball lies nearer than d - r nor farther than d + r; where one centroid's d + r is below
every other's d - r, the whole ball is that centroid's and its sum is added unopened, else the
search descends, and rows of leaves that stay open are compared one by one. A task returns one
sum a centroid, so k rows a task are shuffled.

Distances are integers: in float64 where it holds every sum exactly, else in unbounded
integers. The bounds of balls are float64 with a margin for rounding, and decide only
between centroids that differ by more than it, so ties are always met row by row.

Rows: vectors that are null, of another length or hold null or non-finite components take no
part. Repeated rows count each. A row with a null vec_id is clustered like any other, but
is the last to be a starting centroid; rows of equal vec_id stand in order of their components.
With fewer rows than k each row is a centroid; centroids may be equal, and the smaller number
has the rows then. A component of 2^30 or more in size once scaled is an error, as is a
distance that doesn't fit a long. An empty table gives an empty result. Columns other than
vec_id and embedding play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, written

#: Rows of a tree: 64 components in 16 bits make 4 MB.
TREE = 32768
LEAF = 16
_LIMIT = 1 << 30
_PACKED = "n int, ids array<long>, width int, x binary, sums binary, radius binary"


def usable(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part: floor(scale * x) of each component."""
    x = F.col("embedding").cast("array<double>")
    inf = F.lit(float("inf"))
    fine = (F.size(x) == dims) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == inf))
    wide = F.raise_error(F.lit(f"a component is 2^30 or more once multiplied by {scale}"))
    floor = F.transform(x, lambda e: F.when(F.abs(e * scale) < _LIMIT, F.floor(e * scale).cast("int")).otherwise(wide.cast("int")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), floor.alias("v"))


def starting(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows with the smallest sha256 of "<seed>:<vec_id>", in its order."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    first = rows.select(F.when(F.col("vec_id").isNotNull(), digest).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


@dataclass
class Tree:
    """A complete binary tree over rows in leaf order: node i has the children 2i + 1 and 2i + 2."""

    x: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.arange(len(self.start) // 2, len(self.start))


def ranges(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of each node of a tree of n rows."""
    start, end = [0], [n]
    level = [(0, n)]
    while n > LEAF * len(level):
        level = [half for s, e in level for half in ((s, (s + e) // 2), ((s + e) // 2, e))]
        start += [s for s, _ in level]
        end += [e for _, e in level]
    return np.array(start), np.array(end)


def grow(x: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The order that puts the rows of x into leaves, and the tree."""
    n = len(x)
    start, end = ranges(n)
    order = np.arange(n)
    wide = x.astype(np.float64)
    for i in range(len(start) // 2):
        at = order[start[i] : end[i]]
        part = wide[at]
        far = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
        other = part[((part - far) ** 2).sum(1).argmax()]
        cutting = start[2 * i + 2] - start[i]
        order[start[i] : end[i]] = at[np.argpartition(part @ (other - far), min(cutting, len(at) - 1))]
    x = x[order]
    running = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0, dtype=np.int64)])
    sums = running[end] - running[start]
    middle = sums / (end - start)[:, None]
    radius = np.array([np.sqrt(((x[s:e] - m) ** 2).sum(1).max()) for s, e, m in zip(start, end, middle, strict=True)])
    return order, Tree(x, start, end, sums, radius)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and centroids: float64 where that is exact, else unbounded integers."""
    top = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * top * top * x.shape[1] < 2**53:
        x, z = x.astype(np.float64), centroids.astype(np.float64)
        return (x**2).sum(1)[:, None] - 2 * (x @ z.T) + (z**2).sum(1)[None, :]
    return np.array([((x.astype(object) - z) ** 2).sum(1) for z in centroids.astype(object)], object).T


def settle(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes whose whole ball is one centroid's (the largest such), that centroid (-1 for other nodes), and which rows are left."""
    size = (tree.end - tree.start)[:, None]
    middle = tree.sums / size
    z = centroids.astype(np.float64)
    norm = np.sqrt((z**2).sum(1))[None, :]
    own = np.sqrt((middle**2).sum(1))[:, None]
    far = np.sqrt(np.maximum((middle**2).sum(1)[:, None] - 2 * (middle @ z.T) + (z**2).sum(1)[None, :], 0))
    slack = 1e-6 * (own + norm + tree.radius[:, None] + 1)
    least, most = far - tree.radius[:, None] - slack, far + tree.radius[:, None] + slack
    nearest = most.argmin(1)
    alone = (least <= most.min(1)[:, None]).sum(1) == 1
    owner = np.where(alone, nearest, -1)
    covered = np.zeros(len(owner), bool)
    for i in range(1, len(owner)):
        up = (i - 1) // 2
        covered[i] = covered[up] or alone[up]
    whole = np.flatnonzero(alone & ~covered)
    left = np.zeros(len(tree.x), bool)
    for i in tree.leaves[~(alone | covered)[tree.leaves]]:
        left[tree.start[i] : tree.end[i]] = True
    return whole, owner, left


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """The trees of each partition, stored."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out() -> pa.RecordBatch:
            both = pa.Table.from_batches(held).combine_chunks()
            x = both.column(1).chunk(0).flatten().to_numpy().reshape(-1, dims)
            order, tree = grow(x)
            kind = "<i2" if np.abs(x).max() < 2**15 else "<i4"
            ids = both.column(0).take(pa.array(order)).combine_chunks()
            columns = [
                pa.array([len(x)], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids),
                pa.array([np.dtype(kind).itemsize], pa.int32()),
                *[pa.array([a.tobytes()], pa.binary()) for a in (tree.x.astype(kind), tree.sums, tree.radius)],
            ]
            return pa.RecordBatch.from_arrays(columns, names=["n", "ids", "width", "x", "sums", "radius"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, TREE - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == TREE:
                    yield out()
                    held, count = [], 0
        if count:
            yield out()

    return written(rows.mapInArrow(plant, _PACKED), "trees")


def opened(row: dict, dims: int) -> Tree:
    x = np.frombuffer(row["x"], f"<i{row['width']}").reshape(-1, dims).astype(np.int64)
    start, end = ranges(row["n"])
    return Tree(x, start, end, np.frombuffer(row["sums"], np.int64).reshape(-1, dims), np.frombuffer(row["radius"]))


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, dims = centroids.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for row in one_by_one(batches):
            tree = opened(row, dims)
            whole, owner, left = settle(tree, centroids)
            np.add.at(sums, (owner[whole], slice(0, dims)), tree.sums[whole])
            np.add.at(sums, (owner[whole], dims), (tree.end - tree.start)[whole])
            x = tree.x[left]
            if len(x):
                at = distances(x, centroids).argmin(1)
                np.add.at(sums[:, :dims], at, x)
                np.add.at(sums[:, dims], at, 1)
        used = np.flatnonzero(sums[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "s"])

    parts = trees.select("n", "width", "x", "sums", "radius").mapInArrow(totals, "cluster int, s array<long>")
    by_dim = parts.select("cluster", F.posexplode("s").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(19,0)")).alias("s"))
    found = {(r.cluster, r.dim): int(r.s) for r in by_dim.collect()}  # k * (dims + 1) rows
    out = centroids.copy()
    for c in range(k):
        if (c, dims) in found:
            out[c] = [found[c, j] // found[c, dims] for j in range(dims)]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every row."""
    dims = centroids.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids").slice(i, 1).flatten()
                tree = opened(batch.slice(i, 1).drop_columns(["ids"]).to_pylist()[0], dims)
                whole, owner, left = settle(tree, centroids)
                cluster = np.zeros(len(tree.x), np.int32)
                far = np.zeros(len(tree.x), object)
                for node in whole:
                    at = slice(tree.start[node], tree.end[node])
                    cluster[at] = owner[node]
                    far[at] = distances(tree.x[at], centroids[[owner[node]]])[:, 0]
                if left.any():
                    all_of = distances(tree.x[left], centroids)
                    cluster[left] = all_of.argmin(1)
                    far[left] = all_of[np.arange(len(all_of)), cluster[left]]
                if max(far, default=0) >= 2**63:
                    raise OverflowError("a squared distance doesn't fit a long")
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(far.astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return trees.select("n", "ids", "width", "x", "sums", "radius").mapInArrow(rows, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = usable(vectors, dims, scale)
    centroids = starting(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    trees = packed(rows, dims)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    found = cut(assigned(trees, centroids))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}  # k rows
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(c, s, total, digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(*[f.split()[0] for f in schema.split(", ")])


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def oracle(k: int = 40, rounds: int = 5) -> str:
    """DuckDB SQL of `op11`: one pair of steps a round."""
    near = "SELECT t, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT t, c, list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, z{0}) GROUP BY t"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        mean = f"SELECT c, list(m ORDER BY j) AS z FROM (SELECT c, j, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r} JOIN kept USING (t)) GROUP BY c, j) GROUP BY c"
        steps.append(f"z{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.z, o.z) AS z FROM z{r} o LEFT JOIN ({mean}) m USING (c))")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(rounds)})")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS t, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS c, v AS z FROM kept QUALIFY c < {k}),
{", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (t) JOIN z{rounds} USING (c)
"""
