"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Edges up to which one task finds the components; beyond, rounds of joins do.
ONE_TASK = 200_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (u, v): label is the least node of its component.

    Up to ONE_TASK edges are united in one task. Of more, each round a node takes the least
    label among its neighbours, then the label of its label, so that a path of length n needs
    about log n rounds. Each round is kept in the shared folder; it ends when none changes.
    """
    edges = cut(edges.select("u", "v").filter("u <> v"))
    if edges.count() <= ONE_TASK:
        kind = edges.schema["u"].dataType.simpleString()
        return cut(edges.coalesce(1).mapInArrow(_union, f"node {kind}, label {kind}"))
    both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).dropDuplicates())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        hooked = cut(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        # the least node of a large component is the label of all of it
        new = cut(join_hot(hooked, jump, "label", ["next"]).select("node", F.least("label", "next").alias("label"), "old"))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
