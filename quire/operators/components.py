"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .keyed import lookup, narrow

ONE_TASK = 1_000_000  # edges that one task may unite; 16 bytes each


def _united(edges: DataFrame) -> DataFrame:
    """Node and root of the nodes that are no roots, by union-find in one task. The caller has counted the edges."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while (above := up.get(x, x)) != top:
                up[x], x = top, above
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = sorted(up)
        for begin in range(0, len(nodes), 100_000):
            part = nodes[begin : begin + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["node", "root"])

    return edges.coalesce(1).mapInArrow(unite, "node long, root long")


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers to smaller nodes, followed to the end.

    A task holds a range of nodes and follows all pointers that stay within it in one ascending pass;
    across ranges each round doubles how far a pointer reaches.
    """

    def chase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            nodes, roots = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (node, root) in enumerate(zip(nodes, roots, strict=True)):
                roots[i] = known[node] = known.get(root, root)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.int64())], ["node", "root"])

    while True:
        ranged = pointers.select("node", "root").repartitionByRange("node").sortWithinPartitions("node")
        near = cut(ranged.mapInArrow(chase, "node long, root long"))
        onward = near.select(F.col("node").alias("root"), F.col("root").alias("further"))
        far = lookup(narrow(near, "node", keys=["root"]), onward, ["root"], ["node"])
        pointers = cut(far.select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if pointers.filter("moved").isEmpty():
            return pointers.select("node", "root")


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node and root (the least node of its component) of every node of the edges that is not a root itself.

    ``edges`` has two integer columns. Each node points to its least neighbour, pointers are followed, and
    the edges shrink to what lies between different roots; that at least halves the nodes each time. As soon as no
    more than ``one_task`` edges are left, one task unites them.
    """
    a, b = edges.columns
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    left, labels = cut(edges.filter(F.col(a) != F.col(b)).select(high, low).distinct()), None
    while True:
        n = left.count()
        if n == 0:
            break
        if n <= one_task:
            found = cut(_united(left))
        else:
            found = _followed(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")))
        if labels is None:
            labels = found
        else:
            further = found.select(F.col("node").alias("root"), F.col("root").alias("further"))
            moved = lookup(narrow(labels, "node", keys=["root"]), further, ["root"], ["node"]).select("node", F.coalesce("further", "root").alias("root"))
            labels = cut(moved.unionByName(found))
        if n <= one_task:
            break
        for end in ("high", "low"):
            to = found.select(F.col("node").alias(end), F.col("root").alias("_to"))
            other = "low" if end == "high" else "high"
            left = lookup(narrow(left, other, keys=[end]), to, [end], [other]).select(F.coalesce("_to", end).alias(end), other)
        left = cut(left.filter("high <> low").select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct())
    return labels if labels is not None else left.select(F.col("high").alias("node"), F.col("low").alias("root"))
