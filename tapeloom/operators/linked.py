"""Connected components of things that rows name together, without gathering a component anywhere.

Rows that lie near each other are united first, in the task that reads them: each run of rows gives (node, root), where
root is the least node of the run's component. Only nodes with different roots in different runs are left to settle over
all runs, by alternating stars over the roots. In each round a node's neighbours meet its minimum, which is found by
partial sums; the neighbours of a hub are dealt into shares, and its minimum to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut, ship

#: Mentions of nodes that a task unites before it gives out what it has; neighbours of a node that are one share.
RUN_NODES, HUB = 1 << 20, 1 << 14


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a row with the one before it in the row, or with itself where it is the first; nulls are passed over."""
    before, some, pairs = np.zeros(len(batch), np.int64), np.zeros(len(batch), bool), []
    for column in batch.columns:
        there = column.is_valid().to_numpy(zero_copy_only=False)
        own = column.fill_null(0).to_numpy(zero_copy_only=False)
        pairs.append((np.where(some, before, own)[there], own[there]))
        before, some = np.where(there, own, before), some | there
    u, v = zip(*pairs, strict=True)
    return np.concatenate(u), np.concatenate(v)


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the pairs (u, v) and the least node of the component of each, all pairs at once."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]  # what is united stays so
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, above := up[up]):
            up = above


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows that a task unites together: up to most rows beyond most pairs."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, len(batch), most):
            held.append(_pairs(batch.slice(at, most)))
            n += len(held[-1][0])
            if n >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _to_least(edges: DataFrame, meets: DataFrame) -> DataFrame:
    """Edges u, v with m, the least node that u meets. meets: edges from each node to all that it meets.

    A hub's edges are dealt into shares, and its minimum to each. The list of hubs has at most a row for HUB edges.
    """
    least = meets.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.ceil(F.count("*") / HUB).cast("int").alias("shares"))
    hubs = least.where("shares > 1").select("u", "shares")
    dealt = edges.join(F.broadcast(hubs), "u", "left").withColumn("share", F.pmod(F.xxhash64("v"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    held = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    return dealt.join(held, ["u", "share"])


def _round(edges: DataFrame) -> DataFrame:
    """A large star, then a small star, of edges from larger to smaller nodes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _to_least(both.where("v > u"), both).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    small = _to_least(large, large).select(F.col("v").alias("x"), "u", "m")
    return small.select(F.explode(F.array("x", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges run from nodes with one edge each to nodes with none."""
    several = edges.groupBy("u").count().where("count > 1").select("u")
    between = edges.select("u").join(edges.groupBy("v").count().select(F.col("v").alias("u")), "u", "left_semi")
    return several.unionByName(between).isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for the nodes of the edges (u, v) that are not themselves roots."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        now = cut(_round(now))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(rows: DataFrame, most: int = RUN_NODES) -> DataFrame:
    """node and root of the nodes that are not the least of their component; rows: columns of longs, the nodes that a row names together."""
    ship(rows.sparkSession)

    def run(batches):
        for u, v in _runs(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in united(u, v)], names=["node", "root"])

    found = cut(rows.mapInArrow(run, "node long, root long"))
    least = found.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    split = least.where("root <> other").select("node", F.col("root").alias("least"))
    edges = found.join(split, "node").where("root <> least").select(F.col("root").alias("u"), F.col("least").alias("v"))
    settled = stars(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    told = least.join(settled, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return told.where("node <> root")
