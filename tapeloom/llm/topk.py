"""Exact top-k inner products by aggregation without random access.

Vectors of whole numbers are dealt into parts, queries into blocks, and each part meets each block in one task. There a
part is kept as one list a dimension, sorted by component. A query reads its lists in sorted order only, from the end
that scores best for the sign of its component, and all of them down to one contribution, the frontier. Of a vector met
in some lists, what it scored there is known; in every other list it scores at most the frontier and at least the
list's other end. Reading stops once at most RESOLVE vectors have an upper bound that reaches the k-th greatest lower
bound: no other can qualify. Only then are the final scores of these resolved. A part's k best per query are merged.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part. A query meets only
vectors of its own length; vectors without components score 0. Candidates are all rows of other ids than the query's,
repeated rows each for itself; of several queries of one id the one with the least vector counts. Ties go to the smaller
id. Components must be below 2^51 by their number, and scores fit in a long, else OverflowError. No queries or no vectors give no rows. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import pick
from tapeloom.session import ship

#: Vectors of a part and queries of a block, about: what one task holds, whatever the size of the table.
PART_ROWS, BLOCK_QUERIES = 1 << 14, 1 << 7
#: So many vectors at most are resolved for a query and part once no other can qualify.
RESOLVE = 64
#: Where reading pauses to compare bounds: frontiers in root mean squares of a contribution. The last reads all.
FRONTIERS = (0.0, -0.5, -0.9, -1.4, -2.2, -4.0, -np.inf)
_EXACT = float(1 << 53)


def quantised(vector: str, scale: int = 256) -> F.Column:
    """floor(scale * component) of each component as a long, or null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Lists:
    """The sorted lists of a part: rows (one a vector) of whole numbers."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, dims = rows.shape
        if (most := max(int(rows.max()), -int(rows.min()))) * dims >= 1 << 51:
            raise OverflowError("components too large")
        order = np.argsort(rows, axis=0, kind="stable").T  # a list a dimension, components upwards
        self.at = np.ascontiguousarray(order.astype(np.uint16 if n <= 1 << 16 else np.int64)).ravel()
        self.values = np.take_along_axis(rows.T, order, 1)
        self.low, self.high = self.values[:, 0], self.values[:, -1]
        # one ascending array of all lists, so that one search finds the places of a frontier in every list
        self.base, self.least = self.low.min(), np.arange(dims, dtype=np.int64) * (int(self.high.max()) - int(self.low.min()) + 3)
        self.keys = (self.values - self.base + self.least[:, None] + 1).ravel()
        self.values = self.values.astype(np.int32 if most < 1 << 31 else np.int64).ravel()
        self.square = (rows.astype(np.float64) ** 2).mean(axis=0)

    def _upto(self, q: np.ndarray, frontier: float) -> np.ndarray:
        """How many entries of each list contribute the frontier at least."""
        n, dims = self.rows.shape
        if frontier == -np.inf:
            return np.full(dims, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            edge = frontier / q  # of components
        span = self.least[1] - 2 if dims > 1 else int(self.high.max()) - int(self.base) + 1
        edge = np.clip(np.where(q > 0, np.ceil(edge) - self.base, np.floor(edge) + 1 - self.base), -1, span)  # exact: whole numbers below 2^53
        start = np.arange(dims) * n
        found = np.searchsorted(self.keys, self.least + np.where(q == 0, 0, edge).astype(np.int64) + 1) - start
        return np.where(q > 0, n - found, np.where(q < 0, found, n if frontier <= 0 else 0))

    def best(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all that can be among the k best for q; own: the rows that are no candidates, sorted."""
        n, dims = self.rows.shape
        ends = np.where(q > 0, self.low, self.high) * q  # the least contribution of each list
        tops = np.where(q > 0, self.high, self.low) * q
        most = float(np.maximum(np.abs(ends), np.abs(tops)).sum())
        slack = np.minimum(ends, 0)
        wide = 2 * most + 1
        known = np.zeros((3, n))  # of what was read: contributions, number of lists, sum of the lists' other ends
        packed = wide * (1 + (dims + 1) * (1 - float(slack.sum()))) < _EXACT
        per_list = wide * (1 + (dims + 1) * -slack.astype(np.float64))
        scale, done, total = float(np.sqrt((q.astype(np.float64) ** 2 * self.square).mean())), np.zeros(dims, np.int64), np.zeros(n)
        for step in FRONTIERS:
            frontier = np.floor(step * scale) if scale else -np.inf
            upto = np.maximum(self._upto(q, frontier), done)
            cuts = [(d * n + n - b, d * n + n - a) if up else (d * n + a, d * n + b) for d, (a, b, up) in enumerate(zip(done.tolist(), upto.tolist(), (q > 0).tolist(), strict=True)) if b > a]
            sizes, done = upto - done, upto
            if cuts:
                at = np.concatenate([self.at[a:b] for a, b in cuts])
                score = np.concatenate([self.values[a:b] for a, b in cuts]) * np.repeat(q.astype(np.float64), sizes)
                if packed:  # three sums in the digits of one
                    score += np.repeat(per_list, sizes)
                    total += np.bincount(at, score, n)
                    digits = np.rint(total / wide)
                    known[0], known[1], known[2] = total - digits * wide, digits % (dims + 1), -(digits // (dims + 1))
                else:
                    for i, w in enumerate((score, np.ones(len(at)), np.repeat(slack.astype(np.float64), sizes))):
                        known[i] += np.bincount(at, w, n)
            last = frontier == -np.inf
            upper = known[0] if last else known[0] + (dims - known[1]) * frontier
            lower = known[0] + (float(slack.sum()) - known[2])
            if not packed:  # sums are rounded
                upper, lower = upper + most * 1e-9, lower - most * 1e-9
            lower[own], upper = -np.inf, upper.copy()
            upper[own] = -np.inf
            if n - len(own) > k:
                found = np.flatnonzero(upper >= np.partition(lower, n - k)[n - k])
            else:
                found = np.delete(np.arange(n), own)
            if last or len(found) <= max(RESOLVE, k):
                return found, self.rows[found] @ q
        raise AssertionError("the last frontier reads all")


def _fits(q: np.ndarray, lists: Lists) -> None:
    if (np.abs(q.astype(np.float64)) * np.maximum(np.abs(lists.low.astype(np.float64)), np.abs(lists.high.astype(np.float64)))).sum() >= 2.0**63:
        raise OverflowError("a score does not fit in a long")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return np.asarray(rows.flatten()).astype(np.int64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), np.int64)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, part_rows: int = PART_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best vectors of each query. Both frames: id long, vector array<long>, null where it takes no part.

    Parts and blocks are as many as the counted rows need, so a task's size is bounded; rows are dealt by hash.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.where("id IS NOT NULL AND vector IS NOT NULL")
    queries = queries.where("id IS NOT NULL AND vector IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    parts = -(-max(1, vectors.count()) // part_rows)
    blocks = -(-max(1, queries.count()) // block_queries)
    key = ["dims", "part", "block"]

    def dealt(df, own: str, n: int, other: str, m: int):
        mine = F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
        return df.select("id", "vector", F.size("vector").alias("dims"), mine.alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    schema = "query_id long, vec_id long, score long"

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = ([], [], [])
        if asked.num_rows and held.num_rows:
            ids, q_ids = held["id"].to_numpy(), asked["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, rows, wanted = ids[order], _matrix(held["vector"])[order], _matrix(asked["vector"])
            lists = Lists(rows) if rows.shape[1] else None
            for q_id, q in zip(q_ids.tolist(), wanted, strict=True):
                own = np.arange(np.searchsorted(ids, q_id), np.searchsorted(ids, q_id, "right"))
                if lists:
                    _fits(q, lists)
                    found, scores = lists.best(q, own, k)
                else:
                    found = np.delete(np.arange(len(ids)), own)[:k]
                    scores = np.zeros(len(found), np.int64)
                first = np.lexsort((ids[found], -scores))[:k]
                out[0].append(np.full(len(first), q_id))
                out[1].append(ids[found[first]])
                out[2].append(scores[first])
        flat = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out]
        return pa.Table.from_arrays(flat, names=["query_id", "vec_id", "score"])

    asked = dealt(queries, "block", blocks, "part", parts).groupBy(*key)
    held = dealt(vectors, "part", parts, "block", blocks).groupBy(*key)
    near = asked.cogroup(held).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", **sizes: int) -> DataFrame:
    """search() of a table of vectors of floats for the rows whose id is divisible by `every`; components count as floor(scale * x)."""
    own = pick(table, id=vec_id, vector=vector).select(F.col("id").cast("long").alias("id"), quantised("vector", scale).alias("vector"))
    return search(own.where(F.col("id") % every == 0), own, k, **sizes)
