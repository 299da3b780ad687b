"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two. The vector of the segments' bit counts is an embedding in which the
Manhattan distance never exceeds the Hamming distance. Written in unary, with each segment's set bits moved to its low
end, the vector is again 64 bits, and the Manhattan distance is the number of bits in which two of them differ.

The grid: the 32 segments are dealt into g groups. Two vectors at distance 4 or less agree in at least g - 4 of them, so
equal counts in some g - 4 groups are the cells to join on. In a cell, the Manhattan distance sorts out pairs first, the
Hamming distance decides. g follows from the number of fingerprints, by the cost of more cells against that of more
pairs; whatever g, the result is the same. Cells give a spanning forest of their links, not all pairs; a cell too large
for one task is dealt into blocks, and each pair of blocks is compared. Equal fingerprints meet once, as one node.

Null texts have no words: fingerprint zero, linked like any other. Null ids are never a component's id unless all of its
ids are null. Repeated rows keep a row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import LOWER_BYTES, filesystem, map_batches, pick, unnamed
from tapeloom.llm.graph import components as connected
from tapeloom.session import cut, scratch

SHINGLE, SEED, DISTANCE = 4, 42, 4
_LOW = 0x5555555555555555
#: Above so many fingerprints a cell is dealt into blocks.
CELL_ROWS = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned number."""
    import xxhash

    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    starts, at = [], 0
    for n in map(len, words):
        starts.append(at)
        at += n + 1
    starts.append(at)
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:], strict=False)], "<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text_col: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """The rows with a last column of signed 64-bit fingerprints added."""
    at, rows = df.columns.index(text_col), unnamed(df)

    def run(batches):
        for b in batches:
            prints = [fingerprint(t, shingle) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], names=[*b.schema.names, name])

    return map_batches(rows, run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])).toDF(*df.columns, name)


def unary(x: np.ndarray) -> np.ndarray:
    """The bit counts of two-bit segments in unary."""
    low = np.uint64(_LOW)
    high = x >> np.uint64(1)
    return ((x | high) & low) | ((x & high & low) << np.uint64(1))


def groups_for(n: int, distance: int = DISTANCE) -> int:
    """How many groups to deal the segments into, for n fingerprints: rows moved against pairs compared."""
    cost = lambda g: comb(g, distance) * (1 + 0.02 * n / 2 ** (45.3 * (g - distance) / g))  # noqa: E731  45.3: bits by which random vectors tell
    return min(range(distance + 2, distance + 8), key=cost)


def masks(groups: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of groups that must agree, the bits of their segments."""
    own = [sum(3 << (2 * s) for s in range(32) if s * groups // 32 == k) for k in range(groups)]
    return [sum(own[k] for k in chosen) for chosen in combinations(range(groups), groups - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cells(prints: DataFrame, groups: int, distance: int = DISTANCE) -> DataFrame:
    """key and fp: each fingerprint in each of its cells."""
    low, fp = F.lit(_LOW), F.col("fp")
    high = F.shiftrightunsigned(fp, 1)
    vector = fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))
    keys = F.array(*(F.xxhash64(F.lit(i), vector.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(groups, distance))))
    return prints.select(F.explode(keys).alias("key"), "fp")


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """The cells with those of more than most rows dealt into blocks, each pair of blocks a cell of its own."""
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("key").alias("hot"), F.ceil(2 * F.col("n") / most).cast("int").alias("blocks"))
    if hot.isEmpty():
        return rows
    joined = rows.join(hot, F.col("key") == F.col("hot"), "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    spread = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return spread.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair).alias("key"), "fp")


def _near(a, b, distance: int) -> np.ndarray:
    """Whether the Hamming distance is small, looked at only where the Manhattan distance of the bit counts is."""
    near = np.bitwise_count(unary(a) ^ unary(b)) <= distance
    return near & (np.bitwise_count(a ^ b) <= distance)


def _grown(x: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of a large cell: what a node reaches leaves the rest at once, so a dense cell is never compared pair by pair."""
    rest, vectors = x, unary(x)
    while len(rest):
        queue, rest, vectors = [rest[0]], rest[1:], vectors[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(vectors ^ unary(at)) <= distance
            near[near] = np.bitwise_count(rest[near] ^ at) <= distance
            if near.any():
                yield from ((int(at), int(y)) for y in rest[near])
                queue.extend(rest[near])
                rest, vectors = rest[~near], vectors[~near]


class _Forest:
    """Union-find over links; gives each node's link to its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def drain(self) -> Iterator[pa.RecordBatch]:
        links = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        self.up = {}
        if links:
            u, v = np.array(links, np.uint64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u).view(np.int64)), pa.array(np.ascontiguousarray(v).view(np.int64))], names=["u", "v"])


def links(prints: DataFrame, distance: int = DISTANCE, groups: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) of a spanning forest of each task's cells; together they connect what the near pairs connect.

    prints: distinct signed 64-bit fingerprints, as fp.
    """
    groups = groups or groups_for(prints.count(), distance)
    rows = _dealt(cells(prints, groups, distance), cell_rows).repartition("key").sortWithinPartitions("key")

    def run(batches):
        forest, held_k, held_x = _Forest(), np.empty(0, np.int64), np.empty(0, np.uint64)

        def work(k, x):
            ends = np.flatnonzero(np.r_[k[1:] != k[:-1], True]) + 1
            starts = np.r_[0, ends[:-1]]
            sizes = ends - starts
            for a, b in zip(starts[sizes > 64].tolist(), ends[sizes > 64].tolist(), strict=True):
                for u, v in _grown(np.unique(x[a:b]), distance):
                    forest.add(u, v)
            small = np.repeat(sizes <= 64, sizes)
            at, step = np.flatnonzero(small[:-1] & (k[1:] == k[:-1])), 1
            while len(at):
                near = _near(x[at], x[at + step], distance)
                for u, v in zip(x[at[near]].tolist(), x[at[near] + step].tolist(), strict=True):
                    if u != v:
                        forest.add(u, v)
                step += 1
                at = at[at + step < len(k)]
                at = at[k[at] == k[at + step]]

        for batch in batches:
            k, x = np.concatenate([held_k, batch.column(0).to_numpy()]), np.concatenate([held_x, batch.column(1).to_numpy().view(np.uint64)])
            if not len(k):
                continue
            whole = int(np.searchsorted(k, k[-1]))  # the last cell may go on
            if whole:
                work(k[:whole], x[:whole])
            held_k, held_x = k[whole:], x[whole:]
            if len(forest.up) > 1_000_000:
                yield from forest.drain()
        if len(held_k):
            work(held_k, held_x)
        yield from forest.drain()

    return map_batches(rows, run, "u long, v long")


def roots(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp and root of those distinct fingerprints that have links."""
    return connected(links(prints, distance)).select(F.col("node").alias("fp"), "root")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id, the least doc_id that links lead to, of every row."""
    rows = cut(with_fingerprint(pick(df, doc_id=id_col, text=text_col), name="fp", shingle=shingle).select("doc_id", "fp"))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = cut(prints.join(roots(prints.select("fp"), distance), "fp", "left"))
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("least_id"))
    by_print = found.join(least, "root", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def hex_print(col):
    """A signed 64-bit fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")


_PLACES = (1 << 33) - 1  # monotonically_increasing_id: the partition's number above so many places


def _gone(folder: str, part: int) -> np.ndarray:
    """The places of the rows of a partition that go, from its file in the shared folder."""
    fs, path = filesystem(f"{folder}/part={part}")
    if fs.get_file_info(path).type.name != "Directory":
        return np.empty(0, np.int64)
    return pq.read_table(path, columns=["place"], filesystem=fs, partitioning=None)["place"].to_numpy()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of df, one of each component: that with the least id, nulls last; of repeated ids any one row.

    Rows are written once, with numbers; which of them go is written by partition, and a second pass leaves them out. So
    texts are never shuffled.
    """
    spark, path, gone = df.sparkSession, scratch(df.sparkSession, "prints"), scratch(df.sparkSession, "gone")
    own = unnamed(df)
    text, id_at = f"c{df.columns.index(text_col)}", f"c{df.columns.index(id_col)}"
    marked = with_fingerprint(own, text, "_fp", shingle).withColumn("_row", F.monotonically_increasing_id())
    marked.write.parquet(path)  # row numbers must stay what they are
    rows = spark.read.parquet(path)
    small = rows.select(F.col(id_at).alias("id"), "_fp", "_row")
    prints = cut(small.groupBy(F.col("_fp").alias("fp")).agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "_row")).alias("first")))
    found = cut(prints.join(roots(prints.select("fp"), distance), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    first = found.groupBy("root").agg(F.min("first").alias("kept")).select("root", F.col("kept._row").alias("kept"))
    kept = found.join(first, "root").select(F.col("fp").alias("_fp"), "kept")
    dropped = small.select("_fp", "_row").join(kept, "_fp").where("kept <> _row")
    dropped.select(F.shiftright("_row", 33).alias("part"), F.col("_row").bitwiseAND(_PLACES).alias("place")).repartition("part").write.partitionBy("part").parquet(gone)

    def run(batches):
        have, places = None, None
        for batch in batches:
            row = batch.column(batch.num_columns - 1).to_numpy()
            keep = np.ones(len(row), bool)
            for part in np.unique(row >> 33).tolist():
                if part != have:
                    have, places = part, _gone(gone, part)
                here = row >> 33 == part
                keep[here] = ~np.isin(row[here] & _PLACES, places)
            yield pa.RecordBatch.from_arrays(list(batch.columns[:-1]), names=batch.schema.names[:-1]).filter(pa.array(keep))

    return map_batches(rows.select(*own.columns, "_row"), run, own.schema).toDF(*df.columns)
