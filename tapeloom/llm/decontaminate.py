"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is the set of its short word shingles. Only full containment counts, so by the prefix filter it is
enough to join on one shingle of each window: the rarest one, with document frequencies counted over all documents.
A shingle met at word p of a document stands at offset o of its window, which bounds the window's place to p - o and
its length to what is left of the document; there the window is compared word by word.

The benchmark is taken in blocks of bounded size, each broadcast in turn; one block is the usual case. With more than
one, each document's findings of all blocks are united.

Null texts have no words: not contaminated. Items without words give no window. Windows that occur in several items, or
rows with the same item id, count once per item id; an item whose id is null goes by the empty string. Repeated
documents give a row each, whatever their ids.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import map_batches, pick, text_groups, unnamed
from tapeloom.session import cut

#: A-Z to a-z; other ASCII but a-z and 0-9 parts words; bytes of other characters stay.
_WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
WINDOW, SHINGLE = 10, 3
#: The bound on what is broadcast at once, in bytes of item text.
BLOCK_BYTES = 4 << 20
_OUT = "n_words long, n_hit long, items array<string>, spans array<int>"


def words(text: str | None) -> list[bytes]:
    """Maximal runs of 0-9, a-z and what is not ASCII, after lower-casing A-Z."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def item_windows(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def _shingles(w, k: int):
    return zip(*(w[i:] for i in range(k)), strict=False) if k > 1 else ((x,) for x in w)


class Index:
    """The windows of a block of items, found by one shingle each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, frequency: dict[tuple[bytes, ...], int]):
        owners = defaultdict(set)
        for item, text in items:
            for win in item_windows(text, window):
                owners[win].add(item)
        self.by_size: dict[int, dict] = {}
        for win, ids in owners.items():
            k = min(SHINGLE, len(win))
            offset = min(range(len(win) - k + 1), key=lambda i: (frequency.get(win[i : i + k], 0), win[i : i + k]))
            self.by_size.setdefault(k, {}).setdefault(win[offset : offset + k], []).append((offset, list(win), sorted(ids)))

    def find(self, w: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """(merged spans of hit words as [from, to), items with occurring windows)"""
        spans, items = [], set()
        for k, index in self.by_size.items():
            if len(w) < k:
                continue
            for at, shingle in enumerate(_shingles(w, k)):
                if shingle in index:
                    for offset, win, ids in index[shingle]:
                        first = at - offset
                        if 0 <= first <= len(w) - len(win) and w[first : first + len(win)] == win:
                            spans.append([first, first + len(win)])
                            items.update(ids)
        return united(spans), items


def united(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about block_bytes, one at least, each read when it is asked for."""
    rows = pick(benchmark, item=item_col, text=text_col).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text").orderBy("item", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.text or "")
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.item, r.text))
        size += n
    yield block


def _drained(items: list):
    """The items from first to last; the list keeps none that was given out."""
    while items:
        yield items.pop(0)


def shingle_frequency(docs: DataFrame, shingles: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """In how many documents (column text) each of the shingles occurs: counted in each task, then summed."""
    sizes = sorted({len(s) for s in shingles})
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(shingles)

    def count(batches):
        own, found = wanted.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = words(text)
                for k in sizes:
                    found.update(own.intersection(_shingles(w, k)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s).decode() for s in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["shingle", "n"])

    rows = map_batches(docs.select("text"), count, "shingle string, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    out = {tuple(r.shingle.encode().split(b" ")): r.n for r in rows.toLocalIterator()}
    wanted.unpersist()
    return out


def clean(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df whose texts hold no window of any item, as they are. Null texts are clean."""
    at, rows = df.columns.index(text_col), unnamed(df)
    texts = rows.select(F.col(f"c{at}").alias("text"))  # counted whole for each block, whatever blocks before it drop
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        wanted = _wanted(block, window)
        if not wanted:
            continue
        index = df.sparkSession.sparkContext.broadcast(Index(block, window, shingle_frequency(texts, wanted)))

        def run(batches, index=index):
            own = index.value
            for batch in batches:
                yield batch.filter(pa.array([not own.find(words(t))[0] for t in batch.column(at).to_pylist()], pa.bool_()))

        rows = map_batches(rows, run, rows.schema)
    return rows.toDF(*df.columns)


def _wanted(block: list[tuple[str, str | None]], window: int) -> set[tuple[bytes, ...]]:
    """The shingles of a block's windows, one of which finds each window."""
    return {s for _, t in block for win in item_windows(t, window) for s in _shingles(win, min(SHINGLE, len(win)))}


def find(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document's words inside occurrences of item windows.

    Returns id_col's values as doc_id, n_words, n_hit, items (ids as strings, sorted), spans (flat list: from, to of
    word numbers, the end exclusive, merged and ascending).
    """
    spark = df.sparkSession
    rows = pick(df, doc_id=id_col, text=text_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = list(islice(blocks, 2))
    several = len(first) > 1
    if several:  # a row number joins the blocks' findings; it is written down so that it can't change
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = cut(rows)
    found = None
    for block in chain(_drained(first), blocks):
        wanted = _wanted(block, window)
        index = spark.sparkContext.broadcast(Index(block, window, shingle_frequency(rows, wanted) if wanted else {}))

        def run(batches, index=index):
            own = index.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for lo, hi in text_groups([t or "" for t in texts], 1 << 22):
                    out = []
                    for t in texts[lo:hi]:
                        w = words(t)
                        spans, items = own.find(w)
                        out.append((len(w), sum(b - a for a, b in spans), sorted(items), [x for s in spans for x in s]))
                    n_words, n_hit, items, spans = map(list, zip(*out, strict=True))
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in part.schema.names if c != "text"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))],
                        names=[*(c for c in part.schema.names if c != "text"), "n_words", "n_hit", "items", "spans"],
                    )

        columns = [c for c in rows.columns if c != "text"]
        one = map_batches(rows.select(*columns, "text"), run, ", ".join([f"doc_id {kind}", *["row long"] * ("row" in columns), _OUT]))
        found = one if found is None else found.unionByName(one.where("n_hit > 0").withColumn("n_words", F.lit(None).cast("long")))
    if not several:
        return found

    @F.udf("array<int>")
    def unite(parts):
        flat = [x for p in parts for x in p]
        return [x for s in united([list(s) for s in zip(flat[::2], flat[1::2], strict=True)]) for x in s]

    whole = found.groupBy("row").agg(F.max(F.struct("n_words", "doc_id")).alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), unite(F.collect_list("spans")).alias("spans"))
    hit = F.aggregate("spans", F.lit(0), lambda a, x: x - a)  # of ascending from, to, from, to: the sum of to - from
    return whole.select("own.doc_id", "own.n_words", hit.cast("long").alias("n_hit"), "items", "spans")
