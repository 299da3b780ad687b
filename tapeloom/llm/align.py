"""Alignment of two tokenizers' ids by the bytes that they stand for, and how often ids end together over a corpus.

The text with a space before it is what both tokenizers spell. Each byte of it has a label: no token ends there, one of A,
one of B, or one of each; a regular expression over the labels takes spans up to each place where both end, and the
labels in a span say how many ids of either side make its group. An A and a B id whose bytes end together are linked.

Texts are cut before every space that follows no white space: neither tokenizer has a token across such a place, whatever
stands around it, so parts are aligned apart and kept by text in a bounded cache. A text with a part whose joined bytes
differ from it is encoded whole, and has no tokens if its bytes differ as well.

The corpus counts take two passes. The first writes each document with its distinct links, in blocks of documents that
are read one after another, and each block's sums of them; sums over blocks are joined back to the blocks that hold the
link, so a common pair has a row a block, not one an occurrence, and nothing is broadcast. A block then meets its
documents. Tokenizers are opened by path in each worker.

Defined results: a null or empty text, and one whose joined bytes differ, has zeros and an empty groups string, unhashed.
Rows are kept as they are, repeated and null ids too; each row counts. An empty table gives no rows. Other columns are
left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import map_batches, pick, resident
from tapeloom.session import scratch, ship

#: Labels of a byte: no end, A's, B's, both.
NONE, A_END, B_END, BOTH = b"n", b"a", b"b", b"c"
_SPAN = re.compile(b"[^c]*c")
#: Before a space that follows no white space, no token of either side crosses.
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")
#: Parts that a worker keeps; the longest it keeps; links of a block, about.
KEPT_PARTS, LONGEST_PART, BLOCK_LINKS = 1 << 19, 64, 1 << 21
#: Parts that are aligned at once.
STEP_PARTS = 1 << 16
#: A pair of ids as one number.
SHIFT = 32


@lru_cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in turn from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level tokenizer of the tokenizers library, special tokens' strings being plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        byte_of = _byte_of()
        self.bytes = {}
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            own = [byte_of.get(c) for c in token]
            self.bytes[i] = token.encode() if None in own else bytes(own)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Ids of a piece model of the sentencepiece library, which puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def labels(n: int, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """The label of each of n bytes, for the places (from 1) where tokens end."""
    at = np.zeros(n + 1, np.uint8)
    at[a_ends] |= 1
    at[b_ends] |= 2
    return np.frombuffer(NONE + A_END + B_END + BOTH, np.uint8)[at[1:]].tobytes()


class Store:
    """Ids of parts in one array a side; a part has a place in both."""

    def __init__(self):
        self.ids, self.starts = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def __len__(self) -> int:
        return len(self.starts[0]) - 1

    def add(self, encoded: list[tuple[list[int], list[int]]]) -> None:
        for side in (0, 1):
            own = [x[side] for x in encoded]
            self.ids[side] = np.concatenate([self.ids[side], np.array([i for x in own for i in x], np.int32)])
            self.starts[side] = np.concatenate([self.starts[side], self.starts[side][-1] + np.cumsum([len(x) for x in own], dtype=np.int64)])

    def take(self, codes: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the parts in turn, how many each has)"""
        start = self.starts[side]
        sizes = start[codes + 1] - start[codes]
        at = np.repeat(start[codes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.ids[side][at], sizes

    def keep(self, codes: np.ndarray) -> None:
        for side in (0, 1):
            ids, sizes = self.take(codes, side)
            self.ids[side], self.starts[side] = ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Found:
    """What is known of one text: counts, links as numbers (A << SHIFT) + B with how often each occurs, the groups' digest."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._digest, self._more = hashlib.sha256(), b""

    def add(self, n_a: int, n_b: int, links: np.ndarray, groups: str) -> None:
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + len(links)
        self._digest.update(self._more + groups.encode())
        self._more = b";"
        pairs, times = np.unique(links, return_counts=True)
        if len(self.pairs):
            pairs, at = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            times = np.bincount(at, np.concatenate([self.times, times]), len(pairs)).astype(np.int64)
        self.pairs, self.times = pairs, times

    @property
    def digest(self) -> str:
        return self._digest.hexdigest() if self.n_a else ""


class Aligner:
    """Aligns texts, with a bounded cache of the ids of parts."""

    def __init__(self, a_path: str, b_path: str, kept_parts: int = KEPT_PARTS):
        self.sides, self.kept_parts = (ByteLevel(a_path), Pieces(b_path)), kept_parts
        self.known: dict[str, int] = {}
        self.store, self.uses = Store(), np.zeros(0, np.int64)
        self.sizes, self.words = [], []
        for side, within, last in zip(self.sides, (",", ","), ("|", ";"), strict=True):
            sizes = np.zeros(max(side.bytes) + 1, np.int64)
            sizes[list(side.bytes)] = [len(x) for x in side.bytes.values()]
            self.sizes.append(sizes)
            self.words.append(np.array([f"{i}{end}" for i in range(len(sizes)) for end in (within, last)], object))

    def _spells(self, side: int, ids: list[list[int]], texts: list[bytes]) -> list[bool]:
        """Whether each text is what its ids stand for."""
        of = self.sides[side].bytes
        flat = [i for x in ids for i in x]
        ends = np.cumsum([0, *map(len, ids)])
        upto = np.concatenate([[0], np.cumsum(self.sizes[side][flat])])[ends]
        if (np.diff(upto) == [*map(len, texts)]).all() and b"".join([of[i] for i in flat]) == b"".join(texts):
            return [True] * len(texts)
        return [b"".join([of[i] for i in x]) == t for x, t in zip(ids, texts, strict=True)]

    def _learn(self, texts: list[str]) -> None:
        """Adds texts to what is known, -1 for one whose joined bytes differ on a side."""
        for i in range(0, len(texts), 4096):
            few = texts[i : i + 4096]
            own, spelt = [s.encode(few) for s in self.sides], [b" " + t.encode() for t in few]
            fits = [a and b for a, b in zip(*(self._spells(n, ids, spelt) for n, ids in enumerate(own)), strict=True)]
            at = len(self.store)
            self.store.add([x for x, good in zip(zip(*own, strict=True), fits, strict=True) if good])
            for t, good in zip(few, fits, strict=True):
                self.known[t] = at if good else -1
                at += good

    def _forget(self) -> None:
        """Beyond the bound only parts met more than once stay, or none if these are too many as well."""
        if len(self.known) > self.kept_parts:
            kept = [p for p, c in self.known.items() if c >= 0 and self.uses[c] > 1 and len(p) <= LONGEST_PART]
            kept = kept if len(kept) < self.kept_parts // 2 else []
            self.store.keep(np.array([self.known[p] for p in kept], np.int64))
            self.known = {p: i for i, p in enumerate(kept)}
            self.uses = np.zeros(len(kept), np.int64)

    def _groups(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(A's and B's ids up to each part's end, groups up to each part's end, links, words of the groups in turn) of parts."""
        (a, sizes_a), (b, sizes_b) = self.store.take(codes, 0), self.store.take(codes, 1)
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        told = labels(int(a_ends[-1]), a_ends, b_ends)
        starts = np.cumsum([0, *map(len, _SPAN.findall(told))])[:-1]
        label = np.frombuffer(told, np.uint8)
        in_a, in_b = (np.add.reduceat((label == own) | (label == BOTH[0]), starts, dtype=np.int64) for own in (A_END[0], B_END[0]))
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        words = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[upto_a - 1], last_b[upto_b - 1] = 1, 1
        words[np.arange(len(a)) + np.repeat(upto_b - in_b, in_a)] = self.words[0][2 * a + last_a]
        words[np.arange(len(b)) + np.repeat(upto_a, in_b)] = self.words[1][2 * b + last_b]
        links = (a[upto_a - 1].astype(np.int64) << SHIFT) + b[upto_b - 1]
        ends = np.cumsum(sizes_a), np.cumsum(sizes_b)
        return np.stack(ends), np.searchsorted(upto_a, ends[0]) + 1, links, words.tolist()

    def documents(self, texts: list[str]) -> list[Found]:
        """What is found of each text."""
        cut = []
        for t in texts:
            plain = t[:1] not in (" ", "") and "  " not in t and not _ODD.search(t)
            cut.append(t.split(" ") if plain else [p[1:] for p in _CUT.split(" " + t)] if t else [])
        flat = list(chain.from_iterable(cut))
        codes = np.fromiter(map(self.known.get, flat, repeat(-2)), np.int64, len(flat))
        if len(new := np.flatnonzero(codes == -2).tolist()):
            self._learn(list({flat[i] for i in new}))
            codes[new] = [self.known[flat[i]] for i in new]
        if len(odd := np.flatnonzero(codes < 0)):  # then the text in one piece
            starts = np.cumsum([0, *map(len, cut)])
            lists = np.split(codes, starts[1:-1])
            for i in np.unique(np.searchsorted(starts, odd, "right") - 1).tolist():
                if texts[i] not in self.known:
                    self._learn([texts[i]])
                cut[i] = [texts[i]] if self.known[texts[i]] >= 0 else []
                lists[i] = np.array([self.known[p] for p in cut[i]], np.int64)
            codes = np.concatenate(lists)
        owner = np.repeat(np.arange(len(texts)), [len(parts) for parts in cut])
        self.uses = np.bincount(codes, minlength=len(self.store)) + np.pad(self.uses, (0, len(self.store) - len(self.uses)))
        found = [Found() for _ in texts]
        for at in range(0, len(codes), STEP_PARTS):
            (upto_a, upto_b), upto, links, words = self._groups(codes[at : at + STEP_PARTS])
            whose = owner[at : at + STEP_PARTS]
            ends = np.append(np.flatnonzero(np.diff(whose)), len(whose) - 1)
            a = b = g = 0
            for end in ends.tolist():
                to_a, to_b, to_g = int(upto_a[end]), int(upto_b[end]), int(upto[end])
                found[whose[end]].add(to_a - a, to_b - b, links[g:to_g], "".join(words[a + b : to_a + to_b])[:-1])
                a, b, g = to_a, to_b, to_g
        self._forget()
        return found


_DOC = "block long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _first_pass(docs: DataFrame, a_path: str, b_path: str, kind: str, most_links: int) -> DataFrame:
    key = ("align", a_path, b_path)

    def run(batches):
        from pyspark import TaskContext

        aligner = resident(key, lambda: Aligner(a_path, b_path))
        block = TaskContext.get().partitionId() << 33
        held = 0
        for batch in batches:
            at = 0
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < 1 << 21):
                    chars += len(texts[end] or "")
                    end += 1
                cols: list[list] = [[] for _ in range(8)]
                for x in aligner.documents([t or "" for t in texts[at:end]]):
                    if held and held + x.n_groups > most_links:
                        block, held = block + 1, 0
                    held += x.n_groups
                    for c, own in zip(cols, (block, x.n_a, x.n_b, x.n_groups, x.n_groups, x.digest, x.pairs, x.times), strict=True):
                        c.append(own)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in cols[6]])]).astype(np.int32)
                nested = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c), t)) for c, t in ((cols[6], pa.int64()), (cols[7], pa.int32()))]
                longs = [pa.array(c, pa.int64()) for c in cols[:5]]
                yield pa.RecordBatch.from_arrays([longs[0], ids[at:end], *longs[1:], pa.array(cols[5], pa.string()), *nested], names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                at = end

    return map_batches(docs, run, _DOC.format(kind), keeps=key)


def _block_sums(aligned: DataFrame) -> DataFrame:
    """block, pair, n: the links of each block's documents that a task reads, summed up."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            for block, parts in held.items():
                pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([t for _, t in parts]), len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block, np.int64)), pa.array(pairs), pa.array(n)], names=["block", "pair", "n"])
            held.clear()

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for at in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
                if len(at):
                    own = batch.slice(int(at[0]), len(at))
                    pairs, times = own.column(1).flatten().to_numpy(), own.column(2).flatten().to_numpy()
                    held.setdefault(int(blocks[at[0]]), []).append((pairs, times))
                    size += len(pairs)
            if size > BLOCK_LINKS:
                yield from flush()
                size = 0
        yield from flush()

    return map_batches(aligned.select("block", "pairs", "times"), run, "block long, pair long, n long")


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", most_links: int = BLOCK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    n_best: links whose pair has the greatest count over all rows that its B id has with any A id; count_sum: the counts
    of all links, summed up. a_path: a byte-level tokenizer's file; b_path: a piece model's.
    """
    spark = docs.sparkSession
    ship(spark)
    own = pick(docs, doc_id=doc_id, text=text)
    path = scratch(spark, "align")
    _first_pass(own, a_path, b_path, own.schema["doc_id"].dataType.simpleString(), most_links).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    sums_path = scratch(spark, "align-sums")
    _block_sums(aligned).write.parquet(sums_path)
    sums = spark.read.parquet(sums_path).groupBy("block", "pair").agg(F.sum("n").alias("n"))
    counts = sums.groupBy("pair").agg(F.sum("n").alias("count"))
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    told = counts.withColumn("b", b_id).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    looked_up = sums.select("block", "pair").join(told, "pair")

    def finish(rows: pa.Table, table: pa.Table) -> pa.Table:
        pairs = table["pair"].to_numpy()
        order = np.argsort(pairs)
        pairs, count, best = pairs[order], table["count"].to_numpy()[order], table["best"].to_numpy()[order]
        lists = rows["pairs"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        at = np.searchsorted(pairs, lists.flatten().to_numpy())
        times = rows["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        total = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[upto[1:]] - s[upto[:-1]]
        n_best, count_sum = (total(times * best[at]), total(times * count[at])) if len(at) else (np.zeros(len(sizes), np.int64),) * 2
        out = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best.astype(np.int64)))
        return out.append_column("count_sum", pa.array(count_sum.astype(np.int64))).append_column("groups_sha256", rows["groups_sha256"])

    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    mine = aligned.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return mine.groupBy("block").cogroup(looked_up.groupBy("block")).applyInArrow(finish, schema)
