"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex. Each code point gets a class (letter, number, white space, other) from an array;
with one code point of lookahead it becomes an input symbol of a small automaton. A symbol acts on the automaton's
states as a function, functions compose associatively, and the finitely many composed functions have a multiplication
table. A blocked prefix scan over that table gives the state before every code point at once, and with it every
boundary. The slices between boundaries feed a cache of merged pieces.

Null texts count as empty; an empty text has no ids. Repeated rows and repeated or null ids give a row each.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.common import byte_groups, map_batches, pick, resident, text_groups, trim

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: States: nothing open, letter run, number run, other run, white space run, a space that the next run joins, and one
#: or two letters of a contraction still to come.
FRESH, IN_L, IN_N, IN_O, IN_W, GLUE, TAIL1, TAIL2 = range(8)
#: Symbols. SEP parts documents. MID: white space before white space or the end; LAST_SP, LAST_WS: the last of its run.
#: APOS1, APOS2: an apostrophe with a contraction of one or two letters behind it.
S_O, S_L, S_N, S_SEP, S_MID, S_LAST_SP, S_LAST_WS, S_APOS1, S_APOS2 = range(9)
#: The letters of contractions in the pattern.
ONE_LETTER, TWO_LETTERS = ("s", "t", "m", "d"), ("re", "ve", "ll")
BLOCK = 64
GROUP_CHARS = 1 << 21
CACHE_PIECES = 600_000
SHORT, NEVER = 32, (1 << 31) - 1
#: Bytes of the pieces that are merged at once: the arrays take some 60 times as much.
MERGED = 1 << 18


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts at this code point)"""
    if symbol == S_SEP:
        return FRESH, True
    if state == TAIL2:
        return TAIL1, False
    if state == TAIL1:
        return FRESH, False
    if symbol == S_MID:
        return IN_W, state != IN_W
    if symbol == S_LAST_SP:
        return GLUE, True
    if symbol == S_LAST_WS:
        return FRESH, True
    own = {S_L: IN_L, S_N: IN_N}.get(symbol, IN_O)
    if state in (own, GLUE):
        return own, False
    return {S_APOS1: TAIL1, S_APOS2: TAIL2}.get(symbol, own), True


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol to element, multiplication table, element and state to state, state and symbol to boundary)"""
    acts = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys(acts))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in dict.fromkeys(acts):
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    names = list(known)
    table = np.array([[known[tuple(g[s] for s in f)] for g in names] for f in names], np.uint16)
    return np.array([known[f] for f in acts], np.uint16), table, np.array(names, np.uint8), np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])


def _states(elements: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """The state before each position, and the last one, by a blocked scan that recurses on the blocks' products."""
    _, table, apply, _ = _monoid()
    n, m = len(elements), len(table)
    if n <= BLOCK:
        out, s = np.empty(n, np.uint8), start
        for i, e in enumerate(elements.tolist()):
            out[i], s = s, apply[e, s]
        return out, int(s)
    rows = -(-n // BLOCK)
    x = np.zeros(rows * BLOCK, np.uint16)
    x[:n] = elements
    x = np.ascontiguousarray(x.reshape(rows, BLOCK).T)
    flat = table.ravel()
    for j in range(1, BLOCK):
        x[j] = flat.take(x[j - 1].astype(np.int32) * m + x[j])
    before, _ = _states(x[-1], start)
    out = np.empty((BLOCK, rows), np.uint8)
    out[0] = before
    out[1:] = apply.ravel().take(x[:-1].astype(np.int32) * 8 + before)
    out = out.T.ravel()[:n]
    return out, int(apply[elements[-1], out[-1]])


def class_table() -> np.ndarray:
    """The class of every code point, as the tokenizer's own regex engine has it. 1.1 MB, whatever the input."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


def boundaries(texts: list[str], classes: np.ndarray) -> list[np.ndarray]:
    """For each text the code point offsets at which its pieces start."""
    if not texts:
        return []
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    seps = np.cumsum(lengths + 1) - 1
    kinds = classes.take(points)
    space = kinds == SPACE
    space[seps] = False
    ended = np.ones(len(points), bool)
    ended[:-1] = space[1:]
    ended[np.maximum(seps - 1, 0)] = True
    symbols = np.array([S_O, S_L, S_N, S_MID], np.uint8).take(kinds)
    last = space & ~ended
    symbols[last] = np.where(points[last] == 32, S_LAST_SP, S_LAST_WS)
    apostrophes = np.flatnonzero(points == 39)
    for at in apostrophes.tolist():
        if joined[at + 1 : at + 2] in ONE_LETTER:
            symbols[at] = S_APOS1
        elif joined[at + 1 : at + 3] in TWO_LETTERS:
            symbols[at] = S_APOS2
    symbols[seps] = S_SEP
    acts, _, _, starts = _monoid()
    states, _ = _states(acts.take(symbols), FRESH)
    found = np.flatnonzero(starts.ravel().take(states.astype(np.int32) * 9 + symbols))
    first = seps - lengths
    lo, hi = np.searchsorted(found, first), np.searchsorted(found, seps)
    return [found[a:b] - f for a, b, f in zip(lo.tolist(), hi.tolist(), first.tolist(), strict=True)]


class Pairs:
    """(left id, right id) to the id of their joined bytes: an open-addressed table probed for whole arrays at once.

    Ids are ranks, so the least value is the pair to merge first. NEVER stands for a pair that does not merge.
    """

    def __init__(self, joined: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in joined], np.int64)
        values = np.array(list(joined.values()), np.int32)
        self.bits = max(8, 2 + len(keys).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]], self.values[slots[free]] = keys[free], values[free]
            left = self.keys[slots] != keys  # taken before, or by another of this round
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        out, at = self.values[slots], self.keys[slots]
        out[(at != keys) & (at == -1)] = NEVER
        todo = np.flatnonzero((at != keys) & (at != -1))
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            at = self.keys[slots]
            out[todo] = np.where(at == keys[todo], self.values[slots], NEVER)
            more = (at != keys[todo]) & (at != -1)
            todo, slots = todo[more], slots[more]
        return out


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pairs: Pairs, last_ids: np.ndarray | None = None) -> list[bytes]:
    """Packed ids of many short pieces: each round merges every piece's lowest, leftmost pair and drops one column.

    last_ids: the ids of bytes that end a piece, where the vocabulary tells them apart.
    """
    width = max(map(len, pieces))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    out: list = [None] * len(pieces)
    who, ids = np.arange(len(pieces)), byte_ids.take(raw)
    if last_ids is not None:
        ids[who, lengths - 1] = last_ids.take(raw[who, lengths - 1])
    ranks = np.full((len(pieces), width), NEVER, np.int32)
    if width > 1:
        ranks[:, :-1] = pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        ranks[np.arange(width) >= (lengths - 1)[:, None]] = NEVER
    while len(who):
        at = ranks.argmin(1)
        low = ranks[np.arange(len(who)), at]
        over = low == NEVER
        if over.any():
            for w, row, n in zip(who[over].tolist(), np.ascontiguousarray(ids[over], "<u4"), lengths[over].tolist(), strict=True):
                out[w] = row[:n].tobytes()
            on = ~over
            who, ids, ranks, lengths, at, low = who[on], ids[on], ranks[on], lengths[on], at[on], low[on]
            if not len(who):
                break
        rows, width = np.arange(len(who)), ids.shape[1]
        ids[rows, at] = low
        keep = np.ones(ids.shape, bool)
        keep[rows, at + 1] = False
        ids = ids[keep].reshape(-1, width - 1)
        keep[rows, at + 1], keep[rows, at] = True, False
        ranks, lengths = ranks[keep].reshape(-1, width - 1), lengths - 1
        r = rows[at + 1 < lengths]  # the pair that starts at the merged id, and the one that ends there
        ranks[r, at[r]] = pairs.find(ids[r, at[r]], ids[r, at[r] + 1])
        ranks[rows[at + 1 >= lengths], at[at + 1 >= lengths]] = NEVER
        r = rows[at > 0]
        ranks[r, at[r] - 1] = pairs.find(ids[r, at[r] - 1], ids[r, at[r]])
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long piece: the same order of merges by a heap over a linked list, in n log n steps."""
    n = len(piece)
    ends, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, end = heapq.heappop(heap)
        right = ends[at]
        if not alive[at] or right >= n or ends[right] != end:
            continue
        alive[right] = False
        ends[at] = end
        if end < n:
            back[end] = at
            if (r := ranks.get(piece[at : ends[end]])) is not None:
                heapq.heappush(heap, (r, at, ends[end]))
        if (left := back[at]) >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return out


class Pieces(dict):
    """Piece to its ids as little-endian 32-bit integers. When full, only what the texts at hand need stays."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.pairs = Pairs({(ranks[w[:i]], ranks[w[i:]]): r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks})
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def prepare(self, wanted: set[str]) -> None:
        """Merges those of the wanted pieces that are short and not here yet, many at a time."""
        new = wanted.difference(self)
        if len(self) + len(new) > CACHE_PIECES:
            kept = [(p, self[p]) for p in wanted.difference(new)]
            self.clear()
            self.update(kept)
        by_width: dict[int, list[str]] = {}
        for piece in new:
            if (whole := self.ranks.get(raw := piece.encode())) is not None:
                self[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                by_width.setdefault((len(raw) + 3) // 4, []).append(piece)
        for width, pieces in by_width.items():
            most = MERGED // (4 * width)
            for lo in range(0, len(pieces), most):
                part = pieces[lo : lo + most]
                self.update(zip(part, merge_many([p.encode() for p in part], self.byte_ids, self.pairs), strict=True))

    def __missing__(self, piece: str) -> bytes:
        return np.array(_merge_long(piece.encode(), self.ranks), "<u4").tobytes()


class Codec:
    """One vocabulary: ranks, the pieces merged so far, and the bytes of every id with their offsets."""

    def __init__(self, path: str, classes: np.ndarray):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.classes, self.pieces = classes, Pieces(self.ranks)
        by_id = sorted(self.ranks.items(), key=lambda x: x[1])
        if [i for _, i in by_id] != list(range(len(by_id))):
            raise ValueError(f"the ids in {path} have gaps")
        self.words = [w for w, _ in by_id]
        self.lengths = np.fromiter(map(len, self.words), np.int32, len(self.words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian 32-bit integers."""
        out, get = [], self.pieces.__getitem__
        for lo, hi in text_groups(texts, GROUP_CHARS):
            group, slices = texts[lo:hi], []
            for text, cuts in zip(group, boundaries(group, self.classes), strict=True):
                at = cuts.tolist()
                at.append(len(text))
                slices.append([text[a:b] for a, b in zip(at, at[1:], strict=False)])
            self.pieces.prepare(set().union(*slices))
            out += [b"".join(map(get, x)) for x in slices]
            del slices
            trim()
        return out

    def offsets(self, packed: bytes) -> np.ndarray:
        """The byte offset of each id's bytes in the decoded text, and at the end its length."""
        ends = np.zeros(len(packed) // 4 + 1, np.int64)
        np.cumsum(self.lengths.take(np.frombuffer(packed, "<u4")), out=ends[1:])
        return ends

    def decode(self, packed: bytes, first: int = 0, last: int | None = None) -> bytes:
        """The bytes of ids first to last."""
        return b"".join(map(self.words.__getitem__, np.frombuffer(packed, "<u4")[first:last].tolist()))


def codec(path: str, classes: np.ndarray) -> Codec:
    """The worker's codec; tasks that follow each other in a worker share it."""
    return resident(("byte_bpe", path), lambda: Codec(path, classes))


SCHEMA = "doc_id {id}, n_tokens long, ids binary, offsets binary, decoded binary"


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, decode: bool = False) -> DataFrame:
    """Each text's ids by the rank file at vocabulary: doc_id, n_tokens, ids (little-endian 32-bit integers).

    offsets: also each id's byte offset in the text (little-endian 32-bit, with the end), so that any run of ids can
    be decoded or aligned by itself; else null. decode: also the bytes that the ids decode to; else null.
    Null text: no ids, and decoded bytes that are empty. The vocabulary file must be at the same path on every machine.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    classes = df.sparkSession.sparkContext.broadcast(class_table())

    def run(batches):
        own = codec(vocabulary, classes.value)
        for batch in batches:
            for lo, hi in byte_groups(batch.column(1), 4 * GROUP_CHARS):
                packed = own.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()),
                        pa.array([own.offsets(p).astype("<u4").tobytes() if offsets else None for p in packed], pa.binary()),
                        pa.array([own.decode(p) if decode else None for p in packed], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "offsets", "decoded"],
                )

    return map_batches(rows, run, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()), ("byte_bpe", vocabulary))


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes that the packed ids decode to; null ids decode to null, no ids to no bytes."""
    rows = pick(df, doc_id=id_col, ids=ids_col)
    classes = df.sparkSession.sparkContext.broadcast(class_table())

    def run(batches):
        own = codec(vocabulary, classes.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if p is None else own.decode(p) for p in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary", ("byte_bpe", vocabulary))
