"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary names every piece that ends at a place; the best segmentation of what lies
before it is known by then, so one pass carries, for each place, the best score and the number of pieces, and no path.
Ties go by the tokenizers library's rules: of equal scores the piece that starts first, and the unknown character, which
costs the least score minus 10, only where no piece of that one character is in the vocabulary. An unknown character
counts as its UTF-8 bytes, as with byte fallback. U+0020 becomes the mark that pieces begin with. With split, a part
starts at each mark, as with the library's Metaspace(split=True), and no piece goes beyond its part. Without, a part
starts at those marks only that no piece holds after the character that stands before them there, so that the parts'
best segmentations make up the best one of the whole text. Parts are segmented by themselves, so what a part came to
is kept in a cache.

Vocabularies: any list of (piece, score), or a sentencepiece model file, whose pieces and scores are read as a unigram
vocabulary whatever kind the model is. No public unigram model is at hand; the pieces of a BPE model with their scores
make one that the library can be held against.

Null texts count as empty and have no pieces and score 0. Repeated rows give a row each.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.common import map_batches, pick, resident, text_groups

MARK = "▁"
PENALTY = 10.0
CACHE_PARTS, CACHE_LENGTH = 500_000, 64


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if n == 8 else "<f", raw[at : at + n])[0], at + n
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of every piece of a sentencepiece model, in order of ids."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), piece.get(2, 0.0)))
    return out


def split_parts(text: str | None) -> list[str]:
    """The parts of a text, each with its mark. A mark is put before the text unless it starts with one."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    return [MARK + p for p in (parts[1:] if not parts[0] else parts)]


class Counter:
    """Counts pieces of texts by one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], split: bool = True):
        import ahocorasick

        crossing = set() if split else {a for piece, _ in pieces for a, b in zip(piece, piece[1:], strict=False) if b == MARK}
        self.crossings = [c + MARK for c in sorted(crossing)]
        self.uncut = re.compile(f"{MARK}(?:[^{MARK}]++|(?<=[{''.join(map(re.escape, sorted(crossing)))}]){MARK})*+") if crossing else None

        self.automaton, self.single = ahocorasick.Automaton(), set()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.parts: dict[str, tuple[int, float]] = {}

    def split(self, text: str | None) -> list[str]:
        """The parts of a text, so cut that no piece could cross, or at every mark."""
        if text and self.uncut:
            marked = text.replace(" ", MARK)
            marked = marked if marked.startswith(MARK) else MARK + marked
            if any(c in marked for c in self.crossings):
                return self.uncut.findall(marked)
        return split_parts(text)

    def part(self, text: str) -> tuple[int, float]:
        """(pieces, score) of one part, its mark included."""
        n = len(text)
        score, count, reached = [0.0] * (n + 1), [0] * (n + 1), 0
        # matches come by where they end; of those with one end, the longest comes first
        best, pieces, end = None, 0, 0
        for last, (length, own) in self.automaton.iter(text):
            if last + 1 != end:
                reached = self._close(text, reached, end, best, pieces, score, count)
                reached = self._fill(text, reached, last, score, count)
                best, end = None, last + 1
            start = end - length
            if best is None or score[start] + own > best:
                best, pieces = score[start] + own, count[start] + 1
        reached = self._close(text, reached, end, best, pieces, score, count)
        self._fill(text, reached, n, score, count)
        return count[n], score[n]

    def _close(self, text, reached, end, best, pieces, score, count) -> int:
        """Settles a place at which pieces end; the unknown character comes last, so it must be better."""
        if best is None:
            return reached
        c = text[end - 1]
        if c not in self.single and score[end - 1] + self.unknown > best:
            best, pieces = score[end - 1] + self.unknown, count[end - 1] + len(c.encode())
        score[end], count[end] = best, pieces
        return end

    def _fill(self, text, reached, upto, score, count) -> int:
        """Settles the places up to upto at which no piece ends."""
        for i in range(reached, upto):
            score[i + 1], count[i + 1] = score[i] + self.unknown, count[i] + len(text[i].encode())
        return max(reached, upto)

    def totals(self, texts: list[str | None]) -> list[tuple[int, float]]:
        """(pieces, score) of each text."""
        out, known = [], self.parts
        for lo, hi in text_groups([t or "" for t in texts], 1 << 21):
            split = [self.split(t) for t in texts[lo:hi]]
            wanted = set().union(*split)
            if len(known) > CACHE_PARTS:
                known.clear()
            for p in wanted.difference(known):
                known[p] = self.part(p)
            for s in split:
                n, score = 0, 0.0
                for a, b in map(known.__getitem__, s):
                    n += a
                    score += b
                out.append((n, score))
            for p in [p for p in wanted if len(p) > CACHE_LENGTH]:
                del known[p]
        return out


def counter(path: str, split: bool = True) -> Counter:
    return resident(("unigram", path, split), lambda: Counter(vocabulary(path), split))


def count(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", split: bool = True) -> DataFrame:
    """doc_id, n_tokens and score (the best segmentation's) of every row; model: a file at the same path on every machine; split: at every mark."""
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches):
        own = counter(model, split)
        for b in batches:
            found = own.totals(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double", ("unigram", model, split))
