"""Simple-8b word-aligned coding, vectorised both ways.

A 64-bit word holds a selector in its top four bits and up to 60 bits of values. Selectors 1 to 14 pack a fixed number
of values of equal width, 15 stands for up to 120 zeros, 0 for one value that needs more than 60 bits: its word holds
the value's place in a list of escapes. Values come in blocks; no word crosses a block, and the last word of a block
may be partly used, so a block can be decoded by itself from the offset of its first word.
"""

from __future__ import annotations

import numpy as np

#: How many values of how many bits selectors 1 to 14 pack.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ZEROS, ESCAPE, ZERO_RUN = 15, 0, 120
COUNTS = np.array([1, *(n for n, _ in PACKS), ZERO_RUN], np.int64)
BLOCK = 4096


def _widths(values: np.ndarray) -> np.ndarray:
    """The least width of a pack that holds each value; 0 for zero, 64 for what none holds."""
    widths = np.full(len(values), 64, np.uint8)
    for bits in sorted({b for _, b in PACKS}, reverse=True):
        widths[values < np.uint64(1 << bits)] = bits
    widths[values == 0] = 0
    return widths


_SMALL = _widths(np.arange(1 << 16, dtype=np.uint64))


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, the offset of each block's first word and at the end their number, escapes) of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    widths = _SMALL[values.astype(np.int64)] if values.max() < len(_SMALL) else _widths(values)
    padded = np.zeros((blocks, block + ZERO_RUN), np.uint8)  # what lies past a block's end fits anything
    flat = np.zeros(blocks * block, np.uint8)
    flat[:n] = widths
    padded[:, :block] = flat.reshape(blocks, block)
    sizes = np.minimum(n, (np.arange(blocks) + 1) * block) - np.arange(blocks) * block
    most, own_max = {1: padded.ravel()}, padded.ravel()  # the widest of each place's next 1, 2, 4, ... values
    for k in (1, 2, 4, 8, 16, 32):
        own_max = own_max.copy()
        np.maximum(own_max[:-k], own_max[k:], out=own_max[:-k])
        most[2 * k] = own_max
    pick = np.zeros(padded.size, np.uint8)
    for s, (count, bits) in reversed([*enumerate(PACKS, 1)]):
        half = 1 << (count.bit_length() - 1)
        widest = most[half] if count == half else np.maximum(most[half][: len(pick) - count + half], most[half][count - half :])
        np.copyto(pick[: len(widest)], s, where=widest <= bits)
    if (flat == 0).any():  # 120 is 64 and, 56 further on, 64 again
        np.copyto(pick[: len(pick) - 56], ZEROS, where=np.maximum(most[64][:-56], most[64][56:]) == 0)
    width, counts = block + ZERO_RUN, COUNTS[pick]
    on, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(on):
        here = on * width + at
        took = np.minimum(counts[here], sizes[on] - at)
        steps.append((on, on * block + at, took, pick[here]))
        at = at + took
        more = at < sizes[on]
        on, at = on[more], at[more]
    who, first, took, own = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(first, kind="stable")  # blocks are ascending, and so are the words in each
    first, took, own = first[order], took[order], own[order]
    offsets = np.zeros(blocks + 1, np.int64)
    np.cumsum(np.bincount(who, minlength=blocks), out=offsets[1:])
    words = own.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(PACKS, 1):
        rows = np.flatnonzero(own == s)
        for j in range(count if len(rows) else 0):
            here = rows[took[rows] > j]
            words[here] |= values[first[here] + j] << np.uint64(j * bits)
    escaped = np.flatnonzero(own == ESCAPE)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, offsets, values[first[escaped]]


def decode(words: np.ndarray, offsets: np.ndarray, n: int, escapes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The n values of whole blocks; offsets are of these blocks' words, from 0."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    sizes = np.diff(offsets)
    block_of = np.repeat(np.arange(len(sizes)), sizes)
    first = before - before[offsets[:-1]][block_of] + block_of * block  # only a block's last word can be partly used
    room = np.minimum(n, (block_of + 1) * block) - first
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(PACKS, 1):
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(rows) else 0):
            here = rows[room[rows] > j]
            out[first[here] + j] = (words[here] >> np.uint64(j * bits)) & mask
    rows = np.flatnonzero(selector == ESCAPE)
    out[first[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out
