"""Language-model scoring by a hashed maximum-entropy model.

A text's tokens are its words, A-Z in lower case, and one end. Each token is predicted from the three before it by four
features: the word before, the two before, the first and third before (skip feature), all three. The softmax is factored by nested classes down to the word: every class is two halves of about equal mass, and
a token's probability is that of each half on the way down. Words in the table (the frequent ones) have a leaf each. All
others share a class whose halves are the bits of the word's hash, as many as leave about a word a leaf; what a leaf
holds is shared by counts, with one unseen word. So every word, seen or not, has a path, and no word loses its identity.

Weights belong to (feature, class) pairs, hashed into tables. Contexts are dealt into shards by their last word, so that
all features of a token, and all weights that can meet them, are in one shard: shards learn apart, without exchange of
weights, and what they hold together grows with the tokens. A shard has about SHARD tokens. A word of more than LARGE is
dealt by the word before too, a pair of more than LARGE by the third, three words of more than LARGE by text, in parts of
about HOT, so that no context can fill a task. Such a context's tokens are in several shards, so what follows it is counted over all rows first,
and its weights are learned from these totals: as features are nested, all tokens of a context and a class have the same
odds when its weight is learned, so totals are all that the sums need, and of these, sums by halves of classes. A weight is learned from every token of its context.
GROUP shards travel together, with the totals that they need; what is learned from these is learned once a group.
The skip feature's weights are learned from the same odds as the pair's, those of the word before, so that counts are all
that it needs too. Where a common last word's tokens are dealt by the word before, a skip feature's tokens are in several shards: they are
gathered by feature in the pass over what follows words, and how many take each step of a path is sent to the shards that
have tokens of it, so that its weights are learned from all of its tokens. Tokens of three common words go without it.
The deal follows counts alone. A shard's update of a feature is the sum of the gradients of all its tokens over the sum
of their curvatures, with a Gaussian prior, one feature after another; the sums do not depend on how rows are laid out.

Texts are read once for counts (summed by shuffle), once for events, and between, if there are such contexts, once for
what follows words (for pairs and for three words once more each). Events go to their shards in packed blocks,
the log probabilities come back to the blocks' documents. Words outside the table go, in the same shuffle, to the groups that
have the counts of all words of their leaves, and what they add comes back likewise.

Which features there are follows from the rows that are learned from; rows that are scored have no say in it, nor in the
deal, unless they hold over four times as many tokens. They do in which ends of paths have one weight and which weights
need a table, as a row alone with its feature has its weights without one; so they shift what collides in the tables.

Null texts count as empty: they have the end alone. Rows with null ids are scored and never learned from. With nothing to
learn from, a score is that of one unseen word or end after another. Repeated rows give a row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import byte_groups, map_batches, pick, split_words, trim
from tapeloom.session import scratch

END, ALPHA, CONTEXT = b"\n", 0.1, 3
#: Bounds of what is broadcast: words with a leaf of their own (longer ones by digest). Tokens of a shard (its tables stay
#: in a core's cache), of a context that is not dealt further, and of the parts of larger ones; the shards that one group of rows holds, and how far
#: apart parts are dealt.
FREQUENT, LONGEST, SHARD, LARGE, HOT, GROUP, APART = 65_536, 64, 1 << 15, 1 << 19, 1 << 16, 32, 8
#: Precision of the prior of each feature: last word, last two, last three.
PRIOR = (0.6, 0.4, 0.4)
#: The same of the skip feature: last and third last.
SKIP_PRIOR = 0.4
_FLUSH, _SLICE, _RUN, _FRAME, _ENDS, _RARE, _PAD, _SEED = 1 << 21, 1 << 20, 1 << 15, 1 << 13, 4, 1 << 31, (1 << 31) - 1, 42
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

_XXH = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place among them of each text's words in turn, the words of each text), without the ends."""
    found, own, sizes = split_words(pc.ascii_lower(texts))
    long = np.flatnonzero(pc.greater(pc.binary_length(found), LONGEST).to_numpy(zero_copy_only=False))
    if len(long):
        every = found.to_pylist()
        for i in long.tolist():
            every[i] = short(every[i])
        found = pa.array(every, pa.binary())
    return found, own, sizes


def short(word: bytes) -> bytes:
    """The word, or of a long one a digest, which stands for it everywhere."""
    return word if len(word) <= LONGEST else b"\x00" + xxhash.xxh3_128_hexdigest(word).encode()


def rare_code(word: bytes) -> int:
    return _RARE | (xxhash.xxh64_intdigest(word, _SEED) >> 33)


def rare_codes(found: pa.Array) -> np.ndarray:
    """The same of an array of words."""
    return _codes(hashes(found))


def _codes(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.uint32) | np.uint32(_RARE)


def hashes(found: pa.Array) -> np.ndarray:
    """The XXH64 of words: those of a length together, those of 32 bytes and more one by one."""
    out = np.empty(len(found), np.uint64)
    if not len(found):
        return out
    begin = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    data, sizes = np.frombuffer(found.buffers()[2] or b"", np.uint8), np.diff(begin)
    by, ends = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable"), np.cumsum(np.bincount(np.minimum(sizes, 32), minlength=33))
    out[by[ends[31] :]] = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in found.take(pa.array(by[ends[31] :])).to_pylist()), np.uint64, len(by) - ends[31])
    a, b, c, d, e = _XXH
    for size in range(32):
        some = by[ends[size - 1] if size else 0 : ends[size]]
        if not len(some):
            continue
        letters, at = data[begin[some][:, None] + np.arange(size)], 0
        h = np.full(len(some), _SEED + int(e) + size & (1 << 64) - 1, np.uint64)
        for _ in range(size // 8):
            h = _turn(h ^ _turn(letters[:, at : at + 8].copy().view("<u8")[:, 0] * b, 31) * a, 27) * a + d
            at += 8
        if size - at >= 4:
            h = _turn(h ^ letters[:, at : at + 4].copy().view("<u4")[:, 0].astype(np.uint64) * a, 23) * b + c
            at += 4
        for i in range(at, size):
            h = _turn(h ^ letters[:, i].astype(np.uint64) * e, 11) * a
        h = (h ^ h >> np.uint64(33)) * b
        h = (h ^ h >> np.uint64(29)) * c
        out[some] = h ^ h >> np.uint64(32)
    return out


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _mix(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(29))


class Vocabulary:
    """The table's words with their counts, the tree of classes over them and all other words, and the deal of contexts."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, every: int | None = None):
        """n tokens and v words were learned from; every: the tokens of all rows, those not learned from included."""
        found = dict(zip(words, np.asarray(counts).tolist(), strict=True))
        found.setdefault(END, 0)
        order = sorted(found, key=lambda w: (-found[w], w))
        self.words, self.counts = order, np.array([found[w] for w in order], np.int64)
        self.n, self.v = n, v
        self.rare_words = max(0, v - int((self.counts > 0).sum()))
        self.bits = min(31, int(self.rare_words).bit_length()) if self.rare_words else 0
        self._grow(np.concatenate([[n - self.counts.sum()], self.counts]) + ALPHA)
        # by what is learned from, with room for a ninth as much that is only scored, unless that is far more
        times = max(10 / 9, (every or n) / (4 * max(n, 1)))
        self.shards = max(1, -(-int(n * times) // SHARD))
        tokens = np.ceil(self.counts * times).astype(np.int64)
        self.splits = np.where(tokens > LARGE, -(-tokens // HOT), 1)
        self.groups = -(-self.shards // GROUP)  # of shards; more of them have the words outside the table
        self.rare_groups = max(1, min(1 << self.bits, 1 << 14, int((n - self.counts.sum()) * times) // LARGE))

    def rare_group(self, h: np.ndarray) -> np.ndarray:
        """The group that has the leaf of words outside the table, given by hash."""
        leaf = h >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(h), np.uint64)
        return self.groups + (leaf * np.uint64(self.rare_groups) >> np.uint64(self.bits)).astype(np.int64)

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """In how many parts the contexts with these last words are dealt."""
        table = np.append(self.splits, 1)
        return np.where(codes == _PAD, self.splits[self.words.index(END)], table[np.minimum(codes, len(self.splits))])

    def _grow(self, mass: np.ndarray) -> None:
        """Halves sets of items (0: all words outside the table) by mass until one is left. Paths lie flat: item i has
        depth[i] steps from start[i]: the class's hash, the half that was taken, the log odds of the second half.
        A class's halves are the items from cuts[0] to cuts[1] and from there to cuts[2], in order of mass.
        """
        order = np.argsort(-mass, kind="stable")
        split = np.zeros(len(mass), np.uint8)  # steps that an item's path shares with the one before it in order
        upto = np.concatenate([[0.0], np.cumsum(mass[order])])
        paths, bias, cuts, todo = [()] * len(mass), [], [], [(0, len(mass), ())]
        while todo:
            lo, hi, path = todo.pop()
            if hi - lo == 1:
                paths[order[lo]] = path
                continue
            half = (upto[lo] + upto[hi]) / 2
            cut = min(max(int(np.searchsorted(upto, half)), lo + 1), hi - 1)
            if cut - 1 > lo and half - upto[cut - 1] < upto[cut] - half:
                cut -= 1
            node, split[cut] = len(bias), len(path)
            bias.append(np.log((upto[hi] - upto[cut]) / (upto[cut] - upto[lo])))
            cuts.append((lo, cut, hi))
            todo += [(lo, cut, (*path, 2 * node)), (cut, hi, (*path, 2 * node + 1))]
        self.depth = np.fromiter(map(len, paths), np.int64, len(paths))
        self.start = np.cumsum(self.depth) - self.depth
        flat = np.array([step for path in paths for step in path], np.int64)
        self.order, self.cuts, self.odds = order.astype(np.int32), np.array(cuts, np.int32).reshape(-1, 3).T.copy(), np.array(bias, np.float32)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.split = [split]  # the least of 1, 2, 4, ... in a row
        while len(self.split[-1]) > 1 << len(self.split) - 1:
            k = 1 << len(self.split) - 1
            self.split.append(np.minimum(self.split[-1][:-k], self.split[-1][k:]))
        self.second, self.bias = (flat & 1).astype(bool), self.odds[flat >> 1]
        self.sign = self.second.astype(np.float32) * 2 - 1
        self.signed = self.bias * self.sign
        self.hashes = _node_hash((flat >> 1).astype(np.uint64) + np.uint64(1 << 33))

    def _steps(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether outside the table, items, steps to the item, all steps) of each target."""
        rare = targets >= _RARE
        item = np.where(rare, 0, targets.astype(np.int64) + 1)
        own = self.depth[item]
        return rare, item, own, own + np.where(rare, self.bits, 0)

    def expand(self, targets: np.ndarray, less: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(steps of each target, class hashes, halves taken, log odds of the second halves) of the targets' paths, one after another.
        less: how many steps of a path to leave out at its end; only such by bits of the hash."""
        rare, item, own, steps = self._steps(targets)
        steps = steps - less
        n = int(steps.sum())
        hashes, second, bias = np.empty(n, np.uint32), np.empty(n, bool), np.empty(n, np.float32)
        for lo, hi, a, b in _runs(steps, _RUN):
            hashes[a:b], second[a:b], bias[a:b] = self._expand(targets[lo:hi], rare[lo:hi], self.start[item[lo:hi]], own[lo:hi], steps[lo:hi])
        return steps, hashes, second, bias

    def _expand(self, targets: np.ndarray, rare: np.ndarray, start: np.ndarray, own: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = _places(start, steps)
        if self.bits and len(at):
            np.minimum(at, len(self.second) - 1, out=at)
        hashes, second, bias = self.hashes[at], self.second[at], self.bias[at]
        if self.bits and rare.any():
            levels = (steps - own)[rare]
            place, level = _places((np.cumsum(steps) - steps + own)[rare], levels), _places(np.zeros(len(levels), np.int64), levels).astype(np.uint64)
            code = np.repeat(targets[rare].astype(np.uint64) & np.uint64(_RARE - 1), levels) >> (np.uint64(30) - level)  # down to the half taken
            hashes[place] = _node_hash((code >> np.uint64(1)) + (np.uint64(1) << level))
            second[place] = code & np.uint64(1)
            bias[place] = 0
        return hashes, second, bias

    def lay(self, targets: np.ndarray, columns: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class hashes, 1 for second halves and -1 for first, log odds of the halves taken) of the targets' paths, in columns."""
        rare, item, _, _ = self._steps(targets)
        start, low = self.start[item], targets & np.uint32(_RARE - 1)
        node, sign, z = (np.empty(columns.size, t) for t in (np.uint32, np.float32, np.float32))
        for step, lo, hi, a, b in columns.runs():
            at = start[lo:hi] + step
            for x, flat in ((node, self.hashes), (sign, self.sign), (z, self.signed)):
                np.take(flat, at, out=x[a:b], mode="clip")
            level = step - int(self.depth[0])
            if level >= 0 and self.bits and len(some := np.flatnonzero(rare[lo:hi])):
                code = low[lo:hi][some].astype(np.uint64) >> np.uint64(30 - level)  # down to the half taken
                some += a
                node[some] = _node_hash((code >> np.uint64(1)) + np.uint64(1 << level))
                sign[some] = (code & np.uint64(1)).astype(np.float32) * 2 - 1
                z[some] = 0
        return node, sign, z

    def places(self, targets: np.ndarray) -> np.ndarray:
        """The places of the targets' paths from left to right; targets of one leaf have the same."""
        rare, item, _, _ = self._steps(targets)
        rank, leaf = self.rank[item], (targets & np.uint32(_RARE - 1)) >> np.uint32(31 - self.bits)
        return rank + np.where(rare, leaf, np.where(rank > self.rank[0], (1 << self.bits) - 1, 0))

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many first steps two paths share; places, the first before the second."""
        rare, leaves = self.rank[0], 1 << self.bits
        a, b = (np.where(x < rare, x, np.maximum(rare, x - leaves + 1)) for x in (left, right))
        out = self.depth[0] + self.bits - np.frexp((left ^ right if not rare else (left - rare) ^ (right - rare)).astype(np.float64))[1]
        some = np.flatnonzero(a < b)
        a, b = a[some] + 1, b[some] + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[some[at]] = np.minimum(self.split[k][a[at]], self.split[k][b[at] - (1 << k)])
        return out

    def alone(self, targets: np.ndarray, context: np.ndarray) -> np.ndarray:
        """How many last steps, by bits of the hash, each target's path shares with no other target of its context; 0 if they
        are fewer than _ENDS, which are not worth being told apart."""
        steps = np.zeros(len(targets), np.int64)
        rare = np.flatnonzero(targets >= _RARE)
        if self.bits and len(rare):
            key = context[rare].astype(np.uint64) << np.uint64(32) | targets[rare]
            by = np.argsort(key)
            differ = key[by[1:]] ^ key[by[:-1]]
            same = np.where(differ < _RARE, 32 - np.frexp(differ.astype(np.float64))[1], 0)  # levels shared with the next one
            same = np.maximum(np.append(same, 0), np.append(0, same))
            own = self.bits - same
            steps[rare[by]] = np.where(own < _ENDS, 0, own)
        return steps


def _runs(steps: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts rows into runs (from, to, and the same of their steps) of about so many steps: what is made for a step and then
    dropped is held for one run only."""
    if not len(steps):
        return
    upto = np.concatenate([[0], np.cumsum(steps)])
    ends, at = np.append(np.searchsorted(upto, np.arange(size, int(upto[-1]), size)), len(steps)), 0
    for end in ends.tolist():
        if end > at:
            yield at, end, int(upto[at]), int(upto[end])
            at = end


def _places(begin: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each row, as many as it has steps, one row after another."""
    return np.arange(int(steps.sum())) + np.repeat(begin - (np.cumsum(steps) - steps), steps)


class Columns:
    """How the steps of paths lie, all first steps before all second ones, and so on. Rows are in the order of falling numbers
    of steps, so that a column is of the first rows, and what belongs to a row lies beside its steps as it is."""

    def __init__(self, steps: np.ndarray):
        self.steps = steps
        count = (len(steps) - np.cumsum(np.bincount(steps)))[:-1]
        self.begin, self.size = np.append(0, np.cumsum(count)).tolist(), int(count.sum())

    def runs(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Step, rows (from, to) and the same of their steps: what is made for a step and then dropped is held for one run only."""
        for step, (a, b) in enumerate(zip(self.begin, self.begin[1:], strict=False)):
            for lo in range(0, b - a, _RUN):
                hi = min(lo + _RUN, b - a)
                yield step, lo, hi, a + lo, a + hi

    def of(self, x: np.ndarray, step: int) -> np.ndarray:
        return x[self.begin[step] : self.begin[step + 1]]


def _falling(steps: np.ndarray) -> np.ndarray:
    return np.argsort((0xFFFF - steps).astype(np.uint16), kind="stable")


def _node_hash(node: np.ndarray) -> np.ndarray:
    return (_mix(node * _ODD[3]) * _ODD[0] >> np.uint64(32)).astype(np.uint32)


def _feature(before: np.ndarray) -> np.ndarray:
    """32-bit hashes of contexts of one, two or three words, given as rows (last, second last, third last)."""
    one, *more = (_mix((row.astype(np.uint64) + np.uint64(1)) * odd) for row, odd in zip(before, _ODD, strict=False))
    h = one
    if more:
        h = _mix(h * _ODD[3]) ^ more[0]
    if len(more) > 1:
        h = _mix(h * _ODD[1]) ^ (more[1] + _ODD[2])
    return (_mix(h) * _ODD[2] >> np.uint64(32)).astype(np.uint32)


def features(before: np.ndarray) -> list[np.ndarray]:
    """The hashes of the three features of contexts, given as rows (last, second last, third last)."""
    return [_feature(before[:length]) for length in range(1, CONTEXT + 1)]


def slots(feature: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The place of (feature, class) pairs in a table."""
    return ((feature ^ node) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int64)


def table_bits(steps: int) -> int:
    return min(23, max(8, int(steps).bit_length() + 1))


class Halves:
    """What follows a context, by the halves of classes that the targets' paths take: all tokens of a context and a class
    have the same odds when its weights are learned, so a half's sum stands for them. size: the steps of all targets."""

    def __init__(self, vocabulary: Vocabulary, context: np.ndarray, targets: np.ndarray, learned: np.ndarray, met: np.ndarray):
        self.context, self.tokens, self.met = context, int(learned.sum()), int(met.sum())
        rare, item, _, steps = vocabulary._steps(targets)
        self.size = int(steps.sum())
        # the table's classes are runs of items in their order
        sums, there = (np.bincount(item, weights=x, minlength=len(vocabulary.depth))[vocabulary.order] for x in (learned, None))
        upto, known = (np.concatenate([[0], np.cumsum(x)]) for x in (sums, there))
        node, found = _node_hash(np.arange(len(vocabulary.odds), dtype=np.uint64) + np.uint64(1 << 33)), []
        for second in (False, True):
            lo, hi = vocabulary.cuts[int(second) :][:2]
            some = np.flatnonzero(known[hi] > known[lo])
            found.append((node[some], np.full(len(some), second), vocabulary.odds[some], upto[hi[some]] - upto[lo[some]]))
        # the others' classes are runs of leaves: those of a level are two of the next
        if vocabulary.bits and rare.any():
            leaf = (targets[rare] & np.uint32(_RARE - 1)) >> np.uint32(31 - vocabulary.bits)
            by = np.argsort(leaf)
            leaf, sums = leaf[by].astype(np.uint64), learned[rare][by].astype(np.float64)
            for level in range(vocabulary.bits - 1, -1, -1):
                first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
                leaf, sums = leaf[first], np.add.reduceat(sums, first)
                second = (leaf & np.uint64(1)).astype(bool)
                leaf = leaf >> np.uint64(1)
                found.append((_node_hash(leaf + np.uint64(1 << level)), second, np.zeros(len(leaf), np.float32), sums))
        self.node, self.second, self.z, self.learned = (np.concatenate(x) for x in zip(*found, strict=True))


class Common:
    """The weights of a context that is learned from totals: class hashes in order, a weight for each."""

    def __init__(self, halves: Halves, shorter: list[Common]):
        """shorter: those of the context's last words, from one on, whose weights come first."""
        self.context, length = halves.context, len(halves.context)
        self.used = halves.tokens > 0
        order = np.argsort(halves.node)
        node, z, learned = halves.node[order], halves.z[order], halves.learned[order]
        for x in shorter:
            if x.used:
                z += x.weights(node)
        p = 1 / (1 + np.exp(-z.astype(np.float64)))
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
        gradient, curvature = (np.add.reduceat(x, first) if len(node) else x for x in (learned * (halves.second[order] - p), learned * p * (1 - p)))
        self.node = np.append(node[first], np.uint32((1 << 32) - 1))  # the last one ends every search
        self.weight = np.append(gradient / (curvature + PRIOR[length - 1]), 0).astype(np.float32)
        bits = len(first).bit_length()
        self.shift = np.uint32(32 - max(1, bits))
        self.start = np.searchsorted(self.node[:-1], np.arange(1 << max(1, bits), dtype=np.uint32) << self.shift).astype(np.int32)

    def weights(self, node: np.ndarray) -> np.ndarray:
        """The weights of the classes, 0 of those that the totals lack."""
        at = self.start[node >> self.shift]
        todo = np.flatnonzero(self.node[at] < node)
        while len(todo):
            at[todo] += 1
            todo = todo[self.node[at[todo]] < node[todo]]
        return np.where(self.node[at] == node, self.weight[at], np.float32(0))


def learn_totals(vocabulary: Vocabulary, totals: list[tuple]) -> list[Common]:
    """The weights of contexts from totals of all that follows them (context, targets, weights, copies). A context's last words
    must be among them: the weights of three words build on those of the last two, and these on those of the last one."""
    known: dict = {}
    for t in sorted(totals, key=lambda t: len(t[0])):
        context = tuple(t[0].tolist())
        known[context] = Common(Halves(vocabulary, *t), [known[context[:i]] for i in range(1, len(context))])
    return list(known.values())


class Skips:
    """The skip feature of events: their last and third last words. Its weights are learned from the odds of the last word, as
    those of pairs are, so that all tokens of a feature and a class have the same odds and counts stand for them. A row is a
    feature with a path; rows lie in the order of the paths, where those that share first steps are neighbours."""

    def __init__(self, vocabulary: Vocabulary, events: np.ndarray, weight: np.ndarray):
        self.vocabulary = vocabulary
        key = _feature(events[[1, 3]]).astype(np.uint64) << np.uint64(32) | vocabulary.places(events[0]).astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.up = np.empty(len(key), np.int64)
        self.up[order] = np.cumsum(new) - 1
        self.keys, self.own = key[new], np.bincount(self.up, weights=weight)
        feature = self.keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
        sizes = np.diff(np.append(first, len(feature)))
        self.tokens, self.lone = np.repeat(np.add.reduceat(self.own, first), sizes), np.repeat(sizes == 1, sizes)
        self.used = self.tokens > 0

    def counts(self, here: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Step by step, how many tokens of a row's feature take that step of its path: (step, rows among those here, tokens).
        Rows alone with their feature are left out: theirs are their own."""
        some = np.flatnonzero(~self.lone[here])
        if not len(some):
            return
        own, size, key = self.own[here[some]].astype(np.float32), size[some], self.keys[here[some]]
        feature, place = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = np.full(len(some), -1)
        next_ = np.flatnonzero(feature[1:] == feature[:-1]) + 1
        same[next_] = self.vocabulary.shared(place[next_ - 1], place[next_])
        for step in range(int(same.max()) + 1):
            if len(there := np.flatnonzero(size > step)):
                first = np.flatnonzero(same[there] <= step)
                yield step, some[there], np.repeat(np.add.reduceat(own[there], first), np.diff(np.append(first, len(there))))

    def learn(self, last: np.ndarray, columns: Columns, z: np.ndarray, end_z: np.ndarray, given: Given | None) -> None:
        """last: the place of each event's (target, last word) among the paths, which are given with their log odds."""
        at = np.empty(len(self.keys), np.int64)
        at[self.up] = last
        here = np.flatnonzero(self.used)
        size = columns.steps[at[here]]
        order = here[_falling(size)]
        self.row = np.zeros(len(self.keys), np.int64)  # the first one stands for all that have no weight
        self.row[order] = np.arange(1, len(order) + 1)
        at, own, total = (np.append(0, x[order]) for x in (at, self.own, self.tokens))
        self.columns = Columns(columns.steps[at])
        taken, step_own, begin = np.empty(self.columns.size, np.float32), own.astype(np.float32), np.array(self.columns.begin)
        for _, lo, hi, a, b in self.columns.runs():
            taken[a:b] = step_own[lo:hi]
        row = self.row[here]
        for step, some, tokens in self.counts(here, size):
            taken[begin[step] + row[some]] = tokens
        if given is not None:
            given.fill(self, here, size, begin, taken, total)
        total, likely = total.astype(np.float32), np.empty(len(z), np.float32)
        for _, _, _, a, b in columns.runs():
            likely[a:b] = _sigmoid(z[a:b])
        self.end_step = _end_step(end_z[at], own, SKIP_PRIOR)
        self.step = np.empty(len(taken), np.float32)
        for step, lo, hi, a, b in self.columns.runs():
            p = np.take(columns.of(likely, step), at[lo:hi], mode="clip")
            before = (self.columns.of(taken, step - 1) if step else total)[lo:hi] * p
            gradient = taken[a:b] - before
            p -= 1
            before *= p
            np.subtract(np.float32(SKIP_PRIOR), before, out=before)
            np.divide(gradient, before, out=self.step[a:b])


class Given:
    """Skip counts of features of which not all tokens are here: the codes of their last words, and by key, the tokens of the
    feature and of the path, and where its first steps are taken by more tokens, how many steps and by how many."""

    def __init__(self, last: np.ndarray, keys: np.ndarray, tokens: np.ndarray, own: np.ndarray, steps: np.ndarray, taken: np.ndarray):
        order = np.argsort(keys)
        self.last, self.keys, self.tokens, self.own = last, keys[order], tokens[order], own[order]
        self.begin, self.steps, self.taken = (np.cumsum(steps) - steps)[order], steps[order], taken

    def find(self, skips: Skips, events: np.ndarray) -> None:
        """Finds the rows that counts are given for; of the others all tokens are here."""
        self.dealt, self.at = np.zeros(len(skips.keys), bool), np.zeros(len(skips.keys), np.int64)
        if len(self.keys):
            self.dealt[skips.up[np.isin(events[1], self.last)]] = True
            some = np.flatnonzero(self.dealt)
            self.at[some] = np.minimum(np.searchsorted(self.keys, skips.keys[some]), len(self.keys) - 1)
            self.dealt[some] = self.keys[self.at[some]] == skips.keys[some]
            skips.used |= self.dealt

    def fill(self, skips: Skips, here: np.ndarray, size: np.ndarray, begin: np.ndarray, taken: np.ndarray, total: np.ndarray) -> None:
        some = np.flatnonzero(self.dealt[here])
        if not len(some):
            return
        row, at, size = skips.row[here[some]], self.at[here[some]], size[some]
        total[row] = self.tokens[at]
        own, more, first = self.own[at], np.minimum(self.steps[at], size), self.begin[at]
        for step in range(int(size.max())):
            there = np.flatnonzero(size > step)
            taken[begin[step] + row[there]] = own[there]
            there = np.flatnonzero(more > step)
            taken[begin[step] + row[there]] = self.taken[first[there] + step]


def skip_counts(vocabulary: Vocabulary, events: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place of each event's row among what follows, -1 without; the rest as Given has it) from all events of some skip features."""
    skips = Skips(vocabulary, events, weight)
    here, target = np.flatnonzero(skips.used), np.empty(len(skips.keys), np.uint32)
    target[skips.up] = events[0]
    size = vocabulary._steps(target[here])[3]
    place = np.full(len(skips.keys), -1)
    place[here] = np.arange(len(here))
    first = np.cumsum(size) - size
    taken = np.repeat(skips.own[here].astype(np.float32), size)
    for step, some, tokens in skips.counts(here, size):
        taken[first[some] + step] = tokens
    more = taken > np.repeat(skips.own[here], size)
    steps = np.add.reduceat(np.append(more, False), first, dtype=np.int64) if len(here) else size
    return place[skips.up], skips.keys[here], skips.tokens[here], skips.own[here], steps, taken[more]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    p = np.negative(z)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _end_step(z: np.ndarray, weight: np.ndarray, prior: float) -> np.ndarray:
    """The step of the one weight of a path's end."""
    p = 1 / (1 + np.exp(-z))
    return weight * (1 - p) / (weight * p * (1 - p) + prior)


def _levels(events: np.ndarray, weight: np.ndarray, totals: list[Common], skips: Skips | None) -> tuple[list[tuple], list[np.ndarray]]:
    """For three words, two and one: the distinct rows with what is learned of them, and each row's place among the next ones."""
    sets, ups, rows, members = [], [], events, (weight > 0).astype(np.int64)
    for length in range(CONTEXT, 0, -1):
        if length < CONTEXT:
            rows, up = _distinct(rows[: length + 1])
            weight, members = (np.bincount(up, weights=x, minlength=rows.shape[1]) for x in (weight, members))
            ups.append(up)
        own, common, others, feature = weight, [], np.ones(rows.shape[1], bool), _feature(rows[1:])
        for t in totals:
            if len(t.context) == length and (mine := (rows[1:] == t.context[:, None]).all(axis=0)).any():
                own = np.where(mine, 0, own)
                others &= ~mine
                if t.used:
                    common.append((t, np.flatnonzero(mine)))
        learned, lone = _learned_from(feature, own)
        learned &= others
        kept = np.full(rows.shape[1], length == 1)
        kept |= learned
        for _, at in common:
            kept[at] = True
        if ups:  # and what is extended by such rows
            kept[ups[-1][sets[-1][-1]]] = True
        elif skips:
            skips.apply = skips.used[skips.up] & others  # three common words tell what the skip feature does
            kept |= skips.apply
        sets.append((rows, feature, own, members, np.flatnonzero(learned & ~lone), common, np.flatnonzero(learned & lone), kept))
    return sets, ups


def learn_and_score(vocabulary: Vocabulary, events: np.ndarray, weight: np.ndarray, totals: list = (), skip: bool = False, given: Given | None = None) -> np.ndarray:
    """The natural log of the probability of each event's path. events: distinct rows (target, last, second last, third
    last); weight: how often each is learned from.
    totals: of contexts of which not all events are here, as learn_totals takes or gives them; context: codes from the last on.
    skip: with the skip feature; given: its counts for the last words among totals.

    A row whose context has no weight has the odds of the row of fewer words that it extends: it has no steps of its own."""
    if totals and not isinstance(totals[0], Common):
        totals = learn_totals(vocabulary, totals)
    skips = Skips(vocabulary, events, weight) if skip else None
    if skips and given is not None:
        given.find(skips, events)
    sets, ups = _levels(events, weight, totals, skips)
    scores = above = None
    for length, prior in enumerate(PRIOR, 1):
        rows, feature, own, members, few, common, lone, kept = sets[CONTEXT - length]
        here = np.flatnonzero(kept)
        if length == 1:
            alone = vocabulary.alone(rows[0], rows[1])  # what is met nowhere else in a context has the same odds at every step
            for _, at in common:
                alone[at] = 0
            steps = vocabulary._steps(rows[0])[3] - alone
            here = _falling(steps)
            columns = one = Columns(steps[here])
            if not one.size:
                return np.zeros(events.shape[1])
            alone, end_z, top = alone[here], np.zeros(len(here)), np.arange(len(here))
            node, sign, z = vocabulary.lay(rows[0][here], one)
        else:
            up = ups[CONTEXT - length]
            above = place[up[here]]
            order = _falling(columns.steps[above])
            here, above, before, old = here[order], above[order], columns, z
            columns = Columns(before.steps[above])
            alone, end_z, top, z = alone[above], end_z[above], top[above], np.empty(columns.size, np.float32)
            skip_row = np.where(skips.apply[here], skips.row[skips.up[here]], 0) if length == CONTEXT and skips else None
            if skip_row is not None:
                end_z += skips.end_step[skip_row]
            for step, lo, hi, a, b in columns.runs():
                np.take(before.of(old, step), above[lo:hi], out=z[a:b], mode="clip")
                if skip_row is not None:
                    z[a:b] += np.take(skips.columns.of(skips.step, step), skip_row[lo:hi], mode="clip")
            del old
        places = lambda at: np.flatnonzero(_among(at, len(kept))[here])  # noqa: E731, B023
        at = places(few)
        size = int((members[here[at]] * (columns.steps + alone)[at]).sum()) * (4 if common else 1)
        _learn(feature[here[at]], prior, own[here[at]], size, columns, at, one, top[at], node, sign, z)
        end_z[at] += _end_step(end_z[at], own[here[at]], prior)
        at = places(lone)
        _learn_alone(prior, own[here[at]], columns, at, z)
        end_z[at] += _end_step(end_z[at], own[here[at]], prior)
        for t, at in common:
            at = places(at)
            for step, lo, hi, _, _ in Columns(columns.steps[at]).runs():
                path = top[at[lo:hi]]
                columns.of(z, step)[at[lo:hi]] += one.of(sign, step)[path] * t.weights(one.of(node, step)[path])
        place = np.full(len(kept), -1)
        place[here] = np.arange(len(here))
        if length == 1 and skips:
            skips.learn(place[ups[1][ups[0]]], columns, z, end_z, given)
        ended = kept.copy()
        if length < CONTEXT:
            ended[:] = False
            ended[ups[CONTEXT - length - 1][~sets[CONTEXT - length - 1][-1]]] = True
            ended &= kept
        at = np.flatnonzero(ended[here])
        scores = np.zeros(len(kept)) if scores is None else scores[up]
        scores[here[at]] = _path_scores(columns, at, z) - alone[at] * np.logaddexp(0, -end_z[at])
    return scores


def _among(at: np.ndarray, n: int) -> np.ndarray:
    """Whether each of so many rows is among these."""
    found = np.zeros(n, bool)
    found[at] = True
    return found


def _path_scores(columns: Columns, rows: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The log probabilities of some rows' paths, from the log odds of the halves taken at their steps."""
    scores, product, every = np.zeros(len(rows)), np.ones(len(rows)), len(rows) == len(columns.steps)
    own = columns if every else Columns(columns.steps[rows])
    for step, lo, hi, a, b in own.runs():
        odds = z[a:b] if every else np.take(columns.of(z, step), rows[lo:hi])
        if odds.min() < -80:  # the product of eight may be beyond what a float holds
            scores[lo:hi] -= np.logaddexp(0, -odds.astype(np.float64))
            continue
        inverse = np.negative(odds)
        np.exp(inverse, out=inverse)
        inverse += 1
        product[lo:hi] *= inverse
        if step % 8 == 7:
            scores[lo:hi] -= np.log(product[lo:hi])
            product[lo:hi] = 1
    return scores - np.log(product)


def _learn(feature: np.ndarray, prior: float, weight: np.ndarray, size: int, columns: Columns, rows: np.ndarray, one: Columns, top: np.ndarray, node: np.ndarray, sign: np.ndarray, z: np.ndarray) -> None:
    """Adds a feature's weights to z, the log odds of the halves that paths take, in columns, by its sums over some rows. feature
    and weight are of these rows, top tells the places of their paths' classes and halves (sign: 1 if second, else -1) in other
    columns. size: for how many pairs of feature and class the tables are made. Unless exact, gradients
    and curvatures go as counts of 1/1024 in the two halves of one float, which holds the sums of up to 2^17 tokens without rounding."""
    own = Columns(columns.steps[rows])
    if not own.size:
        return
    slices = 1 << (-(-own.size // _SLICE) - 1).bit_length()
    bits = table_bits(-(-size // slices))
    exact, times = weight.sum() > 1 << 17, (weight * 1024).astype(np.float32) if (weight != 1).any() else None
    place, first, other = np.empty(own.size, np.int64), np.empty(own.size), np.empty(own.size if exact else 0)
    features, classes, half, odds = (np.empty(own.size, t) for t in (np.uint32, np.uint32, np.float32, np.float32))
    each = None if times is None else np.empty(own.size, np.float32)
    for i in range(slices):  # classes learn apart
        held, k = [], 0
        for step, lo, hi, _, _ in own.runs():
            at, path, some = rows[lo:hi], top[lo:hi], slice(lo, hi)
            found = np.take(one.of(node, step), path)
            if slices > 1:
                some = np.flatnonzero(found & np.uint32(slices - 1) == i)
                at, path, found, some = at[some], path[some], found[some], some + lo
            mine = slice(k, k + len(at))
            held.append((step, at, mine))
            k = mine.stop
            features[mine], classes[mine] = feature[some], found
            np.take(one.of(sign, step), path, out=half[mine], mode="clip")
            np.take(columns.of(z, step), at, out=odds[mine], mode="clip")
            if each is not None:
                each[mine] = times[some]
        runs = [slice(a, min(a + _RUN, k)) for a in range(0, k, _RUN)]
        for run in runs:
            place[run] = slots(features[run], classes[run], bits)
            p, t = _sigmoid(odds[run]), np.float32(1024) if each is None else each[run]
            gradient = 1 - p
            p *= gradient
            gradient *= half[run]
            gradient *= t
            p *= t
            if exact:
                first[run], other[run] = gradient, p
            else:
                np.rint(p, out=p)
                p *= 1 << 28
                np.rint(gradient, out=gradient)
                np.add(p, gradient, out=first[run], dtype=np.float64)
        sums = [np.bincount(place[:k], weights=x[:k], minlength=1 << bits) for x in ((first, other) if exact else (first,))]
        for run in runs:
            gradient = sums[0][place[run]]
            if exact:
                curvature = sums[1][place[run]]
            else:
                curvature = gradient * (1 / (1 << 28))
                np.rint(curvature, out=curvature)
                gradient -= curvature * (1 << 28)
            curvature += prior * 1024
            gradient /= curvature
            gradient *= half[run]
            odds[run] += gradient
        for step, at, mine in held:
            columns.of(z, step)[at] = odds[mine]


def _learned_from(feature: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a feature was learned from; whether its row is alone with it). Rows that are only scored have no say in the first."""
    bits = min(24, max(16, int(np.count_nonzero(weight)).bit_length() + 2))
    kept = (feature >> np.uint32(32 - bits)).astype(np.int64)
    return (np.bincount(kept, weights=weight, minlength=1 << bits) > 0)[kept], (np.bincount(kept, minlength=1 << bits) == 1)[kept]


def _learn_alone(prior: float, weight: np.ndarray, columns: Columns, rows: np.ndarray, z: np.ndarray) -> None:
    """What _learn() does for rows that are each alone with their feature: a weight's sums are those of one step, so no table is needed."""
    times = weight.astype(np.float32) if (weight != 1).any() else None
    for step, lo, hi, _, _ in Columns(columns.steps[rows]).runs():
        own = np.take(columns.of(z, step), rows[lo:hi])
        p = _sigmoid(own)
        gradient = 1 - p
        p *= gradient
        if times is not None:
            gradient *= times[lo:hi]
            p *= times[lo:hi]
        p += np.float32(prior)
        gradient /= p
        own += gradient
        columns.of(z, step)[rows[lo:hi]] = own


class Coder:
    """Words to codes: places in the table, or hashes."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = pa.array(vocabulary.words, pa.binary())
        self.end = vocabulary.words.index(END)

    def code(self, found: pa.Array) -> np.ndarray:
        return self.look(found)[0]

    def look(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, which words are not in the table, their hashes)"""
        place = pc.index_in(found, value_set=self.table)
        outside = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        codes = pc.fill_null(place, 0).to_numpy().astype(np.uint32)
        h = hashes(found.take(pa.array(outside)))
        codes[outside] = _codes(h)
        return codes, outside, h

    def texts(self, own: np.ndarray, codes: np.ndarray, sizes: np.ndarray, end: int | None = None) -> np.ndarray:
        """The codes of the texts' words, each text with its end."""
        out = np.full(len(own) + len(sizes), self.end if end is None else end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        out[inside] = codes[own]
        return out


def events(codes: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows (target, last, second last, third last) of the tokens at the places, each with so many before it in its text."""
    out = np.full((CONTEXT + 1, len(at)), _PAD, np.uint32)
    out[0] = codes[at]
    for i in range(1, CONTEXT + 1):
        inside = before >= i
        out[i, inside] = codes[at[inside] - i]
    return out


class Contexts:
    """The contexts that are dealt over several shards, by length: codes from the last on, in how many parts. A context is
    found by its place among those of its length; one of two or three words extends one that is here."""

    def __init__(self, vocabulary: Vocabulary):
        codes = np.append(np.flatnonzero(vocabulary.splits > 1), _PAD).astype(np.uint32)
        parts = vocabulary.parts(codes)
        self.keys, self.codes, self.parts = [], [], []
        self._add(codes[parts > 1][:, None], parts[parts > 1])

    def _add(self, codes: np.ndarray, parts: np.ndarray) -> None:
        last = codes[:, -1].astype(np.int64)
        keys = self.places(codes[:, :-1].T)[-1] << 32 | last if self.keys else last
        known = np.flatnonzero(keys >= 0)
        order = known[np.argsort(keys[known])]
        for have, x in zip((self.keys, self.codes, self.parts), (keys, codes, parts), strict=True):
            have.append(x[order])

    def places(self, before: np.ndarray) -> list[np.ndarray]:
        """The places of contexts, given as rows (last, second last, ...), among those of each length; -1: not here."""
        found, place = [], np.zeros(before.shape[1], np.int64)
        for keys, row in zip(self.keys, before, strict=False):
            key = place << 32 | row.astype(np.int64)
            place = np.full(len(key), -1, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                place = np.where(keys[at] == key, at, -1)
            found.append(place)
        return found

    def extend(self, place: np.ndarray, target: np.ndarray, there: np.ndarray, starts: int) -> None:
        """Adds contexts of one word more, from counts of what follows those of the greatest length (of more than LARGE
        tokens), and of the texts that start."""
        codes = np.column_stack([target.astype(np.uint32), self.codes[-1][place]])
        if starts > LARGE:
            codes, there = np.vstack([codes, np.full(codes.shape[1], _PAD, np.uint32)]), np.append(there, starts)
        self._add(codes, -(-there // HOT))

    def groups(self, vocabulary: Vocabulary) -> dict[tuple[int, int], list[int]]:
        """(length, place): the groups of shards to which tokens of the context are dealt."""
        where: dict = {}
        for length, (codes, parts) in enumerate(zip(self.codes, self.parts, strict=True), 1):
            for context, k in zip(codes, parts.tolist(), strict=True):
                base = _base(vocabulary, _keys(context[:, None])[length - 1])
                own = set((_part(vocabulary, base, np.arange(k), np.int64(k)) // GROUP).tolist())
                for i, place in enumerate(self.places(context[:, None]), 1):
                    where.setdefault((i, int(place[0])), set()).update(own)
        return {k: sorted(x) for k, x in where.items()}


def _keys(before: np.ndarray) -> list[np.ndarray]:
    """Hashes of contexts' last word, last two, last three, from as many rows as are given."""
    found = []
    for i, row in enumerate(before):
        own = (row.astype(np.uint64) + np.uint64(1)) * _ODD[i]
        found.append(_mix((found[-1] ^ own) * _ODD[i]) if found else _mix(own))
    return found


def _base(vocabulary: Vocabulary, key: np.ndarray) -> np.ndarray:
    return ((key * _ODD[3] >> np.uint64(32)) * np.uint64(vocabulary.shards) >> np.uint64(32)).astype(np.int64)


def _part(vocabulary: Vocabulary, base: np.ndarray, part: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The shard of a part of a context whose first part is dealt to base; all parts have their own, as far as there are so many."""
    return (base + part * np.clip(vocabulary.shards // parts, 1, APART)) % vocabulary.shards


def _way(by: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part, of so many, that tokens go to by their hash."""
    return (_mix(by * _ODD[2]) >> np.uint64(16)).astype(np.int64) % parts


def deal(vocabulary: Vocabulary, rows: np.ndarray, salt: np.ndarray, contexts: Contexts | None = None) -> np.ndarray:
    """The shard of each event. Contexts of a common last word are dealt by the second too, those of a common pair by the
    third, and those of three common words by salt. As long as they are not counted, a pair, and any three words, are taken
    to be as common as the rarer of the last two."""
    first = vocabulary.parts(rows[1])
    shard = _base(vocabulary, _keys(rows[1:2])[0])
    some = np.flatnonzero(first > 1)
    if not len(some):
        return shard
    before, salt, own = rows[1:, some], salt[some], first[some]
    if contexts is None:
        pair = np.minimum(own, vocabulary.parts(before[1]))
        parts = [own, pair, pair]
    else:
        found = contexts.places(before) if any(map(len, contexts.keys[1:])) else []
        parts = [own] + [np.where(at >= 0, np.append(k, 1)[at], 1) for at, k in zip(found[1:], contexts.parts[1:], strict=False)]
    key = _keys(before[: len(parts) + 1])
    place = shard[some]
    for i, k in enumerate(parts):
        by = key[i + 1] if i + 1 < CONTEXT else salt
        part = _way(by, k)
        place = np.where(k > 1, _part(vocabulary, _base(vocabulary, key[i]), part, k), place)
    shard[some] = place
    return shard


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another; 32-bit ones as two planes of 16 bits, of which the upper is mostly zero."""
    raw = b"".join(p.tobytes() for a in arrays for p in (a.astype("<u4", copy=False).view("<u2").reshape(-1, 2).T if a.dtype == np.uint32 else [a]))
    return pa.compress(raw, codec="zstd", asbytes=True)


def _planes(x: np.ndarray, fine: bool = False) -> list[np.ndarray]:
    """The lower and the upper 16 bits of 32-bit numbers; fine: the lower ones byte by byte."""
    low, high = np.ascontiguousarray(x, "<u4").view("<u2").reshape(-1, 2).T
    return [*((low & 0xFF).astype(np.uint8), (low >> 8).astype(np.uint8)), high] if fine else [low, high]


#: Bytes of numbers of a token, one after another, in the planes of a block: target, last word, second last, third last, text.
_WIDE = (2, 2, 2, 2, 1, 1, 2, 2, 2, 1, 1, 2)


def _frames(n: int) -> list[tuple[int, int]]:
    """Which planes of a block of so many tokens (from, to) are compressed together: each alone, if it is not small."""
    cuts = [0]
    for i in range(1, len(_WIDE) + 1):
        if i == len(_WIDE) or sum(_WIDE[cuts[-1] : i]) * n >= _FRAME:
            cuts.append(i)
    return list(zip(cuts, cuts[1:], strict=False))


def _pack_events(rows: np.ndarray, doc: np.ndarray, shard: np.ndarray, learned: int) -> bytes:
    """Events (target, last, second last, third last) of a group of shards, sorted by shard, last and second last, with their texts, of
    which the first ones are learned from. Last words go as steps, second last ones too as long as the last is the same."""
    each = np.bincount(shard, minlength=GROUP).astype("<u4")
    last, second = np.diff(rows[1], prepend=np.uint32(0)), np.diff(rows[2], prepend=np.uint32(0))
    first = last != 0
    first[(np.cumsum(each) - each)[each > 0]] = True
    second[first] = rows[2][first]
    planes = [*_planes(rows[0]), *_planes(last), *_planes(second, True), *_planes(rows[3]), *_planes(doc, True)]
    bodies = [pa.compress(b"".join(x.tobytes() for x in planes[lo:hi]), codec="zstd", asbytes=True) for lo, hi in _frames(rows.shape[1])]
    return b"".join([np.array([learned, *each, *map(len, bodies)], "<u4").tobytes(), *bodies])


def _unpack_events(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(events, texts' places in the flush, whether learned, shards' places in the group)"""
    frames, planes = _frames(n), []
    head = np.frombuffer(body, "<u4", 1 + GROUP + len(frames))
    learned, each, at, view = head[0], head[1 : 1 + GROUP], head.nbytes, memoryview(body)
    for (lo, hi), size in zip(frames, head[1 + GROUP :].tolist(), strict=True):
        raw, begin = pa.decompress(view[at : at + size], decompressed_size=sum(_WIDE[lo:hi]) * n, codec="zstd"), 0
        at += size
        for wide in _WIDE[lo:hi]:
            planes.append(np.frombuffer(raw, f"<u{wide}", n, begin))
            begin += wide * n
    rows, doc = np.empty((CONTEXT + 1, n), np.uint32), np.empty(n, np.uint32)
    for x, own in zip((*rows, doc), (planes[:2], planes[2:4], planes[4:7], planes[7:9], planes[9:]), strict=True):
        half = x.view("<u2").reshape(-1, 2)
        half[:, 1] = own[-1]
        half[:, 0] = own[0]
        if len(own) == 3:
            half[:, 0] |= own[1].astype("<u2") << 8
    first = rows[1] != 0
    first[(np.cumsum(each) - each)[each > 0]] = True
    begin = np.flatnonzero(first)
    np.cumsum(rows[1], dtype=np.uint32, out=rows[1])
    second = np.cumsum(rows[2], dtype=np.uint32)
    rows[2] = second - np.repeat(second[begin] - rows[2][begin], np.diff(np.append(begin, n)))
    return rows, doc, doc < learned, np.repeat(np.arange(GROUP, dtype=np.uint8), each)


def _batch(shard: int, flush: int, size: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([flush], pa.int64()), pa.array([size], pa.int64()), pa.array([body], pa.binary())], names=["shard", "flush", "size", "body"])


_BLOCK = "shard long, flush long, size long, body binary"


def count_words(rows: DataFrame) -> DataFrame:
    """word and c over rows (learned, text), the end included: counted in each task, then summed. Null stands for all tokens."""

    def run(batches):
        held, size, ends, every = [], 0, 0, 0

        def out(more):
            table = pa.concat_tables([*held, *more]).group_by("word", use_threads=False).aggregate([("c", "sum")])
            held.clear()
            return [pa.RecordBatch.from_arrays([x.column("word"), x.column("c_sum")], names=["word", "c"]) for x in table.to_batches(max_chunksize=100_000)]

        for b in batches:
            mask = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in byte_groups(b.column(1)):
                found, own, sizes = words(b.column(1).slice(lo, hi - lo))
                every += len(own) + hi - lo
                ends += int(mask[lo:hi].sum())
                times = np.bincount(own[np.repeat(mask[lo:hi], sizes)], minlength=len(found))
                held.append(pa.table({"word": found, "c": times}).filter(pa.array(times > 0)))
                size += len(found)
            if size > 1_000_000:
                yield from out([])
                size = 0
        if every:
            yield from out([pa.table({"word": pa.array([END, None] if ends else [None], pa.binary()), "c": pa.array([ends, every] if ends else [every], pa.int64())})])

    return map_batches(rows, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _sum_followers(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(targets in order, learned, there) of the same, added up."""
    target, learned, there = (np.concatenate(x) for x in zip(*held, strict=True))
    target, inverse = np.unique(target, return_inverse=True)
    return target, *(np.bincount(inverse, weights=x, minlength=len(target)).astype(np.int64) for x in (learned, there))


def _pack_followers(target: np.ndarray, learned: np.ndarray, there: np.ndarray) -> bytes:
    return pa.compress(target.astype("<u4").tobytes() + learned.astype("<i8").tobytes() + there.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _unpack_followers(body: bytes, n: int) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(body, decompressed_size=20 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<i8", n, 4 * n), np.frombuffer(raw, "<i8", n, 12 * n)


def _sum_events(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct events, weights) of the same, added up."""
    own, inverse = _distinct(np.concatenate([x for x, _ in held], axis=1))
    return own, np.bincount(inverse, weights=np.concatenate([w for _, w in held]), minlength=own.shape[1])


def _apart(keys: np.ndarray, place: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Of events in the order of their places among the keys: whether those of their feature are not all at one place."""
    feature = keys[place] >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]])) if len(place) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(place)))
    differ = where != np.repeat(where[first], sizes)
    return np.repeat(np.logical_or.reduceat(differ, first), sizes) if len(place) else differ


def _pick_counts(counts: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """The counts of some of the keys."""
    *own, steps, taken = counts
    return [*(x[at] for x in own), steps[at], taken[_places((np.cumsum(steps) - steps)[at], steps[at])]]


def _pack_counts(keys: np.ndarray, tokens: np.ndarray, own: np.ndarray, steps: np.ndarray, taken: np.ndarray, more: tuple = ()) -> bytes:
    """What skip_counts() gives, in the order of the keys, and more numbers."""
    size, upper = np.array([len(keys), len(taken)], np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    return _pack(size, np.diff(upper, prepend=np.uint32(0)), keys.astype(np.uint32), *(x.astype(np.uint32) for x in (tokens, own, steps, taken)), *more)


def _unpack_counts(body: bytes, size: int) -> tuple:
    """The same, and what gives the further numbers. size: bytes in all."""
    number = _unpack_numbers(body, size)
    n, m = number(2).tolist()
    upper, lower, tokens, own, steps, taken = (number(k) for k in (n, n, n, n, n, m))
    keys = np.cumsum(upper, dtype=np.uint32).astype(np.uint64) << np.uint64(32) | lower
    return keys, tokens, own, steps.astype(np.int64), taken.astype(np.float32), number


def _unpack_numbers(body: bytes, size: int) -> Callable[[int], np.ndarray]:
    """Gives arrays of so many 32-bit numbers in turn, as _pack() has put them; size: bytes in all."""
    raw, at = np.frombuffer(pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True), "<u2"), 0

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += 2 * n
        return np.ascontiguousarray(raw[at - 2 * n : at].reshape(2, n).T).view("<u4")[:, 0]

    return take


def count_followers(rows: DataFrame, vocabulary: Vocabulary, contexts: Contexts) -> DataFrame:
    """How often a token follows each context of the greatest length of those given, over rows (learned, text), in rows
    learned from and in all: place of the context and some of its targets (share), packed with their counts; the tokens
    of these; targets of more than LARGE tokens with their number.

    With contexts of one word, places below zero have the counts of their skip features, some features a row, and the
    events that these are for."""
    shared, length, large = rows.sparkSession.sparkContext.broadcast((vocabulary, contexts)), len(contexts.keys), LARGE
    skip_groups = np.uint64(max(1, int(contexts.parts[0].sum()) * HOT * 4 // LARGE))

    def count(batches):
        v, own_contexts = shared.value
        coder, held, size, skips = Coder(v), [], 0, []
        codes, shares = own_contexts.codes[0][:, 0], -(-own_contexts.parts[-1] // GROUP)
        table, codes = pa.array([v.words[c] for c in codes if c != _PAD], pa.binary()), np.append(codes[codes != _PAD], _RARE).astype(np.uint32)

        def out():
            at, learned, there = _sum_followers(held)
            held.clear()
            place = at >> 32
            share = (at & 0xFFFFFFFF) % shares[place]
            order = np.lexsort((share, place))
            ends = np.flatnonzero((np.diff(place[order]) != 0) | (np.diff(share[order]) != 0)) + 1
            for some in np.split(order, ends):
                if len(some):
                    columns = [pa.array([int(x)], pa.int64()) for x in (place[some[0]], share[some[0]], len(some))]
                    body = _pack_followers(at[some] & 0xFFFFFFFF, learned[some], there[some])
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([body], pa.binary())], names=["place", "share", "size", "body"])

        def out_skips():
            own, weight = _sum_events(skips)
            skips.clear()
            group = (_feature(own[[1, 3]]).astype(np.uint64) * skip_groups >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((own[3], own[1], group))
            for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                columns = [pa.array([x], pa.int64()) for x in (-1 - int(group[some[0]]), 0, len(some))]
                body = _pack(*(row[some] for row in own), weight[some].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([body], pa.binary())], names=["place", "share", "size", "body"])

        for b in batches:
            mask = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in byte_groups(b.column(1)):
                found, own, sizes = words(b.column(1).slice(lo, hi - lo))
                common = pc.fill_null(pc.index_in(found, value_set=table), len(table)).to_numpy()  # only these are words of such contexts
                last = coder.texts(own, common.astype(np.uint32), sizes, len(table))
                doc = np.repeat(np.arange(hi - lo), sizes + 1)
                before = np.arange(len(last)) - (np.cumsum(sizes + 1) - sizes - 1)[doc]
                at = np.flatnonzero(np.concatenate([[False], last[:-1] < len(table)]) & (before > 0) | (before == 0))
                place = own_contexts.places(events(codes[last], at, before[at])[1 : length + 1])[-1]
                at, place = at[place >= 0], place[place >= 0]
                target, inverse = np.unique(coder.texts(own, np.arange(len(found), dtype=np.uint32), sizes, len(found))[at], return_inverse=True)
                target = np.append(coder.code(found.take(pa.array(target[target < len(found)]))), np.full(int((target == len(found)).sum()), coder.end, np.uint32))
                held.append(_sum_followers([(place << 32 | target[inverse].astype(np.int64), mask[lo:hi][doc[at]], np.ones(len(at)))]))
                size += len(held[-1][0])
                if length == 1 and len(at):
                    rows = events(coder.texts(own, coder.code(found), sizes), at, before[at])
                    part = _way(_keys(rows[1:3])[1], own_contexts.parts[0][place])  # of the second last, only this matters unless the pair may be common
                    rows[2] = np.where(own_contexts.places(rows[2:3])[0] < 0, part.astype(np.uint32) | np.uint32(_RARE), rows[2])
                    skips.append(_sum_events([(rows, mask[lo:hi][doc[at]])]))
                    size += len(at)
                if size > 1_000_000:
                    yield from out()
                    if skips:
                        yield from out_skips()
                    size = 0
        if held:
            yield from out()
        if skips:
            yield from out_skips()

    def add(batches):
        (v, _), key, held = shared.value, None, []

        def out():
            if key[0] < 0:
                own, weight = _sum_events(held)
                place, *counts = skip_counts(v, own, weight)
                order = np.argsort(place)[np.count_nonzero(place < 0) :]
                apart = _apart(counts[0], place[order], own[2, order])  # others are in one shard, which has their tokens
                order, used = order[apart], np.unique(place[order[apart]])
                place, counts = np.searchsorted(used, place), _pick_counts(counts, used)
                own[3] = np.where(own[2] >= _RARE, 0, own[3])
                n = np.array([len(order)], np.uint32)
                body = _pack_counts(*counts, (n, np.diff(place[order].astype(np.uint32), prepend=np.uint32(0)), *(x[order] for x in own[1:])))
                columns = [pa.array([x], pa.int64()) for x in (key[0], 4 * (3 + 5 * len(counts[0]) + len(counts[-1]) + 4 * len(order)), 0)]
                return pa.RecordBatch.from_arrays([*columns, pa.array([body], pa.binary()), *(pa.array([[]], pa.list_(pa.int64())) for _ in range(2))], names=["place", "size", "tokens", "body", "most", "times"])
            target, learned, there = _sum_followers(held)
            most = np.flatnonzero(there > large)
            columns = [pa.array([x], pa.int64()) for x in (key[0], len(target), int(there.sum()))]
            columns += [pa.array([_pack_followers(target, learned, there)], pa.binary()), *(pa.array([x[most].tolist()], pa.list_(pa.int64())) for x in (target, there))]
            return pa.RecordBatch.from_arrays(columns, names=["place", "size", "tokens", "body", "most", "times"])

        for b in batches:
            for place, share, n, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (place, share) != key and held:
                    yield out()
                    held.clear()
                key = place, share
                if place < 0:
                    number = _unpack_numbers(body, 4 * (CONTEXT + 2) * n)
                    held.append((np.stack([number(n) for _ in range(CONTEXT + 1)]), number(n)))
                else:
                    held.append(_unpack_followers(body, n))
                if len(held) == 64:
                    held[:] = [(_sum_events if place < 0 else _sum_followers)(held)]
        if held:
            yield out()

    parts = map_batches(rows, count, "place long, share long, size long, body binary").repartition("place", "share").sortWithinPartitions("place", "share")
    return map_batches(parts, add, "place long, size long, tokens long, body binary, most array<long>, times array<long>")


class Model:
    """What is learned before events are dealt: the vocabulary, the counts of the words outside it, the contexts that are
    dealt over several shards, and by their length, how often each token follows them."""

    def __init__(self, vocabulary: Vocabulary, rare: DataFrame, contexts: Contexts, followers: list[DataFrame]):
        self.vocabulary, self.rare, self.contexts, self.followers = vocabulary, rare, contexts, followers


def _rows(df: DataFrame, learned: Column, id_col: str, text_col: str) -> DataFrame:
    kept = pick(df.withColumn("__learned", learned), doc_id=id_col, learned="__learned", text=text_col)
    return kept.withColumn("learned", F.coalesce(F.col("learned") & F.col("doc_id").isNotNull(), F.lit(False)))


def fit(df: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> Model:
    """Counts over all rows of df where learned holds. Runs at once."""
    path = scratch(df.sparkSession, "counts")
    rows = _rows(df, learned, id_col, text_col).select("learned", "text")
    _write(count_words(rows), path)
    every = df.sparkSession.read.parquet(path)
    counts, total = every.where("word IS NOT NULL"), every.where("word IS NULL").agg(F.sum("c")).first()[0]
    level = F.floor(F.log2("c") * 8).cast("int")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least, have = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        have += r.n
        if have > frequent:
            least = r.level + 1
            break
    end = F.col("word") == F.lit(END)
    words, c = [], []
    for r in counts.where((level >= least) | end).toLocalIterator():  # at most `frequent` words of at most LONGEST bytes, and the end
        words.append(bytes(r.word))
        c.append(r.c)
    vocabulary = Vocabulary(words, np.array(c, np.int64), n, v, total)
    contexts, followers = Contexts(vocabulary), []
    while len(contexts.keys[-1]):
        path = scratch(df.sparkSession, "followers")
        _write(count_followers(rows, vocabulary, contexts), path)
        followers.append(df.sparkSession.read.parquet(path))
        if len(followers) == CONTEXT:
            break
        large = [(r.place, t, n) for r in followers[-1].where(F.size("most") > 0).select("place", "most", "times").collect() for t, n in zip(r.most, r.times, strict=True)]
        starts = np.flatnonzero((contexts.codes[-1] == _PAD).all(axis=1))
        starts = followers[-1].where(F.col("place") == int(starts[0])).agg(F.sum("tokens")).first()[0] if len(starts) else 0
        contexts.extend(*np.array(large, np.int64).reshape(-1, 3).T, starts or 0)
    return Model(vocabulary, counts.where((level < least) & ~end), contexts, followers)


def _write(df: DataFrame, path: str) -> None:
    """Writes the rows, and lets go of the shuffled files behind them at once."""
    key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _pack_words(h: np.ndarray, k: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[int, bytes]:
    """Words outside the table (by two hashes, h in order) with their texts and times: (bytes in all, packed)."""
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]))
    numbers = [np.array([len(h), len(first)]), h[first] & np.uint64(0xFFFFFFFF), np.diff(h[first] >> np.uint64(32), prepend=np.uint64(0)), k[first], np.diff(np.append(first, len(h))), doc, times]
    return 4 * sum(map(len, numbers)), _pack(*(x.astype(np.uint32) for x in numbers))


def _unpack_words(body: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    number = _unpack_numbers(body, size)
    n, m = number(2).tolist()
    low, high, k, each, doc, times = (number(x) for x in (m, m, m, m, n, n))
    return np.repeat(np.cumsum(high, dtype=np.uint64) << np.uint64(32) | low, each), np.repeat(k, each), doc, times


def _rare_counts(model: Model) -> DataFrame:
    """Blocks of the counts of words outside the table, for the groups that have their leaves."""
    shared = model.rare.sparkSession.sparkContext.broadcast(model.vocabulary)

    def run(batches):
        v, held, size = shared.value, [], 0

        def out():
            h, k, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, group = np.argsort(h), v.rare_group(h)
            for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):  # groups are in the order of hashes
                yield _batch(int(group[some[0]]), -1, *_pack_words(h[some], k[some], c[some] >> 32, c[some]))

        for b in batches:
            if b.num_rows:
                held.append((hashes(b.column(0)), _crc(b.column(0)), b.column(1).to_numpy()))
                size += b.num_rows
            if size > 1_000_000:
                yield from out()
                size = 0
        if held:
            yield from out()

    return map_batches(model.rare.select("word", "c"), run, _BLOCK)


def _crc(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.uint32, len(words))


def _find_words(known: list[tuple], asked: list[tuple], bits: int, alpha: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For each block of words asked for (h, k, doc, times): its texts, and of these what their words add to the base score, the share of
    their leaves that they have, both log10, and how many are known. known: all words of these leaves (h, k, two halves of the count)."""
    h, k, high, low = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.empty(0, t) for t in (np.uint64, np.uint32, np.uint32, np.uint32))
    order = np.lexsort((k, h))
    h, k, c = h[order], k[order], (high.astype(np.int64) << 32 | low)[order]
    leaves = lambda x: x >> np.uint64(64 - bits) if bits else np.zeros(len(x), np.uint64)
    leaf, upto = leaves(h), np.append(0, np.cumsum(c))
    for h_asked, k_asked, doc, times in asked:
        at, count, own = np.searchsorted(h, h_asked), np.zeros(len(h_asked), np.int64), leaves(h_asked)
        todo = np.flatnonzero(at < len(h))
        while len(todo := todo[h[at[todo]] == h_asked[todo]]):  # mostly one has the hash
            same = k[at[todo]] == k_asked[todo]
            count[todo[same]] = c[at[todo[same]]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < len(h)]
        lo, hi = np.searchsorted(leaf, own), np.searchsorted(leaf, own, "right")
        within = np.where(hi > lo, upto[hi] - upto[lo] + ALPHA * (hi - lo + 1), ALPHA)
        there, inverse = np.unique(doc, return_inverse=True)
        adds = times * (np.log10(count + alpha) - np.log10(alpha)), times * np.log10((count + ALPHA) / within), np.where(count > 0, times, 0)
        yield there, *(np.bincount(inverse, weights=x, minlength=len(there)) for x in adds)


def _encode(rows: DataFrame, model: Model, alpha: float) -> DataFrame:
    """Blocks of events for the shards, and for each flush of documents a block (shard -1) of what is known of them at once."""
    shared = rows.sparkSession.sparkContext.broadcast((model.vocabulary, model.contexts))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        (v, contexts), part, flushes = shared.value, TaskContext.get().partitionId(), 0
        coder = Coder(v)
        below = np.log10(v.n + alpha * (v.v + 1)) if v.n else np.log10(alpha)
        often, seen = np.log10(np.append(v.counts, 0) + alpha) - below, np.append(v.counts, 0) > 0
        seen = seen.astype(np.int64)
        held: list = []

        def flush():
            nonlocal flushes
            number = part << 24 | flushes
            flushes += 1
            ids, learned, codes, sizes, salts, rare = (list(x) for x in zip(*held, strict=True))
            held.clear()
            sizes, codes, learned, salts = (np.concatenate(x) for x in (sizes, codes, learned, salts))
            first, place = np.cumsum(sizes) - sizes, np.minimum(codes, len(often) - 1)
            base, known = np.add.reduceat(often[place], first), np.add.reduceat(seen[place], first)
            del place
            front = np.argsort(~learned, kind="stable")  # texts that are learned from come first
            header = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(sizes), pa.array(known), pa.array(base)],
                names=["doc_id", "n_tokens", "n_known", "base"],
            ).take(pa.array(front))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, header.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(header)
            yield _batch(-1, number, len(sizes), sink.getvalue().to_pybytes())
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            before = np.arange(len(codes), dtype=np.uint32) - first.astype(np.uint32)[doc]
            rows = np.empty((len(codes), CONTEXT + 1), np.uint32)  # what is of a token lies together, as one number: it is fetched once
            shard = np.empty(len(codes), np.uint16 if v.shards <= 1 << 16 else np.int64)
            rank = np.empty(len(front), np.uint32)
            rank[front] = np.arange(len(front))
            shift = np.repeat(np.cumsum([0, *map(len, ids[:-1])]), [len(x[0]) for x in rare])
            h, k, text, times = (np.concatenate(x) for x in zip(*rare, strict=True))
            text, order = rank[text + shift], np.argsort(h)
            group = v.rare_group(h[order])
            for some in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []:  # groups are in the order of hashes
                yield _batch(int(v.rare_group(h[some[:1]])[0]), number, *_pack_words(h[some], k[some], text[some], times[some]))
            for lo in range(0, len(codes), 1 << 16):
                own = slice(lo, min(lo + (1 << 16), len(codes)))
                some = np.full((CONTEXT + 1, own.stop - lo), _PAD, np.uint32)
                for i in range(CONTEXT + 1):
                    skip = max(0, i - lo)
                    some[i, skip:] = codes[lo + skip - i : own.stop - i]
                    some[i][before[own] < i] = _PAD
                shard[own] = deal(v, some, salts[doc[own]] + (before[own] >> 10).astype(np.uint64), contexts)
                some[0] = np.where(some[0] < _RARE, some[0], some[0] & ~np.uint32((1 << 31 - v.bits) - 1))  # down to the leaf
                rows[own] = some.T
            doc, group, rows = rank[doc], shard // GROUP, rows.view(np.complex128)[:, 0]
            order = np.argsort(group, kind="stable")
            group = group[order]
            learned = int(np.count_nonzero(learned))
            for some in np.split(order, np.flatnonzero(group[1:] != group[:-1]) + 1):
                own = int(shard[some[0]]) // GROUP
                mine, each = rows[some], shard[some].astype(np.int64) - own * GROUP
                own_rows = mine.view(np.uint32).reshape(-1, CONTEXT + 1)
                by = np.argsort(each.astype(np.uint64) << np.uint64(59) | own_rows[:, 1].astype(np.uint64) << np.uint64(27) | np.minimum(own_rows[:, 2], (1 << 27) - 1))
                own_rows = np.ascontiguousarray(mine[by].view(np.uint32).reshape(-1, CONTEXT + 1).T)
                yield _batch(own, number, len(some), _pack_events(own_rows, doc[some[by]], each[by], learned))

        size = 0
        for b in batches:
            learned = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in byte_groups(b.column(2)):
                texts = b.column(2).slice(lo, hi - lo)
                found, own, sizes = words(texts)
                codes, some, h = coder.look(found)
                outside, place = np.flatnonzero(codes[own] >= _RARE), np.zeros(len(found), np.int64)
                place[some] = np.arange(len(some))
                pairs, times = np.unique(np.repeat(np.arange(hi - lo), sizes)[outside] * max(len(some), 1) + place[own[outside]], return_counts=True)
                text, at = np.divmod(pairs, max(len(some), 1))
                rare = h[at], _crc(found.take(pa.array(some)))[at], text, times
                salts = np.fromiter((xxhash.xxh3_64_intdigest((t or "").encode()) >> 1 for t in texts.to_pylist()), np.uint64, hi - lo)
                held.append((b.column(0).slice(lo, hi - lo), learned[lo:hi], coder.texts(own, codes, sizes), sizes + 1, salts, rare))
                size += len(own) + hi - lo
                if size >= _FLUSH:
                    yield from flush()
                    trim()
                    size = 0
        if held:
            yield from flush()

    return map_batches(rows, run, _BLOCK), id_type


def _distinct(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct columns, the place among them of each column)"""
    h = [_mix((row.astype(np.uint64) + np.uint64(1)) * _ODD[(i + 2) % 4]) for i, row in enumerate(own)]
    key = h[0]
    for i, more in enumerate(h[1:], 1):
        key = key ^ _mix(more * _ODD[i])
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return own[:, order[new]], inverse


def _totals(model: Model) -> list[DataFrame]:
    """Blocks of what follows the contexts of each length, one for each group of shards that has tokens of the context.
    Their flush is below zero and tells length and place."""
    groups = model.contexts.groups(model.vocabulary)

    def blocks(length: int, counts: DataFrame) -> DataFrame:
        shared = counts.sparkSession.sparkContext.broadcast({place: g for (n, place), g in groups.items() if n == length})

        def run(batches):
            for b in batches:
                for place, n, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    for group in shared.value[place]:
                        yield _batch(group, -1 - (place * (CONTEXT + 1) + length), n, body)

        return map_batches(counts.where("place >= 0").select("place", "size", "body"), run, _BLOCK)

    def skips(counts: DataFrame) -> DataFrame:
        shared = counts.sparkSession.sparkContext.broadcast((model.vocabulary, model.contexts))

        def run(batches):
            v, contexts = shared.value
            for b in batches:
                for at, n, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    *counts, number = _unpack_counts(body, n)
                    n = int(number(1)[0])
                    rows = np.stack([np.cumsum(number(n), dtype=np.uint32), *(number(n) for _ in range(CONTEXT))])
                    rows = rows[:, contexts.places(rows[1:])[-1] < 0] if len(contexts.keys) == CONTEXT else rows  # three common words have no use of it
                    parts = contexts.parts[0][contexts.places(rows[1:2])[0]]
                    shard = _part(v, _base(v, _keys(rows[1:2])[0]), (rows[2] & np.uint32(_RARE - 1)).astype(np.int64), parts)
                    some = np.flatnonzero(rows[2] < _RARE)
                    shard[some] = deal(v, rows[:, some], np.zeros(len(some), np.uint64), contexts)
                    some = np.flatnonzero(_apart(counts[0], rows[0], shard))
                    pairs = np.unique(shard[some] // GROUP << 32 | rows[0, some].astype(np.int64))
                    for some in np.split(pairs, np.flatnonzero(np.diff(pairs >> 32)) + 1):
                        if len(some):
                            own = _pick_counts(counts, some & 0xFFFFFFFF)
                            yield _batch(int(some[0]) >> 32, at * (CONTEXT + 1) - 1, 4 * (2 + 5 * len(some) + len(own[-1])), _pack_counts(*own))

        return map_batches(counts.where("place < 0").select("place", "size", "body"), run, _BLOCK)

    return [skips(counts) for counts in model.followers[:1] if len(model.contexts.keys[0])] + [blocks(length, counts) for length, counts in enumerate(model.followers, 1) if len(model.contexts.keys[length - 1])]


def _unpack_totals(contexts: Contexts, held: list[tuple[int, int, bytes]]) -> list[tuple]:
    """(context, targets, learned, there) of the blocks of totals."""
    every: dict = {}
    for flush, n, body in held:
        if (-1 - flush) % (CONTEXT + 1) == 0:
            continue
        every.setdefault(-1 - flush, []).append(_unpack_followers(body, n))
    return [(contexts.codes[k % (CONTEXT + 1) - 1][k // (CONTEXT + 1)], *map(np.concatenate, zip(*parts, strict=True))) for k, parts in sorted(every.items())]


def _unpack_given(contexts: Contexts, held: list[tuple[int, int, bytes]]) -> Given | None:
    """The skip counts among the blocks of totals."""
    if not len(contexts.keys[0]):
        return None
    every = [_unpack_counts(body, n)[:5] for flush, n, body in held if (-1 - flush) % (CONTEXT + 1) == 0]
    every.append(tuple(np.empty(0, t) for t in (np.uint64, np.uint32, np.uint32, np.int64, np.float32)))
    return Given(contexts.codes[0][:, 0], *map(np.concatenate, zip(*every, strict=True)))


def _shards(blocks: DataFrame, model: Model, alpha: float) -> DataFrame:
    """Learns each shard from its group's blocks, and gives each block the sums of its documents' log probabilities. Words outside
    the table are found among those of their leaves."""
    vocabulary = model.vocabulary
    shared = blocks.sparkSession.sparkContext.broadcast((vocabulary, model.contexts))

    def run(batches):
        (v, contexts), group, held, known = shared.value, None, [], []

        def work():
            if not held:
                return
            if group >= v.groups:
                flushes, *blocks = zip(*((f, _unpack_words(body, n)) for f, n, body in held), strict=True)
                sums = _find_words([_unpack_words(body, n) for _, n, body in known], blocks[0], v.bits, alpha)
                for flush, (there, gain, share, seen) in zip(flushes, sums, strict=True):
                    body = np.diff(there, prepend=np.uint32(0)).astype("<u4").tobytes() + gain.astype("<f8").tobytes() + share.astype("<f4").tobytes() + seen.astype("<u4").tobytes()
                    yield _batch(1, flush, len(there), pa.compress(body, codec="zstd", asbytes=True))
                return
            totals, given = learn_totals(v, _unpack_totals(contexts, known)), _unpack_given(contexts, known)
            known.clear()
            blocks, own, docs, learned, shard = [(f, n) for f, n, _ in held], *zip(*(_unpack_events(body, n) for _, n, body in held), strict=True)
            held.clear()
            own, learned, shard = np.concatenate(own, axis=1), np.concatenate(learned), np.concatenate(shard)
            order, ends = np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=GROUP))
            scores = np.empty(len(shard))
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if lo < hi:
                    some = order[lo:hi]
                    distinct, inverse = _distinct(own[:, some])
                    scores[some] = learn_and_score(v, distinct, np.bincount(inverse, weights=learned[some], minlength=distinct.shape[1]), totals, True, given)[inverse]
            at = 0
            trim()
            for (flush, n), doc in zip(blocks, docs, strict=True):
                there = np.flatnonzero(np.bincount(doc))
                sums = np.bincount(doc, weights=scores[at : at + n])[there].astype("<f4")
                at += n
                yield _batch(0, flush, len(there), pa.compress(np.diff(there, prepend=0).astype("<u4").tobytes() + sums.tobytes(), codec="zstd", asbytes=True))

        for b in batches:
            for s, f, n, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if s < 0:
                    yield _batch(-1, f, n, body)
                    continue
                if s != group:
                    yield from work()
                    held.clear()
                    known.clear()
                group = s
                (held if f >= 0 else known).append((f, n, body))
        if held:
            yield from work()

    parts = min(1 << 15, vocabulary.groups + vocabulary.rare_groups + blocks.sparkSession.sparkContext.defaultParallelism)
    dealt = blocks.repartition(parts, F.when(F.col("shard") < 0, F.col("flush")).otherwise(F.col("shard"))).sortWithinPartitions("shard")
    return map_batches(dealt, run, _BLOCK)


def _documents(blocks: DataFrame, id_type: str) -> DataFrame:
    """Rows of documents from the blocks of their flush."""

    def run(batches):
        header, total, gain, seen = None, None, None, None

        def out():
            known, base = header.column(2).to_numpy() + seen, header.column(3).to_numpy() + gain
            columns = [header.column(0), header.column(1), pa.array(known), pa.array(base), pa.array(total / np.log(10))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for s, n, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if s < 0:
                    if header is not None:
                        yield out()
                    header, total, gain, seen = pa.ipc.open_stream(body).read_next_batch(), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
                    continue
                raw = pa.decompress(body, decompressed_size=(20 if s else 8) * n, codec="zstd", asbytes=True)
                at = np.cumsum(np.frombuffer(raw, "<u4", n))
                if s:
                    gain[at] += np.frombuffer(raw, "<f8", n, 4 * n)
                    total[at] += np.frombuffer(raw, "<f4", n, 12 * n) * np.log(10)
                    seen[at] += np.frombuffer(raw, "<u4", n, 16 * n)
                else:
                    total[at] += np.frombuffer(raw, "<f4", n, 4 * n)
        if header is not None:
            yield out()

    dealt = blocks.repartition(F.col("flush")).sortWithinPartitions("flush", "shard")
    return map_batches(dealt, run, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")


def score(df: DataFrame, model: Model, learned: Column, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (unigrams, add alpha), score (the model's) of every row of df, both log10.

    Contexts are learned from the rows where learned holds, which must be those that the model was fitted on; to score
    other rows than were learned from, put both in df. Runs when the result is read.
    """
    blocks, id_type = _encode(_rows(df, learned, id_col, text_col), model, alpha)
    for more in [*_totals(model), _rare_counts(model)]:
        blocks = blocks.unionByName(more)
    return _documents(_shards(blocks, model, alpha), id_type)
