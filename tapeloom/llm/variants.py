"""Spelling variants: words that one inserted, deleted or replaced code point tells apart, and the commoner form of each.

Words that differ at one place share what stands before it and what follows it. Sorted forwards, the words with a prefix
are an interval; sorted backwards, so are those with a suffix; a word is a point with its place in either order, and for
each place of an edit the words of fitting length in a rectangle are reported from a wavelet tree. Replacements meet the
words of a length among themselves, insertions those one longer; deletions are insertions seen from the other side.

Work is dealt by halves: an edit in the back half leaves the front half as it is, and the other way round. So a word goes
to the group of its front half, which looks for edits behind it, and to that of its back half, which looks before it;
both for its own length and for one less. Many groups share a task and its trees, told apart by a number before the
word. A group beyond GROUP_WORDS is dealt into blocks, and its words ask in each of them; the list of such groups has at
most one row for GROUP_WORDS rows, and is broadcast. An inserted code point equal to the one before it counts at the
first of such places only, so each pair is found once. What a task finds leaves it summed up by word.

Defined results: a null or empty text has no words; a null id counts as the empty text where runs are changed. Words hold
no U+0000. No words give no rows. Repeated rows each count. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import LOWER, UPPER, map_batches, pick
from tapeloom.session import cut

#: Fixed values of the contract: what a word is made of, how often and where a code point is lost.
RUN, LOSES_ONE_IN = "[A-Za-zÀ-ÿ]+", 199
#: Words of a group that share a task whole; rows of a task, about.
GROUP_WORDS, TASK_ROWS = 1 << 14, 1 << 16


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 6) -> DataFrame:
    """word and n of the runs of letters of whole texts, some with a code point deleted by the checksum of id and run."""
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")
    runs = pick(docs, id=doc_id, text=text).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), run)
    runs = runs.where(F.length("run") >= shortest).withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % LOSES_ONE_IN == 0, F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))


class Wavelet:
    """A wavelet matrix over a sequence of whole numbers: each level keeps, by one bit, how many zeros stand before a place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every place in [lo, hi) whose value is in [least, most), for arrays of rectangles."""
        whose = np.flatnonzero((lo < hi) & (least < most))
        lo, hi, least, most, node = lo[whose], hi[whose], least[whose], most[whose], np.zeros(len(whose), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            lo0, hi0 = zeros[lo], zeros[hi]
            lo1, hi1 = zeros[-1] + lo - lo0, zeros[-1] + hi - hi0
            left = np.flatnonzero((lo0 < hi0) & (node < most) & (node + half > least))
            right = np.flatnonzero((lo1 < hi1) & (node + half < most) & (node + 2 * half > least))
            both = np.concatenate([left, right])
            lo, hi = np.concatenate([lo0[left], lo1[right]]), np.concatenate([hi0[left], hi1[right]])
            node = np.concatenate([node[left], node[right] + half])
            whose, least, most = whose[both], least[both], most[both]
        return np.repeat(whose, hi - lo), np.repeat(node, hi - lo)


class Index:
    """Words of one length, with a number of their group before them, in both orders."""

    def __init__(self, groups: np.ndarray, letters: np.ndarray):
        """letters: a row of bytes a word."""
        self.length = letters.shape[1]
        self.forward, order = self._sorted(_keyed(groups, letters))
        self.backward, back = self._sorted(_keyed(groups, letters[:, ::-1]))
        place = np.empty(len(back), np.int64)
        place[back] = np.arange(len(back))
        self.words = back  # by place in the backward order
        self.tree = Wavelet(place[order])

    @staticmethod
    def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def between(self, groups: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the group's words that begin with the letters before and end with those after, by query."""
        lo, hi = self._interval(self.forward, groups, before)
        least, most = self._interval(self.backward, groups, after[:, ::-1])
        whose, value = self.tree.report(lo, hi, least, most)
        return whose, self.words[value]

    def _interval(self, keys: np.ndarray, groups: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = self.length - letters.shape[1]
        ends = [_keyed(groups, np.concatenate([letters, np.full((len(letters), rest), x, np.uint8)], axis=1)) for x in (0, 255)]
        return np.searchsorted(keys, ends[0], "left"), np.searchsorted(keys, ends[1], "right")


def _keyed(groups: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The group's number and the letters as byte strings of one width, which sort by group, then by letters."""
    whole = np.concatenate([groups.astype(">u4").view(np.uint8).reshape(-1, 4), letters], axis=1)
    return np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel()


def _edits(groups: np.ndarray, letters: np.ndarray, same: Index | None, longer: Index | None, width: int, places: range):
    """(place, asking word, found word, whether that is one longer) for edits at the given places of words."""
    for at in places:
        before, here = letters[:, : at * width], at * width
        if same is not None and here < letters.shape[1]:
            yield at, *same.between(groups, before, letters[:, here + width :]), False
        if longer is not None:
            yield at, *longer.between(groups, before, letters[:, here:]), True


def _near(rows: list[tuple]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(words in order, their n, word, near word: all pairs among rows (class, back half, group, word, n, in the index here)), both ways round."""
    m, back, group, word, n, here = zip(*rows, strict=True)
    words, code = np.unique(np.array(word, object), return_inverse=True)
    count = np.zeros(len(words), np.int64)
    count[code] = n
    wide = max(map(max, words.tolist())) > "\xff"
    coding, width = ("utf-32-be", 4) if wide else ("latin-1", 1)
    size = np.array([len(w) for w in words.tolist()])[code]
    m, back, here = np.array(m), np.array(back), np.array(here)
    group = np.unique(np.array(group, object), return_inverse=True)[1]
    left, right = [], []
    for length, side in sorted(set(zip(m.tolist(), back.tolist(), strict=True))):
        mine = (m == length) & (back == side)
        short, long = np.flatnonzero(mine & (size == length)), np.flatnonzero(mine & (size == length + 1) & here)
        letters = lambda at: np.frombuffer(b"".join(words[c].encode(coding) for c in code[at].tolist()), np.uint8).reshape(len(at), -1)
        indexed = np.flatnonzero(here[short])
        if not len(short):
            continue
        own = letters(short)
        same = Index(group[short[indexed]], own[indexed]) if len(indexed) else None
        longer = Index(group[long], letters(long)) if len(long) else None
        half = length // 2
        places = range(0, half) if side else range(half, length + 1)
        for at, asks, found, inserted in _edits(group[short], own, same, longer, width, places):
            a, b = code[short[asks]], code[long[found] if inserted else short[indexed[found]]]
            if inserted:
                if at:  # at the first of equal places only
                    first = np.array([words[y][at] != words[x][at - 1] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
                    a, b = a[first], b[first]
                left += [a, b]
                right += [b, a]
            else:
                other = a != b
                left.append(a[other])
                right.append(b[other])
    none = [np.zeros(0, np.int64)]
    return words.tolist(), count, np.concatenate(left or none), np.concatenate(right or none)


def near(words: DataFrame, group_words: int = GROUP_WORDS, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, n_near and form (n, word of the near word with the largest n, the first in order of equals) of the words (word, n) that have a near one."""
    size = F.length("word")
    classes = F.explode(F.array(size, size - 1)).alias("m")
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.explode(F.array(F.struct(F.lit(False).alias("back"), F.substring("word", F.lit(1), half).alias("key")), F.struct(F.lit(True).alias("back"), F.expr("right(word, m - m div 2)").alias("key")))).alias("side")
    rows = words.where(size > 0).select("word", "n", classes).where("m > 0").select("word", "n", "m", sides).select("word", "n", "m", "side.*")
    group = ["m", "back", "key"]
    large = rows.groupBy(*group).count().where(F.col("count") > group_words).select(*group, F.ceil(F.col("count") / group_words).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(large), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("m", "back", F.concat_ws("\x00", "key", F.col("block").cast("string")).alias("grp"), "word", "n", (F.col("own") == F.col("block")).alias("here"))
    tasks = max(1, -(-4 * words.count() // task_rows))

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not rows:
            return
        words, n, left, right = _near(rows)
        order = np.lexsort((right, -n[right], left))  # places of words are in code point order
        left, right = left[order], right[order]
        at, first, sizes = np.unique(left, return_index=True, return_counts=True)
        best = right[first]
        columns = [pa.array([words[i] for i in at.tolist()], pa.string()), pa.array(sizes, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[i] for i in best.tolist()], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form_n", "form"])

    found = map_batches(dealt.repartition(tasks, "m", "back", "grp"), run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), "best.word").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words with a form: the last form that following leads to. Forms are commoner, so the way ends; each round doubles it."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(on, "root", "left")
        if step.where("further IS NOT NULL").isEmpty():
            return now
        now = cut(step.select("word", F.coalesce("further", "root").alias("root")))


def variants(words: DataFrame, times: int = 5, **sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n). A near word is the form if its n is at least `times` the word's."""
    words = cut(words.select("word", "n"))
    told = words.join(near(words, **sizes), "word", "left").withColumn("form", F.when(F.col("form.n") >= times * F.col("n"), F.col("form")))
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("form.word").alias("form"), F.col("form.n").alias("form_n")))
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, times: int = 5, **sizes: int) -> DataFrame:
    """variants() of the words of whole texts that have at least so many code points and occurrences."""
    return variants(occurrences(docs, doc_id, text, shortest).where(F.col("n") >= least), times, **sizes)
