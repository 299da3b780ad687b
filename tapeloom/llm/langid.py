"""Language ID by interpolated Kneser-Ney character models.

One model per language over the letters of words, each word by itself with its start and end marked. All models share
one sorted array of hashed n-grams, whose rows hold the interpolated log probability in every language, and one of
hashed contexts, whose rows hold the back-off weights; scoring walks down from the longest n-gram that any language has.
A text's score in a language is the sum over its words, so words seen before come from a cache. The language with the
least cross-entropy per letter wins, ties by name.

The models are fitted on a bounded sample of labelled rows, FIT_DOCS whole texts a language, and calibrated on another,
CALIBRATE_DOCS a language: the softmax scale that turns differences into a score, and the cross-entropy above which a
text counts as being in none of the languages. That is halfway between what calibration texts come to and what they come
to with their letters shuffled, and more for short texts. Everything else covers all rows.

Null texts, and texts without letters, are `und` with score 0 and are rejected. Rows with null labels are scored, never
learned from; so are rows with null ids. With too few rows to calibrate on nothing but these is rejected. With no labelled rows at all every text is `und`. Repeated rows give a row each.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import map_batches, pick, text_groups, unnamed

ORDER = 4
#: Bounds on the samples, in documents a language.
FIT_DOCS, CALIBRATE_DOCS = 1500, 500
START, END = "\x02", "\x03"
UNKNOWN = "und"
CACHE_PARTS, GROUP_CHARS = 200_000, 1 << 20
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def segments(part: str) -> list[str]:
    """The runs of letters in what stands between blanks, in lower case."""
    part = part.lower()
    if part.isalpha():
        return [part]
    return "".join([c if c.isalpha() else " " for c in part]).split()


def grams(word: str, order: int = ORDER) -> list[str]:
    padded = START * (order - 1) + word + END
    return [padded[i : i + order] for i in range(len(word) + 1)]


def _hash(columns: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points, the length included; columns: [rows, length]."""
    out = np.full(len(columns), (columns.shape[1] + 1) * _MIX[-1] % (1 << 64), np.uint64)
    for i in range(columns.shape[1]):
        out = (out ^ (columns[:, i].astype(np.uint64) * np.uint64(_MIX[i]))) * np.uint64(_MIX[-2])
        out ^= out >> np.uint64(29)
    return out


def _points(strings: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(-1, width)


def _kneser_ney(counts: dict[str, int], order: int, alphabet: int):
    """(probability of a gram with back-off, weights by context, seen grams) of one language."""
    levels, level = {}, dict(counts)
    for k in range(order, 0, -1):
        totals, kinds, ones = defaultdict(float), Counter(), Counter(level.values())
        discount = ones[1] / (ones[1] + 2 * ones[2]) if ones[1] else 0.5
        for g, c in level.items():
            totals[g[:-1]] += c
            kinds[g[:-1]] += 1
        levels[k] = (level, totals, {h: discount * kinds[h] / totals[h] for h in totals}, discount)
        level = Counter(g[1:] for g in level)  # in how many kinds of left neighbour each shorter gram was met

    def probability(g: str) -> float:
        if not g:
            return 1 / alphabet
        level, totals, weights, discount = levels[len(g)]
        below = probability(g[1:])
        if (t := totals.get(g[:-1])) is None:
            return below
        return max(level.get(g, 0) - discount, 0) / t + weights[g[:-1]] * below

    return probability, {h: w for k in range(order, 0, -1) for h, w in levels[k][2].items()}, {g for k in range(order, 0, -1) for g in levels[k][0]}


class Models:
    """All languages' models in shared sorted arrays."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        self.langs, self.order = sorted(counts), order
        letters = {c for own in counts.values() for g in own for c in g}
        self.alphabet = len(letters) + 1
        built = [_kneser_ney(counts[lang], order, self.alphabet) for lang in self.langs]
        self.grams, self.contexts = {}, {}
        for k in range(1, order + 1):
            own = sorted({g for _, _, seen in built for g in seen if len(g) == k})
            self.grams[k] = self._sorted(_hash(_points(own, k)), [[np.log2(p(g)) for p, _, _ in built] for g in own])
            own = sorted({h for _, weights, _ in built for h in weights if len(h) == k - 1})
            hashes = _hash(_points(own, k - 1)) if k > 1 else _hash(np.zeros((len(own), 0), np.uint32))
            self.contexts[k] = self._sorted(hashes, [[np.log2(weights[h]) if weights.get(h, 0) > 0 else 0.0 for _, weights, _ in built] for h in own])
        self.scale, self.most, self.slack = 1.0, np.inf, 0.0

    def _sorted(self, hashes: np.ndarray, values: list) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(hashes)
        return hashes[at], np.array(values, np.float64).reshape(len(hashes), len(self.langs))[at]

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
        return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))

    def words(self, words: list[str]) -> np.ndarray:
        """The log2 probability of each word in each language."""
        pad = START * (self.order - 1)
        joined = "".join([pad + w + END for w in words])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + self.order
        ends = np.cumsum(sizes)
        place = np.arange(len(points)) - np.repeat(ends - sizes, sizes)
        last = np.flatnonzero(place >= self.order - 1)
        owner = np.repeat(np.arange(len(words)), sizes)[last]
        total = np.zeros((len(last), len(self.langs)))
        left = np.arange(len(last))
        for k in range(self.order, 0, -1):
            columns = points[last[left][:, None] + np.arange(1 - k, 1)]
            at, hit = self._find(self.grams[k][0], _hash(columns))
            total[left[hit]] += self.grams[k][1][at[hit]]
            left, columns = left[~hit], columns[~hit]
            if not len(left):
                break
            at, hit = self._find(self.contexts[k][0], _hash(columns[:, :-1]))
            total[left[hit]] += self.contexts[k][1][at[hit]]
        total[left] -= np.log2(self.alphabet) if len(left) else 0
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, owner, total)
        return out


class Scorer:
    """Sums over texts, with a cache of the parts between blanks that is cleared when full."""

    def __init__(self, models: Models):
        self.models, self.rows = models, {}
        self.sums = np.zeros((1 << 12, len(models.langs) + 1))

    def _prepare(self, wanted: set[str]) -> None:
        new = wanted.difference(self.rows)
        if len(self.rows) + len(new) > CACHE_PARTS:
            self.rows, new, self.sums = {}, wanted, self.sums[:1]
        new, at = list(new), len(self.rows)
        if len(self.sums) < at + len(new):
            self.sums = np.concatenate([self.sums[:at], np.zeros((at + 2 * len(new), self.sums.shape[1]))])
        for lo in range(0, len(new), 1 << 15):
            own = new[lo : lo + (1 << 15)]
            split = [segments(p) for p in own]
            flat = [w for s in split for w in s]
            sums = np.zeros((len(own), self.sums.shape[1]))
            if flat:
                owner = np.repeat(np.arange(len(own)), [len(s) for s in split])
                np.add.at(sums[:, :-1], owner, self.models.words(flat))
                np.add.at(sums[:, -1], owner, np.fromiter((len(w) + 1 for w in flat), np.float64, len(flat)))
            self.sums[at : at + len(own)] = sums
            self.rows.update(zip(own, range(at, at + len(own)), strict=True))
            at += len(own)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in bits a letter in each language, letters and word ends) of each text; 0 letters: none."""
        out = np.zeros((len(texts), self.sums.shape[1]))
        for lo, hi in text_groups([t or "" for t in texts], GROUP_CHARS):
            parts = [t.replace("\n", " ").split(" ") if t else [] for t in texts[lo:hi]]
            self._prepare(set().union(*parts))
            get = self.rows.__getitem__
            for i, p in enumerate(parts, lo):
                if p:
                    out[i] = self.sums[np.fromiter(map(get, p), np.int64, len(p))].sum(0)
        n = out[:, -1]
        return -out[:, :-1] / np.maximum(n, 1)[:, None], n

    def verdicts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, best cross-entropy, whether rejected)"""
        m = self.models
        if not m.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp2(-m.scale * np.sqrt(n)[:, None] * (h - low[:, None])).sum(1)
        none = n == 0
        reject = none.copy()
        reject |= low > m.most + m.slack / np.sqrt(np.maximum(n, 1))
        langs = [UNKNOWN if x else m.langs[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
        return langs, np.where(none, 0.0, score), low, reject


def shuffled(text: str | None) -> str | None:
    """The text with its letters in another order, and its words as long as they were."""
    if not text:
        return text
    letters = [c for c in text if c.isalpha()]
    order = np.random.default_rng(len(letters)).permutation(len(letters)).tolist()
    mixed = iter([letters[i] for i in order])
    return "".join([next(mixed) if c.isalpha() else c for c in text])


def _training(df: DataFrame, calibrate: bool, most: int, langs: dict[str, int]) -> DataFrame:
    """About most rows of each language, chosen by a hash of the id. One row in five is for calibration, the others for fitting."""
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) == 0
    share = F.create_map(*(x for lang, n in langs.items() for x in (F.lit(lang), F.lit(min(1.0, most / (n * (0.2 if calibrate else 0.8)))))))
    return df.where((part if calibrate else ~part) & (F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, fit_docs: int = FIT_DOCS, calibrate_docs: int = CALIBRATE_DOCS) -> Models:
    """Models of the languages in labelled; runs at once. Only n-gram counts and scores of the samples reach the driver."""
    rows = pick(labelled, doc_id=id_col, text=text_col, lang=lang_col).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").withColumn("lang", F.col("lang").cast("string"))
    langs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return Models({}, order)

    def count(batches):
        found = defaultdict(Counter)
        for b in batches:
            words = defaultdict(Counter)
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words[lang].update(text.split())
            for lang, own in words.items():
                for part, n in own.items():
                    for w in segments(part):
                        for g in grams(w, order):
                            found[lang][g] += n
        flat = [(lang, g, n) for lang, own in found.items() for g, n in own.items()]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in map(list, zip(*flat, strict=True))], names=["lang", "gram", "n"])

    counted = map_batches(_training(rows, False, fit_docs, langs).select("text", "lang"), count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in langs}
    for r in counted.toLocalIterator():
        counts[r.lang][r.gram] = r.n
    models = Models({k: v for k, v in counts.items() if v}, order)
    if models.langs:
        _calibrate(models, _training(rows, True, calibrate_docs, langs))
    return models


def _calibrate(models: Models, rows: DataFrame) -> None:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        own = Scorer(shared.value)
        for b in batches:
            texts = b.column(0).to_pylist()
            h, n = own.entropies(texts)
            other, _ = own.entropies([shuffled(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n), pa.array(list(h), pa.list_(pa.float64())), pa.array(other.min(1) if len(texts) else [], pa.float64())], names=["lang", "n", "h", "other"])

    found = [r for r in map_batches(rows.select("text", "lang"), score, "lang string, n double, h array<double>, other double").where("n > 0").collect() if r.lang in models.langs]
    if not found:
        return
    h, n = np.array([r.h for r in found]), np.array([r.n for r in found])
    true = np.array([models.langs.index(r.lang) for r in found])
    gap = np.sqrt(n)[:, None] * (h - h.min(1)[:, None])

    def loss(scale: float) -> float:
        z = np.exp2(-scale * gap)
        return -np.log(np.maximum(z[np.arange(len(z)), true] / z.sum(1), 1e-9)).mean()

    models.scale = min((2.0**k for k in range(-4, 7)), key=loss)
    low, other = h.min(1), np.array([r.other for r in found])
    long = n >= min(200, np.median(n))
    own, mixed = float(np.quantile(low[long], 0.999)), float(np.quantile(other[long], 0.01))
    models.most = (own + mixed) / 2 if mixed > own else own + 1
    models.slack = 2 * float(np.sqrt(((low - np.median(low)) ** 2 * n).mean()))


def predict(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (bits a letter), rejected for every row."""
    rows = pick(df, doc_id=id_col, text=text_col)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own = Scorer(shared.value)
        for b in batches:
            langs, score, low, reject = own.verdicts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(low), pa.array(reject)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_known(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of df that are not rejected, as they are."""
    at, shared = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(~own.verdicts(b.column(at).to_pylist())[3]))

    rows = unnamed(df)
    return map_batches(rows, run, rows.schema).toDF(*df.columns)
