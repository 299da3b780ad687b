"""Secret scans: three fixed forms, and a battery of randomness tests for whatever else looks like a key.

Fixed forms, each leftmost and non-overlapping: assign (a telling name, a sign, a value), access, hex.

Battery: a candidate is a run of key characters of LEAST or more, cut after each '=' or row of them, which is padding of
what stands before and never part of a key: so the value of NAME=value is a candidate of its own. The smallest alphabet
that holds it is taken for its encoding. Against uniform draws from that alphabet it is tested for the symbols' counts (chi-squared, both
tails), for runs above and below the middle of the alphabet, and for the correlation of neighbours; Fisher's method
joins the three, and a candidate that uniform draws would hardly give is withdrawn, as is first of all what fixed forms
cover by half or more. What is left must be improbable as text: the likelihood ratio of uniform draws against a fixed character
distribution of prose. Its reciprocal bounds the p-value under prose, and it sharpens with length by itself: the three
tests' own p-values can only speak against uniform draws, never for them, so the error that the step controls has to come
from this bound. Of the candidates left those are reported that a Benjamini-Hochberg step accepts, with weights in
proportion to length. All of this looks at one document at a time, so a
document's result does not depend on others.

What of a run is not reported whole, or fits no alphabet, is tried by its parts in a second such step: each piece between
'+', '/', '-' and '_', and the ranges of neighbouring pieces of most evidence within base64 and within base64url, so that
a key is found that a path or a name is glued to, with these signs in it or not. A range is one of as many as there are
pieces to start from, and its evidence is less by the log of that. Of overlapping parts that with most evidence is taken.

Null texts count as empty and have no spans. Spans count code points, the end exclusive. Repeated rows give a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import map_batches, pick, unnamed

KINDS = ("assign", "access", "hex", "random")
#: The forms, and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST = 12, 20
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN, _CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), re.compile(r"[A-Za-z0-9+/_-]+=*")
#: What may stand in a range of pieces, and in one of its pieces.
_JOINED = [(re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9]+"), "base64"), (re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z0-9]+"), "base64url")]
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From small to large, each in the order of its symbols' values. Runs of digits are no keys.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "mixedhex": _DIGITS + "abcdefABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567", "alnum": _DIGITS + _LOWER, "ALNUM": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_PLACES = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
#: Letters of prose in percent, a to z.
_PERCENT = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
_PROSE = {c: math.log(0.84 * p / sum(_PERCENT)) for c, p in zip(_LOWER, _PERCENT, strict=True)}
_PROSE |= {c.upper(): x + math.log(0.12 / 0.84) for c, x in _PROSE.items()} | {c: math.log(0.003) for c in _DIGITS} | {c: math.log(0.004) for c in "+/_=-"}
#: What a piece must add to make a range longer; one that adds less is taken along after a key, and before one of several pieces.
JOIN = 4.0
#: Uniform draws give a smaller joint p-value once in this many; false discoveries among what is reported.
RANDOM_P, FALSE_DISCOVERIES = 1e-3, 1e-3


def encoding(s: str) -> str | None:
    """The smallest alphabet that holds s, or None if it is all digits, or in none."""
    s = s.rstrip("=")
    if not s or s.isdigit():
        return None
    own = set(s)
    return next((k for k, a in _SETS.items() if own <= a), None)


def _two_tails(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(s: str, kind: str) -> float:
    """The joint p-value of the three tests under uniform draws from the alphabet."""
    s = s.rstrip("=")
    places, n, a = _PLACES[kind], len(s), len(ALPHABETS[kind])
    x = [places[c] for c in s]
    chi = a / n * sum(k * k for k in Counter(x).values()) - n
    ps = [_two_tails((chi - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n))]
    high = [v >= a / 2 for v in x]
    up = sum(high)
    down = n - up
    if up and down and n > 2:
        runs = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(_two_tails((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    mean = sum(x) / n
    square = sum((v - mean) ** 2 for v in x)
    if square:
        r = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False)) / square
        ps.append(_two_tails((r + 1 / n) * math.sqrt(n)))
    else:
        ps.append(0.0)
    half = -sum(math.log(max(p, 1e-300)) for p in ps)  # half of Fisher's statistic; its tail with 6 degrees of freedom:
    return math.exp(-half) * (1 + half + half * half / 2)


def evidence(s: str, kind: str) -> float:
    """The log likelihood ratio of uniform draws from the alphabet against prose; where signs or no others stand by upper case, against prose in upper case."""
    s = s.rstrip("=")
    if kind in ("upper", "base64", "base64url") and s.isupper():
        s = s.lower()
    return -len(s) * math.log(len(ALPHABETS[kind])) - sum(map(_PROSE.__getitem__, s))


def accepted(found: list[tuple[int, float]], rate: float = FALSE_DISCOVERIES) -> list[bool]:
    """Weighted Benjamini-Hochberg over (length, log evidence): p-values exp(-evidence), weights in proportion to length."""
    m, total = len(found), sum(n for n, _ in found)
    scaled = [min(0.0, -e) - math.log(n * m / total) for n, e in found]
    order = sorted(range(m), key=scaled.__getitem__)
    last = max((k for k, i in enumerate(order, 1) if scaled[i] <= math.log(rate * k / m)), default=0)
    out = [False] * m
    for i in order[:last]:
        out[i] = True
    return out


def _best_ranges(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal ranges (from, to) of most score, by Ruzzo and Tompa; links to the last range that starts lower keep it linear."""
    found: list[tuple[int, int, float, float, int]] = []  # from, to, sum before, sum with it, link
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, low, total, j))
    return [(a, b) for a, b, *_ in found]


def _parts(text: str, start: int, end: int) -> list[tuple[int, int, float]]:
    """(from, to, what its choice costs) of the parts of a run that may be keys; padding goes with the last."""
    run = text[start:end]
    body = len(run.rstrip("="))
    out = {(m.start(), m.end()): 0.0 for m in _JOINED[0][1].finditer(run)}
    for allowed, piece, kind in _JOINED:
        size = math.log(len(ALPHABETS[kind]))
        for m in allowed.finditer(run):
            if m.end() - m.start() < LEAST - (len(run) - body):
                continue
            pieces = [(p.start(), p.end()) for p in piece.finditer(run, m.start(), m.end())]
            scores, at = [], m.start()
            for _, b in pieces:
                scores.append(-JOIN - sum(size + _PROSE[c] for c in run[at:b]))
                at = b
            best = sorted(_best_ranges(scores))
            for (i, j), before, after in zip(best, [0, *(j for _, j in best)], [*(i for i, _ in best[1:]), len(pieces)], strict=False):
                several = j - i > 1
                while j < after and scores[j] > -JOIN:
                    j += 1
                while several and i > before and scores[i - 1] > -JOIN:
                    i -= 1
                out.setdefault((pieces[i][0], pieces[j - 1][1]), math.log(len(pieces)))
    padded = ((a, len(run) if b == body else b, cost) for (a, b), cost in out.items())
    return [(start + a, start + b, cost) for a, b, cost in padded if b - a >= LEAST and (a, b) != (0, len(run))]


def _random(text: str, candidates: list[tuple[int, int, float]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the candidates (from, to, cost) that spans before leave more than half of, that uniform draws may give and that one step accepts."""
    found = []
    for a, b, cost in candidates:
        s = text[a:b]
        if 2 * sum(max(0, min(b, y) - max(a, x)) for x, y in taken) >= b - a or not (kind := encoding(s)):
            continue
        e = evidence(s, kind) - cost
        if e <= 0 or randomness(s, kind) >= RANDOM_P:  # what prose explains better stays in the count, as it can't be accepted
            found.append((e, a, b))
    out: list[tuple[int, int]] = []
    for _, a, b in sorted((f for f, ok in zip(found, accepted([(b - a, e) for e, a, b in found]), strict=True) if ok), key=lambda f: (-f[0], f[1])) if found else ():
        if not any(x < b and a < y for x, y in out):
            out.append((a, b))
    return out


def spans(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the secret itself starts) by start, then kind."""
    if not text:
        return []
    out = [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text)]
    if ("=" in text or ":" in text) and any(map(text.lower().__contains__, _NAMES)):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    runs = [(m.start() + c.start(), m.start() + c.end()) for m in _RUN.finditer(text) for c in _CANDIDATE.finditer(m[0]) if len(c[0]) >= LEAST]
    if runs:
        taken = [(x, y) for _, x, y, _ in out]
        whole = _random(text, [(a, b, 0.0) for a, b in runs], taken)
        taken += whole
        parts = [p for a, b in runs if (a, b) not in whole for p in _parts(text, a, b)]
        out += [("random", a, b, a) for a, b in (*whole, *_random(text, parts, taken))]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.int32())])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, secret), for every row."""
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches):
        names = ("kind", "start", "end", "secret")
        for b in batches:
            found = [[dict(zip(names, x, strict=True)) for x in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,secret:int>>")


def mask(text: str | None, by: str = "[SECRET]") -> str | None:
    """The text with each secret replaced; what names it stays. Overlapping secrets are replaced as one."""
    found = sorted((s, e) for _, _, e, s in spans(text))
    if not found:
        return text
    out, at = [], 0
    for i, (a, b) in enumerate(found):
        if a >= at or not i:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """The rows of df with the secrets in text_col replaced. Null texts stay null."""
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([mask(t, by) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    rows = unnamed(df)
    return map_batches(rows, run, rows.schema).toDF(*df.columns)


def joined(found):
    """An array of spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
