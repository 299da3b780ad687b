"""Token ids of documents in binary files.

Documents are range-partitioned by id, encoded, and written in ascending id order, one file a partition, so that the
files in order of their numbers hold the corpus in order. A file is a row of 64-bit Simple-8b words in blocks of a
fixed number of ids, then a footer: escapes, each block's first word, each document's id and number of ids, and which ids are null. The footer
lets a reader decode any block, or any document's blocks, by itself. Files go to a shared folder and get their names
only once complete, so a task may fail or run twice.

Encoding keeps a cache of what the text between two blanks encodes to. The vocabulary's normaliser and splitter never
look across white space, so the pieces of a text are the pieces of its parts. The file's added tokens count as the
library counts them: where a text spells one out, it is that token. What the cache lacks goes to the library, or, for words of short Latin letters, to the same vectorised merging as byte-level BPE, which gives
the same ids at a tenth of the time.

Null texts count as empty and have the end id alone. Document ids are whole numbers; null ones come first, kept as null. Repeated ids keep all
their rows, ordered by text. An empty table gives no files and reads back as no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import simple8b
from tapeloom.llm.byte_bpe import Pairs, merge_many
from tapeloom.llm.common import AtomicFile, byte_groups, filesystem, map_batches, pick, resident, split_words

MAGIC = b"TLTOK2\0\0"
_TRAILER = struct.Struct("<QQQQQ8s")  # documents, ids, blocks, words, escapes, MAGIC
#: So many ids are packed, written and read at a time.
GROUP = 128 * simple8b.BLOCK
CACHE_PARTS = 400_000
SHORT = 32
#: Printable Latin characters: each is its own composed form, and its class and lower case are settled.
_SETTLED = "[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordBpe:
    """Encodes with a tokenizers file, through a cache of the parts between blanks."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        self.library = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._tables(spec)
        split = next((p["pattern"]["Regex"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        self.split = regex.compile(split).findall if split else None
        self.settled = re.compile(_SETTLED).fullmatch
        added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda part: None
        self.added_letters = any(map(str.isalpha, added))
        self.marks = "|".join(f"(?i){re.escape(t)}" for t in added) or r"[^\s\S]"

    def _tables(self, spec: dict) -> bool:
        """Whether merging here gives the library's ids: ids must rank the merges, in a lower-casing byte-level BPE with word ends."""
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [(p["type"], p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or not end or model.get("ignore_merges") or kinds != ["NFC", "Replace", "Lowercase"] or splits != [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]:
            return False
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(set(ids)):
            return False
        self.pairs = Pairs({(vocab[a], vocab[b]): i for (a, b), i in zip(merges, ids, strict=True)})
        letters = _byte_letters()
        self.inner, self.last = (np.array([vocab[x + tail] for x in letters], np.int32) for tail in ("", end))
        return True

    def _packed(self, wanted: list[str]) -> list[bytes]:
        """The ids of each part. What is new comes into the cache with the words that it is made of."""
        out = list(map(self.parts.get, wanted))
        at = [i for i, ids in enumerate(out) if ids is None]
        if len(self.parts) + len(at) > CACHE_PARTS:
            self.parts = {p: ids for p, ids in zip(wanted, out, strict=True) if ids is not None}
        new = [wanted[i] for i in at]
        self._prepare(new)
        for i, part in zip(at, new, strict=True):
            out[i] = self.parts[part]
        return out

    def _prepare(self, new: list[str]) -> None:
        if not self.fast:
            self._ask(new)
            return
        plain, slow, split = [], [], {}
        for part in new:
            if part.isalpha() and part.isascii() and part.islower() and not self.added_letters:
                plain.append(part)
            elif not self.settled(part) or self.added(part):
                slow.append(part)
            elif part.isalpha():
                split[part] = (part.lower(),)
            elif part[-1] in ".,;:!?" and part[:-1].isalpha():
                split[part] = (part[:-1].lower(), part[-1])
            else:
                split[part] = self.split(part.lower())
        self._merge(plain)
        self._merge({w for own in split.values() for w in own if w not in self.parts})
        for part, own in split.items():
            self.parts[part] = b"".join([self.parts[w] for w in own]) if len(own) != 1 else self.parts[own[0]]
        self._ask(slow)

    def _merge(self, words) -> None:
        groups: dict[int, list[str]] = {}
        long = []
        for w in words:
            n = len(w) if w.isascii() else len(w.encode())
            if n <= SHORT:
                groups.setdefault((n + 3) // 4, []).append(w)
            else:
                long.append(w)
        for group in groups.values():
            for lo in range(0, len(group), 1 << 16):
                some = group[lo : lo + (1 << 16)]
                self.parts.update(zip(some, merge_many([w.encode() for w in some], self.inner, self.pairs, self.last), strict=True))
        self._ask(long)

    def _ask(self, parts: list[str]) -> None:
        for lo in range(0, len(parts), 5000):
            some = parts[lo : lo + 5000]
            for part, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[part] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, one after another; how many each has)"""
        if self.fast and not pc.any(pc.match_substring_regex(texts, self.marks)).as_py():
            texts = pc.ascii_lower(texts)  # fewer distinct words; added tokens alone are told by case
        found, own, counts = split_words(texts)
        parts = found.cast(pa.string()).to_pylist()
        packed = self._packed(parts)
        flat, size = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start, ids = np.cumsum(size) - size, []
        for lo in range(0, len(own), 1 << 16):
            some = own[lo : lo + (1 << 16)]
            each = size[some]
            upto = np.cumsum(each)
            ids.append(flat[np.repeat(start[some] - upto + each, each) + np.arange(upto[-1])])
        upto = np.concatenate([[0], np.cumsum(size[own])])
        ends = np.cumsum(counts)
        return np.concatenate([np.empty(0, "<u4"), *ids]), upto[ends] - upto[ends - counts]


def _encoder(path: str) -> WordBpe:
    return resident(("word_bpe", path), lambda: WordBpe(path))


class Writer:
    """Appends documents to an open binary stream and closes them with the footer."""

    def __init__(self, out):
        self.out, self.held, self.held_ids = out, [], 0
        self.docs, self.sizes, self.offsets, self.escapes, self.words = [], [], [np.zeros(1, np.int64)], [], 0

    def add(self, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with so many ids each, which stand one after another in ids."""
        self.docs += docs
        self.sizes += sizes.tolist()
        for at in range(0, len(ids), GROUP):
            some = ids[at : at + GROUP]
            self.held.append(some)
            self.held_ids += len(some)
            if self.held_ids >= GROUP:
                self._flush(GROUP)

    def _flush(self, n: int) -> None:
        if not n:
            return
        ids = np.concatenate(self.held)
        self.held, self.held_ids = [ids[n:]], len(ids) - n
        words, offsets, escapes = simple8b.encode(ids[:n])
        self.out.write(words.astype("<u8").tobytes())
        self.offsets.append(offsets[1:] + self.words)
        self.words += len(words)
        self.escapes.append(escapes)

    def close(self) -> int:
        self._flush(self.held_ids)
        offsets, escapes = np.concatenate(self.offsets), np.concatenate([np.empty(0, np.uint64), *self.escapes])
        docs = np.fromiter((d or 0 for d in self.docs), np.int64, len(self.docs))
        for x, kind in ((escapes, "<u8"), (offsets, "<i8"), (docs, "<i8"), (np.array(self.sizes, np.int64), "<i8")):
            self.out.write(x.astype(kind).tobytes())
        self.out.write(np.packbits([d is None for d in self.docs]).tobytes())
        n = sum(self.sizes)
        self.out.write(_TRAILER.pack(len(self.docs), n, len(offsets) - 1, self.words, len(escapes), MAGIC))
        return n


def read_file(uri: str):
    """(document id or None, its ids packed as little-endian 32-bit integers), in order; a group of blocks is in memory at a time."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        docs, n, blocks, words, escapes, magic = _TRAILER.unpack(f.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        f.seek(8 * words)
        part = lambda count, kind: np.frombuffer(f.read(8 * count), kind)
        escaped, offsets, ids, sizes = part(escapes, "<u8"), part(blocks + 1, "<i8"), part(docs, "<i8"), part(docs, "<i8")
        null = np.unpackbits(np.frombuffer(f.read(-(-docs // 8)), np.uint8), count=docs).tolist()
        f.seek(0)
        held, have, at, step = [], 0, 0, GROUP // simple8b.BLOCK
        for doc, missing, need in zip(ids.tolist(), null, sizes.tolist(), strict=True):
            while have < need:
                upto = min(at + step, blocks)
                count = min(n, upto * simple8b.BLOCK) - at * simple8b.BLOCK
                raw = np.frombuffer(f.read(8 * int(offsets[upto] - offsets[at])), "<u8")
                held.append(simple8b.decode(raw, offsets[at : upto + 1] - offsets[at], count, escaped).astype("<u4"))
                have, at = have + count, upto
            if len(held) > 1:
                held = [np.concatenate(held)]
            whole = held[0] if held else np.empty(0, "<u4")
            yield None if missing else doc, whole[:need].tobytes()
            held, have = [whole[need:]], have - need


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encodes each text, appends end_id unless it is None, and writes the ids to files in folder in ascending order of id.

    Runs at once. Returns (file, its documents, its ids) for each file in order: a few numbers a partition.
    """
    rows = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        part, own = TaskContext.get().partitionId(), _encoder(tokenizer)
        first = next(batches, None)
        if first is None:
            return
        name = f"{folder}/tokens-{part:06d}.bin"
        with AtomicFile(name) as out:
            writer = Writer(out)
            while first is not None:
                docs, texts = first.column(0).to_pylist(), first.column(1)
                for lo, hi in byte_groups(texts):
                    ids, sizes = own.encode(texts.slice(lo, hi - lo))
                    if end_id is not None:
                        ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                    writer.add(docs[lo:hi], sizes, ids)
                first = next(batches, None)
            n = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(writer.docs)]), pa.array([n])], names=["part", "file", "docs", "ids"])

    found = map_batches(ordered, run, "part long, file string, docs long, ids long", ("word_bpe", tokenizer)).collect()
    return [(r.file, r.docs, r.ids) for r in sorted(found, key=lambda r: r.part)]


def read(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it in all files), ids (packed as little-endian 32-bit integers)."""
    rows, start = [], 0
    for name, _, n in files:
        rows.append((name, start))
        start += n
    table = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)), "file") if rows else spark.createDataFrame([], "file string, start long")

    def run(batches):
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, starts, ids, size = [], [], [], 0

                def out(docs, starts, ids):
                    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

                for doc, packed in read_file(name):
                    docs.append(doc)
                    starts.append(at)
                    ids.append(packed)
                    at, size = at + len(packed) // 4, size + len(packed)
                    if size > 1 << 23:
                        yield out(docs, starts, ids)
                        docs, starts, ids, size = [], [], [], 0
                if docs:
                    yield out(docs, starts, ids)

    return map_batches(table, run, "doc_id long, start long, ids binary")
