"""Helpers that the operators share: Arrow mapping over (id, text) rows, ids, and the file system behind a URI."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import ship

#: A-Z to a-z and nothing else, as the contracts ask.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def unnamed(df: DataFrame) -> DataFrame:
    """The rows with columns c0, c1, ... in their places, so that no name can clash with another, in whatever case."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, renamed; extra columns of whatever names are left behind. Names match exactly as written, the first of equals."""
    return unnamed(df).select(*(F.col(f"c{df.columns.index(have)}").alias(want) for want, have in cols.items()))


_RESIDENT: dict = {}


def resident(key: tuple, make: Callable):
    """What a worker keeps from task to task for one operator, such as a vocabulary with its cache. It holds one such thing at a time."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def _release(keeps: tuple | None) -> None:
    """Drops what another operator has left in this worker."""
    if keeps not in _RESIDENT:
        _RESIDENT.clear()
    trim()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def trim() -> None:
    """Gives what was freed back to the system. Allocators keep it, and a worker lives through all operators of a session."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: tuple | None = None) -> DataFrame:
    """mapInArrow. The cyclic garbage collector rests meanwhile: caches of many small objects leave no cycles, and it would walk them again and again.

    keeps: the key of what fn takes from resident(), if it does.
    """
    ship(df.sparkSession)

    def run(batches):
        _release(keeps)
        gc.disable()
        try:
            yield from fn(batches)
        finally:
            gc.enable()
            trim()

    return df.mapInArrow(run, schema)


def text_groups(texts: list, most_chars: int) -> Iterator[tuple[int, int]]:
    """Cuts a list of texts into runs (from, to) of about most_chars; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > most_chars:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def byte_groups(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Cuts an array of texts into runs (from, to) of at most so many bytes; a longer text is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place among them of each text's words in turn, the words of each text); words stand between
    ASCII white space. Null counts as empty."""
    plain = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(plain)
    coded = lists.flatten().dictionary_encode()
    own, sizes, empty = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64), pc.equal(plain, "").to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text gives one empty word
        own, sizes = own[np.repeat(~empty, sizes)], np.where(empty, 0, sizes)
    return coded.dictionary.cast(pa.binary()), own, sizes


def filesystem(uri: str):
    """(pyarrow file system, path) behind a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


class AtomicFile:
    """A file that appears under its name only once complete, so that a task may fail, run again or run twice."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)
