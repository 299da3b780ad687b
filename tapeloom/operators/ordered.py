"""The rows of a group in order, whatever their number, in memory that does not follow it.

Up to RUN rows are sorted where they are. Beyond that, sorted runs go to a temporary file of the task, in pieces, and are
merged as they are read: of each run one piece is held at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are sorted at once; rows of a run that are read at once.
RUN, PIECE = 1 << 16, 1 << 10


def _in_order(rows: pa.Table, order: list[str]) -> pa.Table:
    return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in order]))


def _upto(rows: pa.Table, order: list[str], last: tuple) -> int:
    """How many of the sorted rows stand no later than last."""
    before, same = pa.scalar(False), pa.scalar(True)
    for c, x in zip(order, last, strict=True):
        x = pa.scalar(x, rows.schema.field(c).type)
        before, same = pc.or_(before, pc.and_(same, pc.less(rows[c], x))), pc.and_(same, pc.equal(rows[c], x))
    return pc.sum(pc.or_(before, same)).as_py() or 0


def _merged(file: pa.ipc.RecordBatchFileReader, runs: list[range], order: list[str]) -> Iterator[pa.Table]:
    """The runs' rows in order; runs: which batches of the file each has."""
    left = [iter(r) for r in runs]
    held: list[pa.Table | None] = [None] * len(runs)
    while True:
        for k, own in enumerate(held):
            if left[k] and not own:
                at = next(left[k], None)
                held[k] = pa.Table.from_batches([file.get_batch(at)]) if at is not None else None
                left[k] = left[k] if at is not None else None
        if not (some := [k for k, own in enumerate(held) if own]):
            return
        lasts = [tuple(held[k][c][-1].as_py() for c in order) for k in some if left[k]]
        parts = []
        for k in some:
            n = _upto(held[k], order, min(lasts)) if lasts else len(held[k])
            parts.append(held[k].slice(0, n))
            held[k] = held[k].slice(n)
        yield _in_order(pa.concat_tables(parts), order)


class Ordered:
    """The rows of tables with one schema by order, columns without nulls; rows of one place as they came.

    They are taken in at once; len() is their number. Read slices() once, and close() it after.
    """

    def __init__(self, tables: Iterator[pa.Table], order: list[str]):
        self.order, self.rows, self.file, self.runs = [*order, "_came"], 0, None, []
        held, n = [], 0
        for table in tables:
            for at in range(0, len(table), RUN):
                part = table.slice(at, RUN)
                held.append(part.append_column("_came", pa.array(np.arange(self.rows, self.rows + len(part)))))
                self.rows, n = self.rows + len(part), n + len(part)
                if n >= RUN:
                    self._spill(held)
                    held, n = [], 0
        self.last = _in_order(pa.concat_tables(held), self.order) if held else None
        if self.file and held:
            self._spill([self.last])
            self.last = None

    def __len__(self) -> int:
        return self.rows

    def _spill(self, held: list[pa.Table]) -> None:
        rows = _in_order(pa.concat_tables(held), self.order).combine_chunks()
        if self.file is None:
            self.file = tempfile.TemporaryFile()
            self.sink = pa.PythonFile(self.file, "w")
            self.out = pa.ipc.new_file(self.sink, rows.schema)
        batches, first = rows.to_batches(max_chunksize=PIECE), self.runs[-1].stop if self.runs else 0
        for b in batches:
            self.out.write_batch(b)
        self.runs.append(range(first, first + len(batches)))

    def slices(self, most: int) -> Iterator[pa.Table]:
        """The rows in order, some at a time: most, but where runs are merged, at least as many as are at hand."""
        if self.file:
            self.out.close()
            self.file.seek(0)
            found, held, n = _merged(pa.ipc.open_file(pa.PythonFile(self.file, "r")), self.runs, self.order), [], 0
        else:
            found, held, n = iter([self.last] if self.last is not None else []), [], 0
        for part in found:
            for at in range(0, len(part), most):
                held.append(part.slice(at, most))
                n += len(held[-1])
                if n >= most:
                    yield pa.concat_tables(held).drop_columns(["_came"])
                    held, n = [], 0
        if held:
            yield pa.concat_tables(held).drop_columns(["_came"])

    def close(self) -> None:
        if self.file:
            self.file.close()
