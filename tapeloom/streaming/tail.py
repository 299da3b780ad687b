"""Following files that grow: a streaming source of their new lines or messages, read by executors.

The offset is how far each file is read, by bytes; the driver asks for sizes only. What lies between two offsets of a
file is one partition, read in pieces of at most maxBytes, of which a task holds one. A batch takes a piece of each file;
of a file that it is behind with, as much again as was read of it before, so that a long file takes few batches. A task takes up what was left open where it starts, gives out what ends in
its part, and leaves a mark in the shared folder of where it stands: the line's number, how many messages that line has
given, and where what is still open begins. So no line is counted twice, and what waits is read again, not held. Marks
are made anew by reading from an earlier one where they are missing, and are the same however often a task runs; what is
given out does not depend on where reads end, but for how soon. A file that has shrunk is read from its start.

Lines: one that has not ended waits. A line longer than maxPending is given out in pieces under its number, each cut where
the last message in it starts, or else near the bound, never within a character. Messages: a message is given out as soon
as its end is read, whether or not its line has ended. An open message longer than maxPending is given up in favour of
the last start within it, or for good. Ends of lines are LF, CRLF and a CR that something else follows. Text that is not
UTF-8 is refused, as in a batch, unless badBytes is "replace".
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tapeloom.functions import fix
from tapeloom.operators import messages
from tapeloom.session import scratch, ship
from tapeloom.sources.ranges import filesystem

#: How much of an open line or message may wait.
PENDING, MOST = 1 << 20, 1 << 24
SCHEMA = "file string, file_ordinal int, line_no long, line string"
MESSAGES = "file string, file_ordinal int, line_no long, msg_idx int, raw string"
_LINE_END = re.compile(rb"\r\n|\n|\r(?=[\s\S])")
#: A start after white space or SOH gives up what was open before it; an end.
_EVENT = re.compile("(?<=[\t-\r\x1c-\x20  -  -    　\x01])(8=FIX)|(8=FIX)|(\x0110=[0-9]{3}\x01)")
_BEGIN = fix.BEGIN.encode()


class TailSource(DataSource):
    """spark.readStream.format("tapeloom_tail").option("path", glob).option("marks", shared folder).load()

    Options: give ("lines" or "messages"), delim, maxBytes, maxPending, badBytes ("refuse" or "replace").
    """

    @classmethod
    def name(cls) -> str:
        return "tapeloom_tail"

    def schema(self) -> str:
        return MESSAGES if self.options.get("give") == "messages" else SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return TailReader(o["path"], int(o.get("maxBytes", MOST)), int(o.get("maxPending", PENDING)), o.get("marks"), o.get("give", "lines") == "messages", o.get("delim", fix.SOH), o.get("badBytes", "refuse"))


class Part(InputPartition):
    def __init__(self, file: str, ordinal: int, life: int, at: int, upto: int):
        self.file, self.ordinal, self.life, self.at, self.upto = file, ordinal, life, at, upto


def _piece(window: bytes) -> int:
    """How much of a line beyond the bound is given out: up to the last message start, or near the end of the window."""
    if (at := window.rfind(_BEGIN)) > 0:
        return at
    back = 1  # not within a character: what is left begins with its first byte
    while back < min(4, len(window)) and 0x80 <= window[-back] < 0xC0:
        back += 1
    return len(window) - back or len(window)


def lines(data: bytes, line_no: int, pending: int) -> tuple[list[tuple[int, bytes]], int, int]:
    """(numbered lines and pieces that end in data, the number of lines then ended, where what is open begins); data: from the begin of an open line."""
    out, at = [], 0

    def pieces(end: int) -> None:
        nonlocal at
        while end - at > pending:
            size = _piece(data[at : at + pending + 1])
            out.append((line_no + 1, data[at : at + size]))
            at += size

    for m in _LINE_END.finditer(data):
        pieces(m.start())
        out.append((line_no + 1, data[at : m.start()]))
        line_no, at = line_no + 1, m.end()
    pieces(len(data) - data.endswith(b"\r"))
    return out, line_no, at


def _whole(tail: bytes) -> int:
    """How much of an open line is whole characters, and no CR that may be half of its end."""
    n = len(tail) - tail.endswith(b"\r")
    for back in range(1, min(3, n) + 1):
        lead = tail[n - back]
        if lead >= 0xC0:
            return n - back if 2 + (lead >= 0xE0) + (lead >= 0xF0) > back else n
        if lead < 0x80:
            break
    return n


def found(text: str, pending: int) -> tuple[list[str], int]:
    """(the messages, where what may still matter begins) of a line, or of what is left of one, as far as it is read."""
    out, opened, place = [], None, 0
    slack = pending + len(fix.BEGIN)

    def bounded(upto: int) -> int | None:
        """Where the open message begins once what exceeds the bound before a place is given up."""
        at = opened
        while at is not None and upto - at > slack:
            last = text.rfind(fix.BEGIN, at + 1, at + slack)
            at = last if last > 0 else None
        return at

    for m in _EVENT.finditer(text):
        opened = bounded(m.end())
        if m.lastindex < 3:
            opened = m.start() if m.lastindex == 1 or opened is None else opened
        elif opened is not None:
            out.append(text[opened : m.end()])
            opened, place = None, m.end()
    opened = bounded(len(text))
    return out, max(place, len(text) - len(fix.BEGIN) - 1) if opened is None else opened


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int = MOST, pending: int = PENDING, marks: str | None = None, give_messages: bool = False, delim: str = fix.SOH, bad: str = "refuse"):
        self.path, self.most, self.pending, self.marks, self.give_messages, self.delim = path, most, pending, marks, give_messages, delim
        self.errors = "replace" if bad == "replace" else "strict"
        self.planned: dict | None = None

    # --- on the driver -----------------------------------------------------------------------------------------------

    def _sizes(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        own, path = filesystem(self.path)
        head, _, pattern = path.rpartition("/")
        scheme = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        found = own.get_file_info(fs.FileSelector(head or ".", allow_not_found=True))
        return sorted((f"{scheme}{f.path}", f.size) for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, pattern))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """At most maxBytes, or as much again as was read of the file, beyond what was planned last, which is kept in the shared folder for a reader that starts anew."""
        if self.planned is None:
            self.planned = json.loads(self._get("planned") or "{}")
        now = dict(self.planned)
        for file, size in self._sizes():
            own = now.get(file, {"life": 0, "to": 0})
            if size < own["to"]:
                own = {"life": own["life"] + 1, "to": 0}
            now[file] = {"life": own["life"], "to": min(size, own["to"] + max(self.most, own["to"]))}
        if now != self.planned:
            self.planned = now
            self._put("planned", json.dumps(now))
        return now

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for i, (file, own) in enumerate(sorted(end.items())):
            was = start.get(file, {"life": 0, "to": 0})
            at = was["to"] if was["life"] == own["life"] else 0
            if own["to"] > at:
                parts.append(Part(file, i, own["life"], at, own["to"]))
        return parts

    def commit(self, end: dict) -> None:
        """Marks before the offset are needed no more."""
        from pyarrow import fs

        if self.marks:
            own, root = filesystem(self.marks)
            for file, last in end.items():
                for f in own.get_file_info(fs.FileSelector(f"{root}/{self._folder(file, last['life'])}", allow_not_found=True)):
                    if f.base_name.isdigit() and int(f.base_name) < last["to"]:
                        own.delete_file(f.path)

    # --- marks ---------------------------------------------------------------------------------------------------------

    def _folder(self, file: str, life: int) -> str:
        return f"{hashlib.sha256(file.encode()).hexdigest()[:24]}-{life}"

    def _get(self, name: str) -> str | None:
        if not self.marks:
            return None
        own, root = filesystem(self.marks)
        try:
            with own.open_input_stream(f"{root}/{name}") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def _put(self, name: str, text: str) -> None:
        if self.marks:
            import uuid

            own, root = filesystem(self.marks)
            path = f"{root}/{name}"
            own.create_dir(path.rpartition("/")[0], recursive=True)
            with own.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part", compression=None) as f:
                f.write(text.encode())
            own.move(part, path)

    def _mark(self, part: Part) -> tuple[int, list[int]]:
        """(place, mark) of the last mark at or before where a part starts."""
        from pyarrow import fs

        if self.marks and (told := self._get(f"{self._folder(part.file, part.life)}/{part.at}")):
            return part.at, json.loads(told)
        if self.marks:
            own, root = filesystem(self.marks)
            names = [f.base_name for f in own.get_file_info(fs.FileSelector(f"{root}/{self._folder(part.file, part.life)}", allow_not_found=True))]
            for at in sorted((int(n) for n in names if n.isdigit() and int(n) <= part.at), reverse=True):
                if told := self._get(f"{self._folder(part.file, part.life)}/{at}"):
                    return at, json.loads(told)
        return 0, [0, 0, 0]

    # --- on an executor --------------------------------------------------------------------------------------------------

    def _given(self, data: bytes, mark: list[int], base: int) -> tuple[list[tuple], list[int]]:
        """(rows, new mark) for the bytes from where a mark's open part begins, which is base."""
        line_no, given, _ = mark
        if not self.give_messages:
            out, line_no, at = lines(data, line_no, self.pending)
            return [(n, text.decode("utf-8", self.errors)) for n, text in out], [line_no, 0, base + at]
        rows, at = [], 0
        for m in _LINE_END.finditer(data):
            own, _ = found(self._text(data[at : m.start()]), self.pending)
            rows += [(line_no + 1, given + i, raw) for i, raw in enumerate(own)]
            line_no, given, at = line_no + 1, 0, m.end()
        text = data[at : at + _whole(data[at:])].decode("utf-8", "surrogateescape")
        own, rest = found(self._text(text.encode("utf-8", "surrogateescape")), self.pending)
        rows += [(line_no + 1, given + i, raw) for i, raw in enumerate(own)]
        return rows, [line_no, given + len(own), base + at + len(text[:rest].encode("utf-8", "surrogateescape"))]

    def _text(self, data: bytes) -> str:
        if self.errors == "strict":
            data.decode("utf-8")
        text = data.decode("utf-8", "surrogateescape")
        return text if self.delim == fix.SOH else text.replace(self.delim, fix.SOH)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        own, path = filesystem(partition.file)
        at, mark = self._mark(partition)
        with own.open_input_file(path) as f:
            while at < partition.upto:
                upto = min(partition.upto, partition.at if at < partition.at else partition.upto, at + self.most)
                data = f.read_at(upto - mark[2], mark[2])
                try:
                    rows, mark = self._given(data, mark, mark[2])
                except UnicodeDecodeError as e:
                    raise ValueError(f"not UTF-8: {partition.file}") from e
                told, at = at >= partition.at, upto
                if told and rows:
                    yield self._batch(partition, rows)
        self._put(f"{self._folder(partition.file, partition.life)}/{partition.upto}", json.dumps(mark))

    def _batch(self, part: Part, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        head = [pa.array([part.file] * n), pa.array([part.ordinal] * n, pa.int32())]
        line_no, *more, text = zip(*rows, strict=True)
        if self.errors == "replace":
            text = [t.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for t in text]
        body = [pa.array(line_no, pa.int64()), *(pa.array(c, pa.int32()) for c in more), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays([*head, *body], names=[c.split()[0] for c in (MESSAGES if self.give_messages else SCHEMA).split(", ")])


def follow(spark: SparkSession, path: str, marks: str | None = None, **options: str) -> DataFrame:
    """The streaming lines of the files that a glob names, or messages with give="messages".

    marks: a shared folder of the stream's own, the same again for a stream that is to go on after a restart with batches
    within bounds; a new one by default. maxBytes: the most that a task reads at a time.
    """
    ship(spark)
    spark.dataSource.register(TailSource)
    given = spark.readStream.format("tapeloom_tail").option("path", path).option("marks", marks or scratch(spark, "tail"))
    return given.options(**options).load() if options else given.load()


def follow_messages(spark: SparkSession, path: str, delim: str = "\x01", **options: str) -> DataFrame:
    """The streaming messages, parsed, of the files that a glob names, each as soon as it is whole."""
    return messages.parse(follow(spark, path, give="messages", delim=delim, **options))
