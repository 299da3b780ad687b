"""WARC archives written from and read to a chunked record table.

A payload is never held whole outside the row it comes from: it is cut into rows (record, chunk number, bytes), which a
writer streams into the archive of its partition and a reader streams out again, each chunk carrying the digest of the
payload up to and including it. Equal payloads of a least size are stored once, as the response with the smallest page
id; the others are revisit records that name it.

Null payloads count as empty. Null page ids sort after all others and read back as null. Of rows with the same page id
and payload one is the response and the others revisit it. Payloads below the least size are always responses. An empty
table gives no archives and reads back as no rows. Line breaks and blanks in a URL are percent-encoded in the header.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import AtomicFile, filesystem, map_batches, pick

CHUNK = 1 << 18
LEAST_BYTES = 100
_IO = 1 << 16
_NO_ID = "none"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """row, page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to.

    The least page id of each digest is found by partial sums; the join back to the pages moves each payload once, and
    Spark splits what a very common payload makes large.
    """
    rows = (
        pick(pages, page_id=id_col, url=url_col, payload=payload_col)
        .select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
        .withColumn("payload_digest", F.sha2("payload", 256))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("first_digest")).agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = rows.join(first, F.col("payload_digest") == F.col("first_digest"), "left")
    again = F.col("first").isNotNull() & (F.col("row") != F.col("first.row"))
    return joined.select(
        "row", "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.row")).alias("refers_to_row")
    )


def chunks(decided: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table: one row for each chunk of a response's payload; a revisit, or an empty payload, has one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(stored) / chunk_bytes)).cast("int")
    rows = decided.withColumn("payload", stored).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    cut = F.expr(f"substring(payload, chunk * {chunk_bytes} + 1, {chunk_bytes})")
    return rows.withColumn("payload", cut)


def _head(row: dict, date: str) -> bytes:
    url = "".join(c if 0x21 <= ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"] or "")
    page = _NO_ID if row["page_id"] is None else row["page_id"]
    stored = row["payload_bytes"] if row["record_type"] == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{page}:{row['row']}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {url}"] * bool(url)
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["record_type"] == "revisit":
        first = _NO_ID if row["refers_to"] is None else row["refers_to"]
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}:{row['refers_to_row']}>"]
    return "\r\n".join([*lines, f"Content-Length: {stored}", "", ""]).encode()


class _Member:
    """Writes one record at a time, as a gzip member of its own if asked for."""

    def __init__(self, out, gzip: bool):
        self.out, self.gzip, self.open = out, gzip, None

    def start(self) -> None:
        self.open = zlib.compressobj(6, zlib.DEFLATED, 31) if self.gzip else None

    def write(self, data: bytes) -> None:
        self.out.write(self.open.compress(data) if self.open else data)

    def end(self) -> None:
        if self.open:
            self.out.write(self.open.flush())


def write(table: DataFrame, folder: str, gzip: bool = True, date: str = "2024-01-01T00:00:00Z") -> list[tuple[str, int]]:
    """Writes a chunked record table to archives in folder, at once; (file, records) of each archive.

    A record's chunks lie in one partition and in order, as chunks() makes them; the writer checks it.
    """

    def run(batches):
        name = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc{'.gz' * gzip}"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        records = 0
        with AtomicFile(name) as raw:
            out, left, expect = _Member(raw, gzip), 0, None
            batch = first
            while batch is not None:
                for row in batch.to_pylist():
                    if row["chunk"] == 0:
                        out.start()
                        out.write(_head(row, date))
                        records, left = records + 1, row["payload_bytes"] if row["record_type"] == "response" else 0
                    elif (row["row"], row["chunk"]) != expect:
                        raise ValueError("the chunks of a record are not in order")
                    out.write(row["payload"])
                    left, expect = left - len(row["payload"]), (row["row"], row["chunk"] + 1)
                    if not left:
                        out.write(b"\r\n\r\n")
                        out.end()
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records])], names=["file", "records"])

    return sorted((r.file, r.records) for r in map_batches(table, run, "file string, records long").collect())


class _Inflated(io.RawIOBase):
    """A gzip file of any number of members as one readable stream."""

    def __init__(self, raw):
        self.raw, self.member, self.ready = raw, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while not self.ready:
            data = self.member.unconsumed_tail or self.member.unused_data or self.raw.read(_IO)
            if self.member.eof:
                if not data:
                    return 0
                self.member = zlib.decompressobj(31)
            elif not data:
                raise EOFError("the archive ends inside a record")
            self.ready = self.member.decompress(data, _IO)
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def _id(urn: str) -> int | None:
    page = urn.split(":")[2]
    return None if page == _NO_ID else int(page)


def read_file(uri: str, chunk_bytes: int = CHUNK):
    """Yields (headers by lower-case name, chunk number, bytes, digest so far, whether it is the record's last)."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as raw:
        f = io.BufferedReader(_Inflated(raw), _IO) if path.endswith(".gz") else raw
        line = (lambda: f.readline()) if path.endswith(".gz") else _liner(raw)
        get = (lambda n: f.read(n)) if path.endswith(".gz") else line.read
        while version := line():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"{uri}: a record does not start with its version")
            headers = {}
            while (x := line().rstrip(b"\r\n")) != b"":
                k, _, v = x.decode().partition(":")
                headers[k.lower()] = v.strip()
            left, number, digest = int(headers["content-length"]), 0, hashlib.sha256()
            while True:
                data = get(min(left, chunk_bytes)) if left else b""
                if left and not data:
                    raise EOFError(f"{uri} ends inside a record")
                left -= len(data)
                digest.update(data)
                yield headers, number, data, digest.hexdigest(), not left
                number += 1
                if not left:
                    break
            if get(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record does not end as it should")


class _liner:
    """readline() and read() over a pyarrow stream that has no lines."""

    def __init__(self, raw):
        self.raw, self.held = raw, b""

    def __call__(self) -> bytes:
        while b"\n" not in self.held and (more := self.raw.read(_IO)):
            self.held += more
        line, sep, self.held = self.held.partition(b"\n")
        return line + sep

    def read(self, n: int) -> bytes:
        if not self.held:
            self.held = self.raw.read(max(n, _IO))
        data, self.held = self.held[:n], self.held[n:]
        return data if len(data) == n or not data else data + self.read(n - len(data))


def read(spark: SparkSession, files: list[tuple[str, int]], payloads: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """The archives as a chunked record table: page_id, url, record_type, refers_to, payload_bytes, stated_digest, chunk, payload, digest (of the payload so far), last.

    payloads: whether to return the bytes. A revisit's one chunk is empty; its stated digest and bytes are the payload's.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, stated_digest string, chunk int, payload binary, digest string, last boolean"
    if not files:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(f,) for f, _ in files], "file string").repartition(len(files), "file")

    def run(batches):
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for h, number, data, digest, last in read_file(name, chunk_bytes):
                    rows.append({"page_id": _id(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": _id(h["warc-refers-to"]) if "warc-refers-to" in h else None, "payload_bytes": int(h["x-payload-length"]), "stated_digest": h["warc-payload-digest"].removeprefix("sha256:"), "chunk": number, "payload": data if payloads else None, "digest": digest, "last": last})
                    size += len(data) + 200
                    if size > 1 << 22:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return map_batches(table, run, schema)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "chunk": pa.int32(), "payload": pa.binary(), "last": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
