"""Streams of lines whose meaning depends on what came before: the negotiated dictionary of a session, and given aliases.

Each micro-batch runs the same operators as a batch job. What a stream has negotiated is a row: a batch writes the rows of
all streams under its number in a shared folder before its messages are given out, reads those of the batch before it, and
drops older ones. Aliases are in the state store, a shelf of many to an entry; a batch asks for the shelves of the values in its own lines. So
the cost of a batch does not depend on how many came before. A batch that is run again does the same once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from tapeloom.functions import fix
from tapeloom.operators import messages, obfuscate, session
from tapeloom.operators.dictionary import Tables
from tapeloom.operators.ordered import Ordered
from tapeloom.operators.overlay import Overlay
from tapeloom.session import ship, with_map_state
from tapeloom.sources.ranges import filesystem

Write = Callable[[DataFrame, int], None]
#: Values that are one entry of the state store, on average; lines of a stream's batch that are given out at a time.
SHELF, SLICE = 128, 1 << 13


def choose(lines: DataFrame, tables: Tables, fallback: str, folder: str, write: Write, delim: str = fix.SOH, stream: str = "file") -> DataStreamWriter:
    """Messages of a stream of lines, parsed and with dict_id: session.choose() with versions carried from batch to batch.

    write gets each batch's messages and number. Start the writer that is returned.
    """

    def run(batch: DataFrame, number: int) -> None:
        schema = f"{stream} string, carried string"
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{folder}/batch={number - 1}") if number else spark.createDataFrame([], schema)
        own = session.choose(messages.parse(messages.extract(batch, delim)), tables, fallback, [stream], carried=before)
        last = own.where("negotiated IS NOT NULL").groupBy(stream).agg(F.max_by("negotiated", F.struct("line_no", "msg_idx")).alias("now"))
        after = before.join(last, stream, "full").select(stream, F.coalesce("now", "carried").alias("carried"))
        after.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        write(own, number)
        if number > 1:
            fs, path = filesystem(f"{folder}/batch={number - 2}")
            if fs.get_file_info(path).type.name == "Directory":
                fs.delete_dir(path)

    return lines.writeStream.foreachBatch(run)


class Shelves:
    """Ranks of values in a map state, many to an entry: a tag with n values has a shelf for each SHELF of them.

    One more shelf splits one that there is (linear hashing), so a batch touches the shelves of its own values and those
    that it splits. How many shelves there are follows from n alone, as of the last batch.
    """

    def __init__(self, state, counts, mentions: int):
        self.counts = Overlay(counts, True)  # a row a tag
        self.before = {tag: n for (tag,), (n,) in self.counts.seen.items()}
        self.state = Overlay(state, sum(map(self.shelves, self.before.values())) <= mentions)
        self.opened: dict[tuple[int, int], dict[str, int]] = {}
        self.new: dict[int, dict[str, int]] = {}

    @staticmethod
    def shelves(n: int) -> int:
        return -(-n // SHELF)

    @staticmethod
    def shelf(value: str, m: int) -> int:
        """The shelf of a value where there are m."""
        top = 1 << (m.bit_length() - 1)
        at = zlib.crc32(value.encode("utf-8", "surrogatepass")) % (2 * top)
        return at if at < m else at - top

    def _open(self, tag: int, shelf: int) -> dict[str, int]:
        if (own := self.opened.get((tag, shelf))) is None:
            own = self.opened[tag, shelf] = dict(zip(*(self.state.get((tag, shelf)) or ((), ())), strict=True))
        return own

    def rank(self, tag: int, value: str) -> int:
        """The value's rank; one that was not seen before has the next of its tag."""
        n = self.before.get(tag, 0)
        if n and (rank := self._open(tag, self.shelf(value, self.shelves(n))).get(value)) is not None:
            return rank
        new = self.new.setdefault(tag, {})
        return new.setdefault(value, n + len(new) + 1)

    def flush(self) -> None:
        for tag, new in self.new.items():
            n = self.before.get(tag, 0)
            was, now = self.shelves(n), self.shelves(n + len(new))
            split = set()
            for at in range(was, now) if was else ():
                while at >= was:  # the shelf that it is split from, or that one's
                    at -= 1 << (at.bit_length() - 1)
                split.add(at)
            put: dict[int, dict[str, int]] = {at: {} for at in split}
            for at in split:
                for value, rank in self._open(tag, at).items():
                    put.setdefault(self.shelf(value, now), {})[value] = rank
            for value, rank in new.items():
                if (at := self.shelf(value, now)) not in put:
                    put[at] = dict(self._open(tag, at)) if at < was else {}
                put[at][value] = rank
            for at, own in put.items():
                self.state.put((tag, at), (list(own), list(own.values())))
            self.counts.put((tag,), (n + len(new),))
        self.state.flush()
        self.counts.flush()


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and its places."""
    at = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[at])) + 1
    for own in np.split(at, cuts) if len(at) else ():
        yield int(keys[own[0]]), own


def ranks(state, counts, told: dict[int, pa.Array]) -> dict[int, np.ndarray]:
    """The ranks of each tag's distinct values, given in the order in which they appear; what is new is stored.

    As Shelves gives them, but a shelf at a time: it is read, its values are looked up, and it is let go. One that gets
    values or is split is read once more.
    """
    before = {tag: n for (tag,), (n,) in counts.iterator()}
    m = {tag: Shelves.shelves(n) for tag, n in before.items()}
    out, asked = {}, {}
    for tag, values in told.items():
        out[tag] = np.zeros(len(values), np.int64)
        asked[tag] = dict(_by(_shelves(values, m[tag]))) if m.get(tag) else {}
    wanted = sum(map(len, asked.values()))
    if sum(m.values()) <= 2 * wanted:
        found = state.iterator()
    else:
        found = (((tag, shelf), state.getValue((tag, shelf))) for tag, own in asked.items() for shelf in own if state.containsKey((tag, shelf)))
    for (tag, shelf), (values, known) in found:
        if tag in asked and (at := asked[tag].get(shelf)) is not None:
            own = dict(zip(values, known, strict=True))
            out[tag][at] = [own.get(x, 0) for x in told[tag].take(pa.array(at)).to_pylist()]
    for tag, values in told.items():
        new = np.flatnonzero(out[tag] == 0)
        if len(new):
            n = before.get(tag, 0)
            out[tag][new] = np.arange(n + 1, n + 1 + len(new))
            _put(state, tag, values.take(pa.array(new)), n)
            counts.updateValue((tag,), (n + len(new),))
    return out


def _shelves(values: pa.Array, m: int) -> np.ndarray:
    out = np.empty(len(values), np.int64)
    for at in range(0, len(values), 1 << 16):
        out[at : at + (1 << 16)] = [Shelves.shelf(x, m) for x in values.slice(at, 1 << 16).to_pylist()]
    return out


def _put(state, tag: int, values: pa.Array, n: int) -> None:
    """Stores values whose ranks follow n, the number of those that there are; a shelf's values stay in it or go to those that are split from it."""
    was, now = Shelves.shelves(n), Shelves.shelves(n + len(values))
    fresh = dict(_by(_shelves(values, was or now)))
    for at in range(was, now) if was else ():
        while at >= was:  # the shelf that it is split from, or that one's
            at -= 1 << (at.bit_length() - 1)
        fresh.setdefault(at, np.empty(0, np.int64))
    for shelf, at in fresh.items():
        old = state.getValue((tag, shelf)) if was and state.containsKey((tag, shelf)) else ((), ())
        own = {*zip(*old, strict=True), *zip(values.take(pa.array(at)).to_pylist(), (at + n + 1).tolist(), strict=True)}
        put: dict[int, tuple[list[str], list[int]]] = {shelf: ([], [])} if was else {}
        for value, rank in sorted(own, key=lambda x: x[1]):
            to = put.setdefault(Shelves.shelf(value, now), ([], []))
            to[0].append(value)
            to[1].append(rank)
        for to, told in put.items():
            state.updateValue((tag, to), told)


class Ranks(StatefulProcessor):
    """The rank of each sensitive value among its tag's values by first appearance, in the state store by tag and shelf.

    Of a batch, texts wait in a temporary file (Ordered); held are places, tags and values, in columns.
    """

    def __init__(self, by: str, order: list[str], text: str):
        self.by, self.order, self.text = by, order, text

    def init(self, handle) -> None:
        self.ranks = handle.getMapState("shelves", "tag int, shelf long", "values array<string>, ranks array<long>")
        self.counts = handle.getMapState("counts", "tag int", "n long")

    def handleInputRows(self, key, rows, timerValues):
        places, sizes, tags, values, kinds = [], [], [], [], dict.fromkeys(self.order)

        def texts() -> Iterator[pa.Table]:
            for part in rows:
                table = pa.table([*(pa.array(part[c], kinds[c], from_pandas=True) for c in self.order), pa.array(part[self.text], pa.string(), from_pandas=True)], [*self.order, self.text])
                kinds.update({c: table.schema.field(c).type for c in self.order})
                own = pa.array(part["values"], pa.list_(pa.string()))
                places.append(table.select(self.order))
                sizes.append(pc.list_value_length(own).to_numpy().astype(np.int32))
                tags.append(pa.array(part["tags"], pa.list_(pa.int32())).flatten().to_numpy())
                values.append(own.flatten())
                yield table

        batch = Ordered(texts(), self.order)
        order, sizes, flat = _order(pa.concat_tables(places), self.order), np.concatenate(sizes), np.concatenate(tags)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        sizes, starts = sizes[order], starts[order]
        begin = np.cumsum(sizes, dtype=np.int64) - sizes
        at = np.repeat(starts - begin, sizes) + np.arange(len(flat))  # of each mention in order, where it came
        coded = pa.chunked_array(values, pa.string()).combine_chunks().dictionary_encode()
        places = tags = values = None
        flat, codes, names = flat[at], coded.indices.to_numpy()[at], coded.dictionary
        told, among = {}, {}
        for tag, own in _by(flat):
            distinct, first, which = np.unique(codes[own], return_index=True, return_inverse=True)
            by_first = np.argsort(first)
            place = np.empty(len(distinct), np.int64)
            place[by_first] = np.arange(len(distinct))
            told[tag], among[tag] = names.take(pa.array(distinct[by_first])), (own, place[which])
        given = np.zeros(len(flat), np.int64)
        for tag, found in ranks(self.ranks, self.counts, told).items():
            own, which = among.pop(tag)
            given[own] = found[which]
        done = 0
        for part in batch.slices(SLICE):
            upto = np.concatenate([[0], np.cumsum(sizes[done : done + len(part)])])
            own = np.split(given[begin[done] : begin[done] + upto[-1]], upto[1:-1])
            yield pd.DataFrame({self.by: key[0], **{c: part[c].to_pandas() for c in (*self.order, self.text)}, "ranks": own})
            done += len(part)
        batch.close()

    def close(self) -> None:
        pass


def _order(places: pa.Table, order: list[str]) -> np.ndarray:
    """The rows' places in order; those of one place as they came."""
    own = places.append_column("_came", pa.array(np.arange(len(places))))
    return pc.sort_indices(own, [(c, "ascending") for c in own.column_names]).to_numpy()


def hide(lines: DataFrame, tables: Tables, write: Write, delim: str = fix.SOH, by: str = "file", line_no: str = "line_no", text: str = "line") -> DataStreamWriter:
    """The lines of a stream with sensitive values hidden: obfuscate.lines() with aliases that stay what they are from batch to batch.

    write gets each batch's lines and number. Start the writer that is returned. The state is kept in RocksDB.
    """
    ship(lines.sparkSession)
    with_map_state(lines.sparkSession)
    found = F.when(F.contains(text, F.lit(fix.BEGIN)), obfuscate.within(text, tables, delim))
    none = F.array().cast("array<int>")
    told = lines.select(by, line_no, text, F.coalesce(F.transform(found, lambda x: x["tag"]), none).alias("tags"), F.coalesce(F.transform(found, lambda x: x["value"]), F.array().cast("array<string>")).alias("values"))
    schema = f"{by} string, {line_no} long, {text} string, ranks array<long>"
    ranked = told.groupBy(by).transformWithStateInPandas(Ranks(by, [line_no], text), schema, "append", "none")

    def run(batch: DataFrame, number: int) -> None:
        alias = lambda x, n: F.concat(x["tag"].cast("string"), F.lit("="), x["prefix"], fix.digits(n, 4))
        new = F.zip_with(obfuscate.within(text, tables, delim), "ranks", lambda x, n: F.struct(x["seq"].alias("seq"), x["at"].alias("at"), alias(x, n).alias("p")))
        write(obfuscate.rewritten(batch.withColumn("new", F.when(F.size("ranks") > 0, new)), delim, [by, line_no], text), number)

    return ranked.writeStream.foreachBatch(run)
