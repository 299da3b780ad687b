"""Order lifecycles: which order each message belongs to, and the order's state after it, in batch or as a stream.

A message belongs to the order that any of its ids (OrderID, ClOrdID, OrigClOrdID, in this order) is known to name, else
to the first of its ids. Each message updates the order and gives a row of its state. An order that ends, or the eldest
beyond a bound of open ones, is forgotten with its ids, so the state is bounded.

In batch the two are apart. Orders are told by ids alone: messages that share ids, directly or by others between them,
are a component, and components of a stream are followed in any number of tasks. That leaves out the bound, which joins
all orders of a stream; so the numbers of open orders are summed up along each stream, and only a stream that exceeds
the bound somewhere is followed again as a whole, its ids alone, in one task that reads them sorted and holds the open
orders. The states are windows over the messages of an order, whatever told it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tapeloom.functions import fix
from tapeloom.operators import linked
from tapeloom.operators.dictionary import Tables
from tapeloom.operators.ordered import Ordered
from tapeloom.operators.overlay import Overlay
from tapeloom.session import cut, scratch, ship, with_map_state

#: Ids in order of precedence, what is kept of a message by tag, statuses that end an order.
ID_TAGS = (37, 11, 41)
KEPT = {"order_id": 37, "cl_ord_id": 11, "orig_cl_ord_id": 41, "exec_type": 150, "ord_status": 39, "side": 54, "symbol": 55, "quantity": 38, "price": 44, "cum_quantity": 14, "leaves_quantity": 151, "last_quantity": 32, "last_price": 31, "text": 58}
DESCRIBED = ("exec_type", "ord_status", "side")
TERMINAL = ("2", "3", "4", "8", "C")
MOST_OPEN = 10_000
IDS = ("order_id", "cl_ord_id", "orig_cl_ord_id")
#: Places of a bucket along which open orders are summed up; messages of a stream's batch that are followed at a time.
BUCKET, SLICE = 1 << 16, 1 << 14
LABELS = {"order": "Order", "message": "Message", "order_id": "OrderID", "cl_ord_id": "ClOrdID", "orig_cl_ord_id": "OrigClOrdID", "exec_type": "ExecType", "ord_status": "OrdStatus", "side": "Side", "symbol": "Symbol", "quantity": "OrderQty", "price": "Price", "cum_quantity": "CumQty", "leaves_quantity": "LeavesQty", "last_quantity": "LastQty", "last_price": "LastPx", "text": "Text", "events": "Events"}
_STATE = ["key", "events", "message", *KEPT, "terminal"]


def terminal(own: Column | str) -> Column:
    """Whether a message ends its order, by status or execution type."""
    return F.coalesce(fix.first_value(own, 39).isin(*TERMINAL), F.lit(False)) | F.coalesce(fix.first_value(own, 150).isin(*TERMINAL), F.lit(False))


def _listed(column: pa.Array) -> list:
    """The column's values, as to_pylist() gives them, in a tenth of its time where they are text, truth values or whole numbers."""
    kind = column.type
    if pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _kept():
    """lookup (the type), the values in KEPT, blank ones null, and terminal, of a batch of messages: each tag's first value."""
    tags = {"lookup": 35, **KEPT}
    field = f"(?s)^0*(?P<tag>{'|'.join(map(str, tags.values()))})=(?P<value>.*)$"

    def kept(raw):
        parts = pc.split_pattern(raw, fix.SOH)
        row = np.repeat(np.arange(len(raw)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
        own = pc.extract_regex(parts.flatten(), field)
        tag, value, out = pc.struct_field(own, 0).dictionary_encode(), pc.struct_field(own, 1), {}
        code, named = pc.fill_null(tag.indices, -1).to_numpy(zero_copy_only=False), tag.dictionary.to_pylist()
        for name, wanted in tags.items():
            first = np.full(len(raw), -1)
            if str(wanted) in named:
                at = np.flatnonzero(code == named.index(str(wanted)))[::-1]
                first[row[at]] = at  # of several, the last that is put is the first of the message
            out[name] = value.take(pa.array(first, mask=first < 0))
        ends = [pc.is_in(out[name], pa.array(TERMINAL, out[name].type)) for name in ("ord_status", "exec_type")]
        for name in KEPT:
            out[name] = pc.if_else(pc.match_substring_regex(out[name], fix.BLANK), None, out[name])
        return pa.StructArray.from_arrays([*out.values(), pc.or_(*ends)], names=[*out, "terminal"])

    kept.__annotations__ = {"raw": pa.Array, "return": pa.Array}
    return F.arrow_udf(kept, f"struct<lookup:string,{','.join(f'{c}:string' for c in KEPT)},terminal:boolean>").asNondeterministic()  # else it is made once for each of its values


def inputs(messages: DataFrame, tables: Tables, stream: list[str], order: list[str]) -> DataFrame:
    """What the fold reads of messages with raw and dict_id: ids as they are, kept values described, blank ones null. The fields are not made for it."""
    ship(messages.sparkSession)
    own = messages.select(*stream, *order, "dict_id", _kept()("raw").alias("_kept")).select(*stream, *order, "dict_id", "_kept.*")
    names = F.broadcast(tables.messages.select("dict_id", "lookup", F.col("name").alias("_name")))
    own = own.join(names, ["dict_id", "lookup"], "left").withColumn("message", F.coalesce(F.concat("_name", F.lit(" ("), "lookup", F.lit(")")), "lookup"))
    for name in DESCRIBED:
        enums = F.broadcast(tables.enums.where(F.col("tag") == KEPT[name]).select("dict_id", F.col("value").alias(name), F.col("description").alias("_d")))
        own = own.join(enums, ["dict_id", name], "left").withColumn(name, F.when(fix.blank("_d"), F.col(name)).otherwise(F.concat(name, F.lit(" ("), "_d", F.lit(")")))).drop("_d")
    return own.select(*stream, *order, "message", *KEPT, "terminal")


class Keys:
    """Which order each message of one stream belongs to."""

    def __init__(self, most_open: int | None = MOST_OPEN):
        self.orders: dict[str, int] = {}  # open ones, eldest first, with the row that opened them
        self.alias: dict[str, str] = {}
        self.ids: dict[str, set[str]] = {}
        self.most_open = most_open

    def forget(self, key: str) -> None:
        del self.orders[key]
        for i in self.ids.pop(key, ()):
            if self.alias.get(i) == key:
                del self.alias[i]

    def accept(self, ids: list[str], ends: bool, row: int) -> tuple[str, int]:
        """(key, row that opened the order) of a message with these ids."""
        key = next((self.alias[i] for i in ids if i in self.alias), ids[0])
        opened = self.orders.setdefault(key, row)
        own = self.ids.setdefault(key, set())
        for i in ids:
            self.alias[i] = key
            own.add(i)
        if ends:
            self.forget(key)
        elif self.most_open is not None and len(self.orders) > self.most_open:
            self.forget(next(iter(self.orders)))
        return key, opened


def _followed(rows: DataFrame, by: list[str], order: list[str], most_open: int | None) -> DataFrame:
    """The rows' columns but ids and terminal, key, opened and delta (how many more orders are open after it), followed apart for each value of by."""
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c not in (*IDS, "terminal", *by)] + by
    sorted_rows = rows.select(*kept, "terminal", *IDS).repartition(*by).sortWithinPartitions(*by, *order, "row")
    own = [kept.index(c) for c in by]
    row_at = kept.index("row")

    def run(batches: Iterator[pa.RecordBatch]):
        now, keys = None, Keys(most_open)
        for batch in batches:
            groups = zip(*(_listed(batch.column(i)) for i in own), strict=True)
            rows, ends, *ids = (_listed(batch.column(i)) for i in (row_at, *range(len(kept), len(kept) + 4)))
            told, opened = [], []
            for group, row, end, *named in zip(groups, rows, ends, *ids, strict=True):
                if group != now:
                    now, keys = group, Keys(most_open)
                key, first = keys.accept([i for i in named if i is not None], end, row)
                told.append(key)
                opened.append(first)
            delta = [(first == row) - end for first, row, end in zip(opened, rows, ends, strict=True)]
            more = [pa.array(told, pa.string()), pa.array(opened, pa.int64()), pa.array(delta, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *more], names=[*kept, "key", "opened", "delta"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_rows.schema[: len(kept)])
    return sorted_rows.mapInArrow(run, f"{head}, key string, opened long, delta int")


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def exceeding(told: DataFrame, stream: list[str], order: list[str], most_open: int) -> DataFrame:
    """The streams in which more orders are open at once than the bound; told: stream, order and delta of messages.

    Sums run within buckets of places and then over buckets, so no task holds a stream.
    """
    large = cut(told.groupBy(*stream).agg(F.sum((F.col("delta") > 0).cast("long")).alias("n")).where(F.col("n") > most_open).drop("n"))
    if large.isEmpty():  # not as many were ever opened
        return large
    own = told.where("delta <> 0").alias("t").join(large.alias("l"), _same("t", "l", stream), "left_semi").withColumn("bucket", F.floor(F.col(order[0]).cast("double") / BUCKET).cast("long"))
    upto = F.sum("delta").over(Window.partitionBy(*stream, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = own.withColumn("upto", upto).groupBy(*stream, "bucket").agg(F.max("upto").alias("most"), F.sum("delta").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*stream).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut(sums.withColumn("before", before).where(F.col("before") + F.col("most") > most_open).select(*stream).distinct())


def assign(rows: DataFrame, stream: list[str], order: list[str], most_open: int = MOST_OPEN) -> DataFrame:
    """row, key and opened (the row of its order's first message) of rows with ids; rows: row, stream, order, the three ids, terminal."""
    nodes = [F.when(F.col(c).isNotNull(), F.xxhash64(*stream, c)) for c in IDS]
    several = reduce(add, (F.col(c).isNotNull().cast("int") for c in IDS)) > 1
    roots = linked.components(rows.where(several).select(*(n.alias(f"node_{c}") for n, c in zip(nodes, IDS, strict=True))))
    own = rows.withColumn("node", F.coalesce(*nodes)).join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("node", "root")
    told = cut(_followed(own, ["part", *stream], order, None).drop("part"))  # sorted by a number first
    over = exceeding(told, stream, order, most_open)
    told = told.select("row", *stream, "key", "opened")
    if over.isEmpty():
        return told.drop(*stream)
    again = cut(_followed(rows.alias("r").join(over.alias("o"), _same("r", "o", stream), "left_semi"), stream, order, most_open))
    return told.alias("t").join(over.alias("o"), _same("t", "o", stream), "left_anti").drop(*stream).unionByName(again.select("row", "key", "opened"))


def summaries(messages: DataFrame, tables: Tables, stream: list[str] = ("file",), order: list[str] = ("line_no", "msg_idx"), most_open: int = MOST_OPEN) -> DataFrame:
    """A row for each message with an order id: the stream's and order's columns, key, events, message, the latest values, terminal.

    What is kept of messages is written once to the shared folder, from which ids and states are read apart.
    """
    stream, order, spark = list(stream), list(order), messages.sparkSession
    path = scratch(spark, "orders")
    clear = {c: f"_{i}" for i, c in enumerate([*stream, *order])}
    kept = inputs(messages, tables, stream, order).select(F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(n) for c, n in clear.items()), "message", *KEPT, "terminal")
    kept.where(F.coalesce(*IDS).isNotNull()).write.parquet(path)  # after the rows' numbers: before them, messages are parsed once more for each id
    rows = spark.read.parquet(path)
    s, o = [clear[c] for c in stream], [clear[c] for c in order]
    told = assign(rows.select("row", *s, *o, *IDS, "terminal"), s, o, most_open)
    so_far = Window.partitionBy("opened").orderBy(*o, "row").rowsBetween(Window.unboundedPreceding, 0)
    latest = {c: F.last(c, ignorenulls=True).over(so_far).alias(c) for c in KEPT}
    states = rows.join(told, "row").select(*(F.col(n).alias(c) for c, n in clear.items()), "key", F.count("*").over(so_far).alias("events"), "message", *latest.values(), "terminal")
    return states


def lines(states: DataFrame) -> DataFrame:
    """rendered: the text block of each state; values that are null or blank have no line."""
    shown = states.withColumn("order", F.coalesce("order_id", "cl_ord_id", "key"))
    parts = [F.when(~fix.blank(F.col(c).cast("string")), F.concat(F.lit(f"    {label}: "), F.col(c).cast("string"))) for c, label in LABELS.items()]
    return shown.withColumn("rendered", F.concat_ws("\n", F.lit("Order Summary:"), *parts, F.lit("")))


class StreamFold(StatefulProcessor):
    """The open orders of a stream in the state store: each order under its key, the key of each id, orders by age.

    A batch reads and writes the orders, ids and ages that its own messages touch, and no others, one by one; or, where it
    has as many messages as orders are open, all that are open at once. What opens and ends within it is never stored, nor
    held on to. Its messages are put in order by runs in a temporary file and followed in slices, so memory follows the
    open orders, not the batch.
    """

    def __init__(self, stream: str, order: list[str], most_open: int):
        self.stream, self.order, self.most_open = stream, order, most_open

    def init(self, handle) -> None:
        self.open = handle.getMapState("orders", "key string", "age long, events long, ids array<string>, kept array<string>")
        self.alias = handle.getMapState("alias", "id string", "key string")
        self.ages = handle.getMapState("ages", "age long", "key string")
        self.counts = handle.getValueState("counts", "eldest long, next long, open long")

    def _tables(self, rows: Iterator[pd.DataFrame]) -> Iterator[pa.Table]:
        """The rows as Arrow columns, without the stream."""
        kinds = {**dict.fromkeys(self.order), **dict.fromkeys(("message", *KEPT), pa.string()), "terminal": pa.bool_()}
        for part in rows:
            table = pa.table([pa.array(part[c], kind, from_pandas=True) for c, kind in kinds.items()], list(kinds))
            kinds |= {c: table.schema.field(c).type for c in self.order}  # those of the first rows
            yield table

    def handleInputRows(self, key, rows, timerValues):
        batch = Ordered(self._tables(rows), self.order)
        eldest, following, n = self.counts.get() if self.counts.exists() else (0, 0, 0)
        opened, alias, ages = (Overlay(state, n <= len(batch)) for state in (self.open, self.alias, self.ages))

        def forget(name: str) -> None:
            nonlocal n
            age, _, ids, _ = opened.get((name,))
            for i in ids:
                if (own := alias.get((i,))) and own[0] == name:
                    alias.put((i,), None)
            opened.put((name,), None)
            ages.put((age,), None)
            n -= 1

        for part in batch.slices(SLICE):
            given = [(i, part[c].to_pylist()) for i, c in enumerate(KEPT) if part[c].null_count < len(part)]
            out = []
            for i, (message, ends, *named) in enumerate(zip(*(part[c].to_pylist() for c in ("message", "terminal", *IDS)), strict=True)):
                ids = [x for x in named if x is not None]
                if not ids:
                    continue
                name = next((own[0] for x in ids if (own := alias.get((x,)))), ids[0])
                if (state := opened.get((name,))) is None:
                    state = (following, 0, (), (None,) * len(KEPT))
                    ages.put((following,), (name,))
                    following, n = following + 1, n + 1
                age, events, known, kept = state
                kept = list(kept)
                for c, values in given:
                    if values[i] is not None:
                        kept[c] = values[i]
                opened.put((name,), (age, events + 1, [*known, *(x for x in dict.fromkeys(ids) if x not in known)], kept))
                for x in ids:
                    alias.put((x,), (name,))
                out.append((name, events + 1, message, *kept, ends))
                if ends:
                    forget(name)
                elif n > self.most_open:
                    while ages.get((eldest,)) is None:
                        eldest += 1
                    forget(ages.get((eldest,))[0])
            if out:
                yield pd.DataFrame({self.stream: key[0], **dict(zip(_STATE, map(list, zip(*out, strict=True)), strict=True))}, copy=False)
        batch.close()
        for own in (opened, alias, ages):
            own.flush()
        self.counts.update((eldest, following, n))

    def close(self) -> None:
        pass


def stream_summaries(messages: DataFrame, tables: Tables, stream: str = "file", order: list[str] = ("line_no", "msg_idx"), most_open: int = MOST_OPEN) -> DataFrame:
    """summaries() of a streaming frame of messages, in append mode; the open orders of a stream are its state.

    The state is kept in RocksDB, for which the session's provider of state stores is set.
    """
    spark = messages.sparkSession
    with_map_state(spark)
    rows = inputs(messages, tables, [stream], list(order))
    ship(spark)
    schema = f"{stream} string, key string, events long, message string, {', '.join(f'{k} string' for k in KEPT)}, terminal boolean"
    return rows.groupBy(stream).transformWithStateInPandas(StreamFold(stream, list(order), most_open), schema, "append", "none")
