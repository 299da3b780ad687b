"""Order lifecycles: the parallel way against a plain fold over each stream, and components of what rows name together."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import linked, orders
from tests.test_fix import enc, tables  # noqa: F401

FIX44_ID = "FIX44@built-in"

HEAD = ("file", "line_no", "msg_idx")


def plain(rows, most_open):
    """The fold of one message after another, with no structure but dictionaries; rows: (file, line_no, {tag: value})."""
    out, streams = [], defaultdict(lambda: ({}, {}))
    for file, line_no, m in sorted(rows, key=lambda r: (r[0], r[1])):
        states, alias = streams[file]
        ids = [m[t] for t in (37, 11, 41) if m.get(t)]
        if not ids:
            continue
        key = next((alias[i] for i in ids if i in alias), ids[0])
        state = states.setdefault(key, {"events": 0})
        state["events"] += 1
        state.update({t: v for t, v in m.items() if v})
        alias.update(dict.fromkeys(ids, key))
        ends = m.get(39) in orders.TERMINAL or m.get(150) in orders.TERMINAL
        out.append((file, line_no, key, state["events"], *(state.get(t) for t in (37, 11, 41, 55, 32)), ends))
        gone = key if ends else next(iter(states)) if len(states) > most_open else None
        if gone is not None:
            del states[gone]
            for i in [i for i, k in alias.items() if k == gone]:
                del alias[i]
    return out


def drawn(rng, n, ids, files=2, ending=0.1):
    """Random messages: ids drawn from near the place in the stream, so that they are shared, replaced and used again."""
    rows = []
    for line_no in range(1, n + 1):
        m = {35: rng.choice("D8GF")}
        for tag in rng.sample((37, 11, 41), rng.choice((0, 1, 1, 2, 2, 3))):
            m[tag] = f"{'X' if rng.random() < 0.8 else tag}{(line_no // 4 + rng.randrange(ids)) % (3 * ids)}"
        if rng.random() < ending:
            m[39] = rng.choice(orders.TERMINAL)
        if rng.random() < 0.5:
            m[55] = rng.choice("IJK")
        if rng.random() < 0.5:
            m[32] = str(rng.randrange(9))
        rows.append((f"f{rng.randrange(files)}", line_no, m))
    return rows


def run(spark, tables, rows, most_open):  # noqa: F811
    lines = [(f, 0, n, enc("".join(f"{t}={v}|" for t, v in m.items()))) for f, n, m in rows]
    frame = spark.createDataFrame(lines, "file string, file_ordinal int, line_no long, line string").repartition(3)
    from tapeloom.operators import messages

    own = messages.parse(messages.extract(frame)).withColumn("dict_id", F.lit(FIX44_ID))
    got = orders.summaries(own, tables, most_open=most_open)
    return sorted((r.file, r.line_no, r.key, r.events, r.order_id, r.cl_ord_id, r.orig_cl_ord_id, r.symbol, r.last_quantity, r.terminal) for r in got.collect())


@pytest.mark.parametrize(("seed", "ids", "most_open", "ending"), [(1, 5, 10_000, 0.1), (2, 40, 10_000, 0.05), (3, 40, 6, 0.05), (4, 300, 20, 0.02), (5, 3, 1, 0.3), (6, 60, 25, 0.0)])
def test_parallel_way_equals_the_fold(spark, tables, seed, ids, most_open, ending):  # noqa: F811
    rows = drawn(random.Random(seed), 500, ids, ending=ending)
    assert run(spark, tables, rows, most_open) == plain(rows, most_open)


def test_only_streams_beyond_the_bound_are_followed_whole(spark, monkeypatch):
    monkeypatch.setattr(orders, "BUCKET", 7)
    rng, rows = random.Random(9), []
    for file, ends in (("a", True), ("b", False), (None, True), ("c", True)):
        for n in range(60):
            rows.append((file, n, 1))
            if ends:
                rows.append((file, n + (0 if file != "c" else 30), -1))
    rng.shuffle(rows)
    told = spark.createDataFrame(rows, "s string, at long, delta int").groupBy("s", "at").agg(F.sum("delta").cast("int").alias("delta"))
    assert {r.s for r in orders.exceeding(told, ["s"], ["at"], 25).collect()} == {"b", "c"}
    assert {r.s for r in orders.exceeding(told, ["s"], ["at"], 30).collect()} == {"b"}
    assert orders.exceeding(told, ["s"], ["at"], 60).isEmpty()


def test_messages_without_ids_and_repeated_places(spark, tables):  # noqa: F811
    assert run(spark, tables, [("f", 1, {35: "0"})], 5) == []
    rows = [("f", 7, {35: "D", 11: "A"}), ("f", 7, {35: "D", 11: "B"}), ("f", 7, {35: "D", 11: "A"})]
    assert sorted(r[2:4] for r in run(spark, tables, rows, 5)) == [("A", 1), ("A", 2), ("B", 1)]


@pytest.mark.parametrize(("most", "hub"), [(3, 20), (50, 1 << 14), (1 << 18, 1 << 14)])
def test_components(spark, monkeypatch, most, hub):
    monkeypatch.setattr(linked, "HUB", hub)
    rng = random.Random(21)
    rows = [tuple(rng.choice((None, rng.randrange(-150, 150))) for _ in range(3)) for _ in range(120)]
    rows += [(1000, 1001 + i, None) for i in range(300)] + [(2000 + i, 2001 + i, 2002 + i) for i in range(40)]  # a hub and a chain
    own = {}
    for row in rows:
        row = [x for x in row if x is not None]
        whole = set(row).union(*(own[x] for x in row if x in own))
        own.update(dict.fromkeys(whole, whole))
    want = {x: min(c) for x, c in own.items() if min(c) != x}
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    assert {r.node: r.root for r in linked.components(df, most).collect()} == want
    assert linked.components(spark.createDataFrame([], "a long, b long"), most).isEmpty()


def test_stream_state_over_batches_and_a_restart(spark, tables, tmp_path):  # noqa: F811
    """Random streams in batches of lines, with eviction, stopped in the middle and started again from the checkpoint."""
    from tapeloom.operators import messages

    rows, source, out = drawn(random.Random(41), 240, 40, ending=0.05), tmp_path / "in", str(tmp_path / "out")
    schema = "file string, file_ordinal int, line_no long, line string"

    def put(part):
        lines = [(f, 0, n, enc("".join(f"{t}={v}|" for t, v in m.items()))) for f, n, m in part]
        spark.createDataFrame(lines, schema).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        own = messages.parse(messages.extract(lines)).withColumn("dict_id", F.lit(FIX44_ID))
        told = orders.stream_summaries(own, tables, most_open=6)
        job = told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        job.awaitTermination()
        return job.recentProgress

    put(rows[:100])
    run()
    put(rows[100:170])
    progress = run()
    put(rows[170:])
    run()
    got = sorted((r.file, r.key, r.events, r.order_id or "", r.symbol or "", r.last_quantity or "", r.terminal) for r in spark.read.parquet(out).collect())
    want = sorted((f, key, n, a or "", s or "", q or "", ends) for f, _, key, n, a, _, _, s, q, ends in plain(rows, 6))
    assert got == want
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 2 * (6 * 5 + 3) + 40  # what is open in two streams, not what was


class Store:
    """A map state that counts what it is asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def __getattr__(self, name):
        self.asked += 1
        return {"getValue": self.held.__getitem__, "containsKey": self.held.__contains__, "updateValue": self.held.__setitem__, "removeKey": self.held.__delitem__, "iterator": lambda: iter(list(self.held.items()))}[name]


def test_what_a_batch_asks_of_the_state_follows_open_orders_not_its_messages():
    import pandas as pd

    told = {}
    for n in (300, 3000):
        fold = orders.StreamFold("file", ["line_no"], most_open=20)
        stores = fold.open, fold.alias, fold.ages = [Store() for _ in range(3)]
        fold.counts = type("Counts", (), {"now": None, "exists": lambda s: s.now is not None, "get": lambda s: s.now, "update": lambda s, now: setattr(s, "now", now)})()
        out = []
        for first in (0, n, 2 * n):
            own = pd.DataFrame({"line_no": range(first, first + n)})
            for c in ("message", *orders.KEPT):
                own[c] = None
            own["cl_ord_id"], own["terminal"] = [f"C{i - i % 7}" for i in own["line_no"]], False
            out += fold.handleInputRows(("f",), iter([own.iloc[n // 2 :], own.iloc[: n // 2]]), None)
        keys = pd.concat(out)
        assert keys["key"].tolist() == [f"C{i - i % 7}" for i in range(3 * n)] and keys["events"].tolist() == [i % 7 + 1 for i in range(3 * n)]
        assert [len(s.held) for s in stores] == [20, 20, 20]
        told[n] = sum(s.asked for s in stores)
    assert told[3000] == told[300] == 3 * 60 + 2 * 60 + 9  # written, removed, read at once


def test_what_is_kept_is_the_first_value_of_each_tag_by_one_pass_over_the_text(spark, tables):  # noqa: F811
    """Held against the fields one by one; the fields themselves, lambdas over arrays, are not in the plan."""
    from tapeloom.functions import fix
    from tapeloom.operators import messages

    texts = ["35=D|11=a=b|11=c|0037=x|55= |58=é漢\n2|39=2|", "35=8|37=|41=\u2007|55=\u3000\u2028|150=4|39=1|", "35=8|137=no|+11=no|x37=no|99999999999=no|11=\n|38= 5|", "11=only|", "35=D||37|=|54=1|39=C|"]
    lines = spark.createDataFrame([("f", 0, i, enc(t)) for i, t in enumerate(texts)], "file string, file_ordinal int, line_no long, line string")
    own = messages.parse(messages.extract(lines)).withColumn("dict_id", F.lit(FIX44_ID))
    got = orders.inputs(own, tables, ["file"], ["line_no", "msg_idx"])
    plain_kept = [c for c in orders.KEPT if c not in orders.DESCRIBED]
    want = own.select("line_no", *(fix.blank_to_null(fix.first_value("fields", orders.KEPT[c])).alias(c) for c in plain_kept), orders.terminal("fields").alias("terminal"))
    assert got.count() == len(texts)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 0


def test_components_need_no_python_object_a_node():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    up = {int(x): int(x) for x in [*u, *v]}
    for _ in range(300):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            up[a] = up[b] = min(up[a], up[b])
    nodes, roots = linked.united(u, v)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == up
    batch = pa.record_batch({"a": [1, None, None, 7], "b": [None, 5, None, 8], "c": [2, None, None, 9]})
    pairs = [x.tolist() for x in linked._pairs(batch)]
    assert sorted(zip(*pairs, strict=True)) == [(1, 1), (1, 2), (5, 5), (7, 7), (7, 8), (8, 9)]
