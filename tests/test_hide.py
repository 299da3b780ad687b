"""Hiding: both ways for aliases give the same lines, and the broadcast one moves no text."""

import random

import pytest

from tapeloom.operators import obfuscate
from tapeloom.sources import logs
from tests.test_fix import S, enc, tables  # noqa: F401


def lines(spark):
    rng = random.Random(3)
    out = []
    for i in range(400):
        own = [enc(f"35=D|49=ALMOND|56=P{rng.randrange(40)}|553=u{i}|58=é漢|") for _ in range(rng.choice((0, 1, 1, 2)))]
        broken = f"8=FIX.4.4{S}9=7{S}49=ALMOND{S}10=12{S}"
        out.append(("fg"[i % 2], 0, i, f" note {i} ".join([*own, rng.choice(("", broken, f"10=1{S}49=ALMOND{S}"))])))
    return spark.createDataFrame(out, logs.LINES).repartition(5)


def rows(df):
    return sorted((r.file, r.line_no, r.line) for r in df.collect())


@pytest.mark.parametrize("delim", [S, "|"])
def test_broadcast_and_shuffle_agree(spark, tables, monkeypatch, delim):  # noqa: F811
    own = lines(spark)
    if delim != S:
        from pyspark.sql import functions as F

        own = own.withColumn("line", F.translate("line", S, delim))
    near = rows(obfuscate.lines(own, tables, delim))
    monkeypatch.setattr(obfuscate, "MOST_NAMES", 0)
    monkeypatch.setattr(obfuscate, "HOT", 7)  # ALMOND stands in most lines
    assert rows(obfuscate.lines(own, tables, delim)) == near
    assert sum("ALMOND" in line for *_, line in near) < 300 and any("é漢" in line for *_, line in near)


def test_text_stays_where_it_is_read(spark, tables):  # noqa: F811
    own = lines(spark).drop("file_ordinal")
    plan = obfuscate.lines(own, tables)._jdf.queryExecution().executedPlan().toString()
    before = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == before.count("Exchange") and "Join" not in plan


def test_lengths_and_checksums_are_right(spark, tables):  # noqa: F811
    from pyspark.sql import functions as F

    from tapeloom.functions import fix
    from tapeloom.operators import messages

    found = messages.parse(messages.extract(obfuscate.lines(lines(spark), tables)))
    right = found.select((fix.int_value(fix.last_value("fields", 9)) == fix.expected_length("raw")).alias("a"), (fix.int_value(fix.last_value("fields", 10)) == fix.expected_checksum("raw")).alias("b"))
    n, a, b = right.agg(F.count("*"), F.count_if("a"), F.count_if("b")).first()
    assert n == a == b > 200


class Store(dict):
    """A map state that counts what it is asked."""

    calls = 0

    def _counted(self, value=None):
        self.calls += 1
        return value

    def iterator(self):
        return self._counted(iter(list(self.items())))

    def containsKey(self, key):
        return self._counted(key in self)

    def getValue(self, key):
        return self._counted(self[key])

    def updateValue(self, key, value):
        self._counted(self.__setitem__(key, value))

    def removeKey(self, key):
        self._counted(self.pop(key))


@pytest.mark.parametrize("size", [1, 3, 40, 5000])
def test_ranks_in_shelves_are_those_of_a_plain_map(monkeypatch, size):
    """Whatever the batches; the store is asked for shelves, not for values."""
    from tapeloom.streaming import carried

    monkeypatch.setattr(carried, "SHELF", 4 if size < 5000 else 128)
    rng = random.Random(size)
    told = [(rng.choice((49, 56)), f"é{rng.randrange(400 if size < 5000 else 40_000)}") for _ in range(600 if size < 5000 else 20_000)]
    state, counts, plain = Store(), Store(), {}
    for at in range(0, len(told), size):
        part = told[at : at + size]
        known = carried.Shelves(state, counts, len(part))
        for tag, value in part:
            own = plain.setdefault(tag, {})
            assert known.rank(tag, value) == own.setdefault(value, len(own) + 1)
        known.flush()
    for tag, own in plain.items():
        m = carried.Shelves.shelves(len(own))
        assert {v: r for (t, s), (vs, rs) in state.items() if t == tag for v, r in zip(vs, rs, strict=True)} == own
        assert all(s == carried.Shelves.shelf(v, m) for (t, s), (vs, _) in state.items() if t == tag for v in vs)
    assert size < 5000 or state.calls + counts.calls < 2_000  # of more than ten thousand values


@pytest.mark.parametrize("size", [1, 3, 40, 5000])
def test_ranks_by_a_shelf_at_a_time_are_those_of_a_plain_map(monkeypatch, size):
    """Whatever the batches and the order in which lines come; lines are given out in slices, and shelves are asked for once or twice."""
    import pandas as pd

    from tapeloom.operators import ordered
    from tapeloom.streaming import carried

    for name, value in (("RUN", 50), ("PIECE", 7)) if size < 5000 else ():
        monkeypatch.setattr(ordered, name, value)
    monkeypatch.setattr(carried, "SHELF", 4 if size < 5000 else 128)
    monkeypatch.setattr(carried, "SLICE", 16)
    rng, plain = random.Random(size), {}
    fold = carried.Ranks("file", ["line_no"], "line")
    fold.ranks, fold.counts = Store(), Store()
    n = 300 if size < 5000 else 10_000
    told = [[(rng.choice((49, 56)), f"é{rng.randrange(400 if size < 5000 else 40_000)}") for _ in range(rng.choice((0, 1, 3)))] for _ in range(n)]
    for at in range(0, n, size):
        rows = [(i, f"line {i}", [t for t, _ in told[i]], [v for _, v in told[i]]) for i in range(at, min(at + size, n))]
        want = [(i, line, [plain.setdefault(t, {}).setdefault(v, len(plain[t]) + 1) for t, v in zip(ts, vs, strict=True)]) for i, line, ts, vs in rows]
        rng.shuffle(rows)
        own = pd.DataFrame(rows, columns=["line_no", "line", "tags", "values"])
        out = list(fold.handleInputRows(("f",), iter([own.iloc[:9], own.iloc[9:]] if len(own) > 9 else [own]), None))
        assert [(i, line, list(r)) for part in out for i, line, r in zip(part["line_no"], part["line"], part["ranks"], strict=True)] == want
        assert size < 5000 or max(map(len, out)) == 16
    for tag, own in plain.items():
        m = carried.Shelves.shelves(len(own))
        assert {v: r for (t, s), (vs, rs) in fold.ranks.items() if t == tag for v, r in zip(vs, rs, strict=True)} == own
        assert all(s == carried.Shelves.shelf(v, m) for (t, s), (vs, _) in fold.ranks.items() if t == tag for v in vs)
    assert size < 5000 or fold.ranks.calls < 1_000  # of more than ten thousand values


@pytest.mark.parametrize("names", [1 << 18, 0])
def test_rows_of_many_messages_find_their_aliases_by_place(spark, tables, monkeypatch, names):  # noqa: F811
    """The same text, and no pass over a row's aliases for each of its messages."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(obfuscate, "MOST_NAMES", names)
    own = lines(spark).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("line")).withColumn("line_no", F.lit(0)).cache()
    hidden = obfuscate.lines(own, tables, many=True)
    assert rows(hidden) == rows(obfuscate.lines(own, tables)) != rows(own)
    assert "starts(" in hidden._jdf.queryExecution().optimizedPlan().toString()
