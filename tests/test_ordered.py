"""A batch of a stream in order: by runs in a temporary file, so that what is held does not follow the batch."""

import random

import pandas as pd
import pyarrow as pa
import pytest

from tapeloom.operators import ordered, orders
from tests.test_hide import Store


@pytest.mark.parametrize(("run", "piece", "n"), [(7, 2, 200), (7, 100, 200), (1000, 2, 200), (50, 50, 100), (5, 2, 0)])
def test_rows_in_order_whatever_the_runs(monkeypatch, run, piece, n):
    monkeypatch.setattr(ordered, "RUN", run)
    monkeypatch.setattr(ordered, "PIECE", piece)
    rng = random.Random(run)
    rows = [(rng.randrange(30), rng.choice("abé"), i, None if i % 5 else f"t{i}") for i in range(n)]
    parts = [rows[at : at + 13] for at in range(0, n, 13)]
    own = ordered.Ordered((pa.table({"a": [r[0] for r in p], "b": [r[1] for r in p], "i": [r[2] for r in p], "t": pa.array([r[3] for r in p], pa.string())}) for p in parts), ["a", "b"])
    assert len(own) == n and (own.file is None) == (n < run)
    got = [tuple(r.values()) for part in own.slices(11) for r in part.to_pylist()]
    own.close()
    assert got == sorted(rows, key=lambda r: r[:2])  # of one place, as they came


def test_orders_that_open_and_end_in_a_batch_are_not_held(monkeypatch):
    held = []

    class Seen(orders.Overlay):
        def put(self, key, value):
            super().put(key, value)
            held.append(max(len(self.seen), len(self.changed)))

    monkeypatch.setattr(orders, "Overlay", Seen)
    monkeypatch.setattr(orders, "SLICE", 50)
    fold = orders.StreamFold("file", ["line_no"], most_open=20)
    fold.open, fold.alias, fold.ages = Store(), Store(), Store()
    fold.counts = type("Counts", (), {"exists": lambda s: False, "update": lambda s, now: None})()
    own = pd.DataFrame({"line_no": range(2000)}).assign(**dict.fromkeys(("message", *orders.KEPT)), terminal=[i % 2 == 1 for i in range(2000)])
    own["cl_ord_id"] = [f"C{i // 2}" if i % 10 else f"D{i}" for i in range(2000)]
    out = list(fold.handleInputRows(("f",), iter([own.iloc[1000:], own.iloc[:1000]]), None))
    assert [x for part in out for x in part["key"]] == own["cl_ord_id"].tolist() and max(map(len, out)) <= 50
    assert max(held) <= 22
