"""Following files: what is given out does not depend on where reads end, who reads, or whether marks are lost."""

import random
import shutil

import pytest

from tapeloom.streaming import tail
from tests.test_fix import enc

S = "\x01"
A, B = enc("35=0|49=ALMOND|34=1|"), enc("35=D|11=é漢|58=x|")


def drain(reader, at, rounds=1000):
    """All rows until nothing is new, and the offset; each part is read twice, as after a lost executor."""
    rows = []
    for _ in range(rounds):
        end = reader.latestOffset()
        parts = reader.partitions(at, end)
        if not parts:
            break
        for part in parts:
            own = [tuple(r.values()) for b in reader.read(part) for r in b.to_pylist()]
            assert own == [tuple(r.values()) for b in reader.read(part) for r in b.to_pylist()]
            rows += own
        reader.commit(end)
        at = end
    return rows, at


def grown(path, pieces, make, **more):
    """The rows as a file grows by pieces, each followed by as many batches as it takes."""
    path.write_bytes(b"")
    reader, at, rows = make(**more), {}, []
    for piece in pieces:
        with path.open("ab") as f:
            f.write(piece)
        own, at = drain(reader, at)
        rows += own
    return [r[2:] for r in rows], reader, at


@pytest.fixture
def make(tmp_path):
    count = iter(range(10_000))
    return lambda most=tail.MOST, pending=tail.PENDING, **more: tail.TailReader(str(tmp_path / "*.log"), most, pending, str(tmp_path / f"marks{next(count)}"), **more)


@pytest.mark.parametrize("most", [1, 2, 3, 7, 100])
def test_lines_longer_than_a_read(tmp_path, make, most):
    path = tmp_path / "a.log"
    data = b"short\n" + b"x" * 50 + b"\r\n" + b"y" * 23 + b"\rlast\nopen"
    rows, reader, at = grown(path, [data], make, most=most)
    assert rows == list(enumerate(["short", "x" * 50, "y" * 23, "last"], 1))
    with path.open("ab") as f:
        f.write(b" line" * 30 + b"\n")
    assert [r[2:] for r in drain(reader, at)[0]] == [(5, "open" + " line" * 30)]


def test_a_line_without_end_waits_within_a_bound(tmp_path, make):
    """What exceeds the bound is given out under the line's number, cut at the last message start, and never within a character."""
    steps = ["one\n" + "z" * 150, "é" * 60, "w" * 120 + "8=FIX.4.4" + "q" * 100, "r" * 20 + "\nlast\n", "é" * 300]
    got, _, _ = grown(tmp_path / "a.log", [x.encode() for x in steps], make, pending=200)
    assert got[0] == (1, "one") and "".join(x for n, x in got if n == 2) == "z" * 150 + "é" * 60 + "w" * 120 + "8=FIX.4.4" + "q" * 100 + "r" * 20
    assert [x for n, x in got if n == 2 and "8=FIX" in x] == ["8=FIX.4.4" + "q" * 100 + "r" * 20] and (3, "last") in got
    open_line = "".join(x for n, x in got if n == 4)
    assert open_line and set(open_line) == {"é"} and 300 - len(open_line) <= 100


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r", ""])
def test_cuts_at_every_byte_give_each_message_once(tmp_path, make, ends):
    text = f"log {A}{ends} noise 8=FIX.4.4{S}9=5{S}open {B}{A}{ends}8=FI {ends}8=FIX{S}10=123{S} é{ends}"
    data = text.encode()
    pieces = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    want = [(n, i, raw) for n, line in enumerate(pieces, 1) for i, raw in enumerate(tail.found(line, 1 << 20)[0])]
    assert [raw for *_, raw in want] == [A, B, A, f"8=FIX{S}10=123{S}"]
    for cut in range(len(data)):
        assert grown(tmp_path / "a.log", [data[:cut], data[cut:]], make, give_messages=True)[0] == want, cut
    assert grown(tmp_path / "a.log", [bytes([x]) for x in data], make, give_messages=True)[0] == want


@pytest.mark.parametrize("give_messages", [False, True])
def test_random_files_do_not_depend_on_reads(tmp_path, make, give_messages):
    rng = random.Random(31)
    bits = [A, B, "8=FIX", f"{S}10=123{S}", "\n", "\r", "\r\n", " ", "8=FI", "é", "漢" * 9, "y" * 25, S, f"8=FIX.4.4{S}"]
    for _ in range(60):
        data = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))).encode()
        pending = rng.choice((12, 40, 90, 1 << 20))
        whole = grown(tmp_path / "a.log", [data], make, pending=pending, give_messages=give_messages)[0]
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(6))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert grown(tmp_path / "a.log", parts, make, pending=pending, give_messages=give_messages)[0] == whole
        assert grown(tmp_path / "a.log", [data], make, most=rng.randrange(1, 9), pending=pending, give_messages=give_messages)[0] == whole


def test_lost_marks_are_made_anew(tmp_path, make):
    path = tmp_path / "a.log"
    rows, reader, at = grown(path, [b"one\ntwo\nthr", b"ee\nfour\n"], make)
    shutil.rmtree(reader.marks)
    with path.open("ab") as f:
        f.write(b"five\n")
    assert [r[2:] for r in drain(reader, at)[0]] == [(5, "five")]
    anew = tail.TailReader(str(tmp_path / "*.log"), 3, tail.PENDING, reader.marks)
    with path.open("ab") as f:
        f.write(b"six\nseven\n")
    assert [r[2:] for r in drain(anew, reader.latestOffset() and at)[0]][-2:] == [(6, "six"), (7, "seven")]


def test_a_file_that_shrinks_starts_again_and_others_go_on(tmp_path, make):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_text("1\n2\n3\n")
    b.write_text("x\n")
    reader = make()
    rows, at = drain(reader, {})
    a.write_text("9\n")
    with b.open("a") as f:
        f.write("y\n")
    more, _ = drain(reader, at)
    assert [(r[0].rpartition("/")[2], *r[1:]) for r in more] == [("a.log", 0, 1, "9"), ("b.log", 1, 2, "y")]


def test_bytes_that_are_not_text(tmp_path, make):
    (tmp_path / "a.log").write_bytes(b"\xff\n")
    with pytest.raises(ValueError, match="not UTF-8"):
        drain(make(), {})
    assert [r[3] for r in drain(make(bad="replace"), {})[0]] == ["�"]


def test_the_driver_opens_no_followed_file(tmp_path, make, monkeypatch):
    (tmp_path / "a.log").write_text("a\n" * 1000)
    reader = make(most=100)
    real = tail.filesystem

    class Listing:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            assert name != "open_input_file"
            return getattr(self.own, name)

    monkeypatch.setattr(tail, "filesystem", lambda uri: (Listing(real(uri)[0]), real(uri)[1]))
    end = reader.latestOffset()
    assert [(p.at, p.upto) for p in reader.partitions({}, end)] == [(0, 100)]


@pytest.mark.parametrize("give_messages", [False, True])
def test_a_long_file_takes_few_batches_in_pieces_that_fit(tmp_path, make, monkeypatch, give_messages):
    """Batches grow with what was read; a task still reads no more than maxBytes and what waits at a time."""
    (tmp_path / "a.log").write_text(f"x {A}{B}\n" * 1000)
    reader, reads = make(most=200, pending=400, give_messages=give_messages), []
    real = reader._given
    monkeypatch.setattr(reader, "_given", lambda data, mark, base: reads.append(len(data)) or real(data, mark, base))
    at, batches, rows = {}, 0, []
    while parts := reader.partitions(at, end := reader.latestOffset()):
        rows += [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        reader.commit(end)
        at, batches = end, batches + 1
    assert [r[2:] for r in rows] == [r for n in range(1, 1001) for r in ([(n, 0, A), (n, 1, B)] if give_messages else [(n, f"x {A}{B}")])]
    assert batches < 15 and max(reads) <= 200 + 400
