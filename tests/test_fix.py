"""Operators over FIX text: known examples, models in plain Python, and every query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.functions import fix
from tapeloom.operators import counts, decode, dictionary, explore, messages, obfuscate, orders, session, validate
from tapeloom.plans import fix_queries
from tapeloom.sources import arguments, logs
from tapeloom.streaming import carried, tail

SF = "/root/testdata/sf0.001"
S = "\x01"


def enc(body: str, begin: str = "FIX.4.4") -> str:
    body = body.replace("|", S)
    head = f"8={begin}{S}9={len(body)}{S}{body}"
    return head + f"10={sum(map(ord, head)) % 256:03d}{S}"


HEARTBEAT = enc("35=0|49=ALMOND|56=PECAN|34=417|52=20230619-14:07:33|")


@pytest.fixture(scope="module")
def tables(spark):
    return dictionary.tables(spark, fix_queries.registry())


@pytest.fixture(scope="module")
def fix44():
    return fix_queries.registry().resolve().dict_id


def parsed(spark, lines):
    return messages.parse(messages.extract(logs.from_lines(spark, lines)))


def told(spark, tables, fix44, *lines):
    own = session.choose(parsed(spark, lines), tables, fix44)
    rows = validate.errors(own, tables).orderBy("line_no", "msg_idx", "phase", "place").collect()
    return [(r.tag, r.error) for r in rows]


# --- extraction ------------------------------------------------------------------------------------------------------------


def model(line: str) -> tuple[list[str], str]:
    """Messages and tail by scanning: a start after white space or SOH gives up an open message."""
    found, open_at, i = [], None, 0
    first = line.find("8=FIX")
    while first >= 0:
        open_at, i = first, first + 5
        while True:
            if i >= len(line):
                return found, line[open_at:]
            if line.startswith("8=FIX", i) and (line[i - 1].isspace() or line[i - 1] == S):
                open_at, i = i, i + 5
                continue
            if line.startswith(S + "10=", i) and line[i + 4 : i + 7].isascii() and line[i + 4 : i + 7].isdigit() and len(line[i + 4 : i + 7]) == 3 and line[i + 7 : i + 8] == S:
                found.append(line[open_at : i + 8])
                first = line.find("8=FIX", i + 8)
                break
            i += 1
    return found, ""


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.lists(st.sampled_from(["8=FIX", "8=FIX.4.4" + S, S + "10=123" + S, "10=12" + S, " ", "x", S, "35=0" + S, "8=FI", "10=1234" + S]), max_size=14).map("".join), min_size=40, max_size=120))
def test_extraction_against_a_model(spark, lines):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", fix.messages("line").alias("m"), fix.tail("line").alias("t")).collect()
    for r in rows:
        assert (r.m, r.t) == model(lines[r.i]), repr(lines[r.i])


def test_extraction_examples(spark):
    got = lambda line, d=S: [r.raw for r in messages.extract(logs.from_lines(spark, [line]), d).orderBy("msg_idx").collect()]
    one = f"8=FIX.4.4{S}9=005{S}35=0{S}10=000{S}"
    assert got(f"INFO {one} tail") == [one]
    assert got(f"INFO {one} tail".replace(S, "|"), "|") == [one]
    assert got(one[:-8]) == []
    assert got(f"8=FIX.4.4{S}9=61{S} {HEARTBEAT}") == [HEARTBEAT]
    assert [fix.delimiter(x) for x in (None, "", "soh", r"\x7C", "|x")] == [S, S, S, "|", "|"]


def test_parsing_round_trip(spark):
    fields = [(35, "0"), (58, "a=b"), (60, "")]
    own = spark.createDataFrame([(fields,)], f"f {fix.FIELD}").select(fix.encode("FIX.4.4", fix.body_of("f")).alias("raw"))
    back = own.select(fix.fields("raw").alias("f")).first().f
    assert [(x.tag, x.value) for x in back][2:-1] == fields
    assert own.select(fix.expected_checksum("raw") == fix.int_value(fix.last_value(fix.fields("raw"), 10))).first()[0]


# --- validation ------------------------------------------------------------------------------------------------------------


def test_valid_message_has_no_errors(spark, tables, fix44):
    assert told(spark, tables, fix44, HEARTBEAT) == []


def test_missing_and_wrong(spark, tables, fix44):
    assert told(spark, tables, fix44, f"8=FIX.4.4{S}9=31{S}10=217{S}") == [(35, "Missing required tag 35 (MsgType)"), (9, "BodyLength mismatch: got 31, expected 0"), (10, "Checksum mismatch: got 217, expected 252")]
    assert {t for t, _ in told(spark, tables, fix44, f"8=FIX.4.4{S}9=31{S}35=1{S}10=217{S}")} >= {10, 34, 52}
    late = "19991231-25h"
    assert (52, f"Invalid UTCTIMESTAMP value {late} for tag 52") in told(spark, tables, fix44, enc(f"35=0|49=KIWI|56=PLUM|34=88|52={late}|"))
    assert told(spark, tables, fix44, enc("35=qq|49=KIWI|56=PLUM|34=88|52=20230619-14:07:33|")) == [(35, "Invalid enum value qq for tag 35"), (35, "Unknown MsgType: qq")]


def test_repeats_in_groups_are_allowed(spark, tables, fix44):
    party = "448={}|447=D|452=1|"
    order = enc(f"35=D|49=KIWI|56=PLUM|34=88|52=20230619-14:07:33|11=ord-5|453=2|{party.format('desk')}802=2|523=u|523=v|{party.format('firm')}55=OAT|54=2|60=20230619-14:07:31|40=2|44=3.5|")
    assert told(spark, tables, fix44, order) == []
    assert told(spark, tables, fix44, enc("35=0|49=KIWI|56=PLUM|56=PLUM|34=88|52=20230619-14:07:33|")) == [(56, "Duplicate tag 56 encountered")]


def test_numbers_and_order(spark, tables, fix44):
    found = told(spark, tables, fix44, enc("35=0|49=KIWI|34=-12|56=PLUM|52=20230619-14:07:33|7y=1|"))
    assert found == [(34, "Invalid numeric value -12 for tag 34"), (56, "Tag 56 appears out of dictionary order")]


def test_decoded_lines(spark, tables, fix44):
    own = session.choose(parsed(spark, [f"8=FIX.4.4{S}9=31{S}10=217{S}"]), tables, fix44)
    lines = [r.rendered for r in decode.lines(own, tables, validate.errors(own, tables)).orderBy("at").collect()]
    assert lines[2:] == ["     8 (BeginString): FIX.4.4", "     9 (BodyLength): 31  BodyLength mismatch: got 31, expected 0", "    10 (CheckSum): 217  Checksum mismatch: got 217, expected 252", "    35 (MsgType): Missing required tag 35 (MsgType)", ""]


def test_absent_tags_are_found_where_messages_are_checked(spark, tables, fix44):
    """No message is made again or moved for them; lines are the same whichever errors they are given."""
    texts = [HEARTBEAT, f"8=FIX.4.4{S}9=31{S}10=217{S}", f"8=FIX.4.4{S}9=31{S}35=1{S}10=217{S}", enc("35=0|49=KIWI|56=PLUM|56=PLUM|34=x|52=20230619-14:07:33|"), enc("35=8|37=1|")]
    lines = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(texts)], "file string, file_ordinal int, line_no long, line string")
    own = messages.parse(messages.extract(lines)).withColumn("dict_id", F.lit(fix44))
    plan = decode.absent(validate.told(own, tables), tables)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("(?s)8=FIX") == 1
    key = lambda df: sorted((r.line_no, r.at, r.rendered) for r in df.collect())
    every = key(decode.lines(own, tables, validate.told(own, tables)))
    assert every == key(decode.lines(own, tables, validate.errors(own, tables)))
    assert key(plan) == [x for x in every if 1 << 40 <= x[1] < 1 << 62] and len(key(plan)) > 8


# --- dictionaries, sessions, counts --------------------------------------------------------------------------------------------


def test_dictionaries():
    own = fix_queries.registry()
    assert [own.resolve(v).key for v in (None, "44", "4.4", "FIX.4.4", "fixt11")] == ["FIX44", "FIX44", "FIX44", "FIX44", "FIXT11"]
    with pytest.raises(ValueError, match="Unknown"):
        own.resolve("99")
    with pytest.raises(ValueError, match="Unavailable"):
        own.resolve("42")
    fixt = own.resolve("FIXT11")
    assert (len(fixt.fields), len(fixt.messages), len(fixt.components)) == (71, 8, 4)
    assert own.by_application("9", fixt).key == "FIX50SP2" and own.by_application("8", fixt) is fixt
    assert explore.message_lines(fixt, "1", verbose=True) == ["Message: TestRequest (1)", "    Message: Body", "         112: TestReqID (STRING) - (Y)"]
    assert explore.tag_lines(fixt, 43, True) == ["  43: PossDupFlag (BOOLEAN)", "      N : NO", "      Y : YES"]
    assert explore.component_lines(fixt) == ["HopGrp", "MsgTypeGrp"] and explore.component_lines(fixt, "HopGrp")[1:3] == [" 627: NoHops (NUMINGROUP)".replace(" 627", "     627"), "           628: HopCompID (STRING)"]
    entity = "<!DOCTYPE fix [<!ENTITY e 'E'>]><fix type='&e;'/>"
    for text in ("<!DOCTYPE x><fix/>", "<fix/>", entity, *(f"<?xml version='1.0' encoding='{c}'?>{entity}".encode(c) for c in ("utf-16", "utf-8", "iso-8859-1"))):
        with pytest.raises(ValueError):
            dictionary.parse_xml(text, "x")


def test_cycles_end():
    text = fix_queries.CUSTOM.replace("<components/>", "<components><component name='A'><component name='B' required='Y'/></component><component name='B'><component name='A' required='Y'/><field name='Mark' required='Y'/></component></components>").replace("<field name='Mark' required='Y'/><group", "<component name='A' required='Y'/><group")
    own = dictionary.parse_xml(text, "x")
    assert [t for t, *_ in own.shape(own.message("U1"))] == [8, 35, 5001, 5002]


def test_session_choice(spark, tables, fix44):
    lines = [enc("35=A|1137=9|", "FIXT.1.1"), enc("35=D|", "FIXT.1.1"), enc("35=D|1128=6|", "FIXT.1.1"), enc("35=D|1128=3|", "FIXT.1.1"), enc("35=D|", "FIX.4.4"), enc("35=D|", "FIX.7.7")]
    rows = session.choose(parsed(spark, lines), tables, fix44).orderBy("line_no").collect()
    assert [r.dict_id.split("@")[0] for r in rows] == ["FIXT11", "FIX50SP2", "FIX44", "FIX50SP2", "FIX44", "FIX44"]


def test_counts(spark, tables, fix44):
    own = counts.described(session.choose(parsed(spark, [enc("35=D|"), HEARTBEAT, enc("34=1|"), enc("35=D|")]), tables, fix44), tables)
    assert [(r.bucket, r.rendered) for r in counts.lines(counts.count(own, ["line_no", "msg_idx"])).collect()] == [
        ("Session/Admin", "0                        1  Heartbeat"), ("Business", "D                        2  NewOrderSingle"), ("Unknown", "Unknown                  1  "),
    ]


# --- hiding ------------------------------------------------------------------------------------------------------------------


def test_hidden_message(spark, tables):
    (row,) = obfuscate.lines(logs.from_lines(spark, [f"a {HEARTBEAT} b"]), tables).collect()
    assert f"49=SenderCompID0001{S}56=TargetCompID0001{S}" in row.line and row.line.startswith("a 8=FIX.4.4") and row.line.endswith(f"{S} b")
    own = parsed(spark, [row.line]).select("raw", "fields", fix.expected_length("raw").alias("n"), fix.expected_checksum("raw").alias("c"), fix.int_value(fix.last_value("fields", 9)).alias("n9"), fix.int_value(fix.last_value("fields", 10)).alias("c10")).first()
    assert (own.n, own.c) == (own.n9, own.c10)


def test_aliases_are_stable_and_by_file(spark, tables):
    lines = [enc(f"35=0|49=S{i % 3}|") for i in (2, 0, 1, 0, 2)]
    both = logs.from_lines(spark, lines, "a").unionByName(logs.from_lines(spark, lines[1:], "b"))
    got = {(r.file, r.line_no): r.v for r in messages.parse(messages.extract(obfuscate.lines(both, tables).withColumn("file_ordinal", F.lit(0)))).select("file", "line_no", fix.first_value("fields", 49).alias("v")).collect()}
    assert [got["a", i][-1] for i in range(1, 6)] == list("12321") and [got["b", i][-1] for i in range(1, 5)] == list("1213")


def test_secret_files(spark, tables, tmp_path):
    text = f"x\r\n{HEARTBEAT}\xe9\r\nno end 8=FIX.4.4{S}9=7"
    (tmp_path / "in.log").write_bytes(text.encode("latin-1"))
    own = logs.read_bytes(spark, [str(tmp_path / "in.log")]).withColumn("line_no", F.lit(1))
    hidden = obfuscate.lines(own.withColumnRenamed("text", "line"), tables).select("file", F.col("line").alias("text"))
    (name,) = logs.write_bytes(hidden, str(tmp_path / "out"))
    back = (tmp_path / "out" / "in.secret.log").read_bytes().decode("latin-1")
    assert name.endswith("out/in.secret.log") and back.startswith("x\r\n8=FIX") and back.endswith(f"\xe9\r\nno end 8=FIX.4.4{S}9=7") and "ALMOND" not in back
    assert [logs.secret_name(x) for x in ("a/b.c.d", ".x", "y")] == ["a/b.c.secret.d", ".x.secret", "y.secret"]


# --- orders ------------------------------------------------------------------------------------------------------------------


def states(spark, tables, lines, **more):
    own = parsed(spark, lines).withColumn("dict_id", F.lit("FIX44@built-in"))
    return orders.summaries(own, tables, **more).orderBy("line_no").collect()


def test_order_lifecycle(spark, tables):
    rows = states(spark, tables, [enc("35=D|11=A|55=I|"), enc("35=8|37=O|11=A|39=1|150=F|32=5|"), enc("35=G|41=A|11=B|"), enc("35=8|37=O|11=B|39=2|150=2|"), enc("35=8|37=O|39=0|"), HEARTBEAT])
    assert [(r.key, r.events, r.symbol, r.last_quantity, r.terminal) for r in rows] == [("A", 1, "I", None, False), ("A", 2, "I", "5", False), ("A", 3, "I", "5", False), ("A", 4, "I", "5", True), ("O", 1, None, None, False)]
    assert rows[1].ord_status == "1 (PARTIALLY_FILLED)" and rows[1].message == "ExecutionReport (8)"
    text = orders.lines(spark.createDataFrame(rows[:1], "file string, line_no long, msg_idx int, key string, events long, message string, " + ", ".join(f"{k} string" for k in orders.KEPT) + ", terminal boolean")).first().rendered
    assert text == "Order Summary:\n    Order: A\n    Message: NewOrderSingle (D)\n    ClOrdID: A\n    Symbol: I\n    Events: 1\n"


def test_eldest_order_is_forgotten(spark, tables):
    rows = states(spark, tables, [enc(f"35=D|11={x}|") for x in "abcab"], most_open=2)
    assert [(r.key, r.events) for r in rows] == [("a", 1), ("b", 1), ("c", 1), ("a", 1), ("b", 1)]


# --- sources and streams ------------------------------------------------------------------------------------------------------


def test_log_files(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_bytes(b"one\r\ntwo\n\nfour")
    b.write_bytes(b"x\ry\n")
    rows = logs.read(spark, [str(b), "-", str(a)], ["in"]).orderBy("file_ordinal", "line_no").collect()
    assert [(r.file_ordinal, r.line_no, r.line) for r in rows] == [(0, 1, "x"), (0, 2, "y"), (1, 1, "in"), (2, 1, "one"), (2, 2, "two"), (2, 3, ""), (2, 4, "four")]
    whole = logs.read_whole(spark, [str(a)]).orderBy("line_no").collect()
    assert [r.line for r in whole] == ["one", "two", "", "four"]
    (head,) = logs.file_headers(spark, [str(a)]).collect()
    assert head.file == "a.log" and head.modified.endswith("Z")
    b.write_bytes(b"\xff\n")
    with pytest.raises(Exception, match="not UTF-8"):
        logs.read(spark, [str(b)]).collect()


def test_arguments():
    assert arguments.split(r"""--a 'b c' "d\"e" '' x\ y z\\""") == ["--a", "b c", 'd"e', "x y", "z\\"]
    assert arguments.merged(["x"], " -v ") == ["-v", "x"] and arguments.merged(["x"], " ") == ["x"]


@pytest.fixture
def sessions():
    """Lines of two files in three batches; the second file negotiates a version in its first batch, the first in its second."""
    plain = [enc(f"35=D|49=P{i % 3}|56=Q{i}|11=A{i}|", "FIXT.1.1") for i in range(6)]
    logon = enc("35=A|49=P9|1137=6|", "FIXT.1.1")
    steps = [[("a", plain[0]), ("b", logon), ("b", plain[1])], [("a", logon), ("a", plain[2]), ("b", plain[3])], [("a", plain[4]), ("b", plain[5]), ("b", "no message"), ("a", plain[0])]]
    out, at = [], {"a": 0, "b": 0}
    for step in steps:
        out.append([])
        for file, line in step:
            at[file] += 1
            out[-1].append((file, 0, at[file], line))
    return out


def _in_batches(spark, folder, steps, start):
    """Runs a stream over the steps, each a batch, and then once more from its checkpoint; rows by batch number."""
    source, seen = folder / "in", {}
    source.mkdir()
    lines = spark.readStream.schema(tail.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    for step in steps:
        spark.createDataFrame(step, tail.SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        job = start(lines, lambda rows, number: seen.__setitem__(number, rows.collect())).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
        job.awaitTermination()
    return [r for rows in seen.values() for r in rows]


def test_a_stream_keeps_the_negotiated_version(spark, tables, tmp_path, sessions):
    got = _in_batches(spark, tmp_path, sessions, lambda lines, write: carried.choose(lines, tables, "FIXT11@built-in", str(tmp_path / "left"), write))
    every = spark.createDataFrame([r for step in sessions for r in step], tail.SCHEMA)
    want = session.choose(messages.parse(messages.extract(every)), tables, "FIXT11@built-in").collect()
    key = lambda rows: sorted((r.file, r.line_no, r.dict_id, str(r.negotiated)) for r in rows)
    assert key(got) == key(want)
    assert len({r.dict_id for r in got}) > 1
    assert sorted(p.name for p in (tmp_path / "left").iterdir()) == ["batch=1", "batch=2"]  # not every batch's


@pytest.mark.parametrize(("block", "most"), [(1, 100), (2, 100), (3, 0), (1 << 16, 100)])
def test_versions_are_negotiated_by_blocks(spark, tables, monkeypatch, block, most):
    """The same as one walk over each file, whatever the blocks; with few blocks allowed the join is a shuffle."""
    monkeypatch.setattr(session, "BLOCK", block)
    monkeypatch.setattr(session, "MOST", most)
    versions = [None, None, "6", None, "X", None, "T11", None, None, "6", None, None]
    rows = [(f, 0, i + 1, enc("35=D|11=A|" + (f"1137={v}|" if v and (f != "b" or i > 5) else ""), "FIXT.1.1")) for f in "abc" for i, v in enumerate(versions) if f != "c" or v is None]
    own = messages.parse(messages.extract(spark.createDataFrame(rows, tail.SCHEMA)))
    got = {(r.file, r.line_no): r.negotiated for r in session.negotiated(own, tables, ["file"], ["line_no", "msg_idx"]).collect()}
    known = {r.version: r.dict_id for r in tables.applications.collect()}
    now, want = {}, {}
    for f, _, n, line in rows:
        stated = line.split("1137=")[1].split(S)[0] if "1137=" in line else None
        now[f] = known.get(stated) or known.get(f"FIX{stated}") or now.get(f)
        want[f, n] = now[f]
    assert got == want and len(set(want.values())) > 1


def test_a_stream_keeps_its_aliases(spark, tables, tmp_path, sessions):
    got = _in_batches(spark, tmp_path, sessions, lambda lines, write: carried.hide(lines, tables, write))
    every = spark.createDataFrame([r for step in sessions for r in step], tail.SCHEMA)
    want = obfuscate.lines(every, tables).collect()
    assert sorted((r.file, r.line_no, r.line) for r in got) == sorted((r.file, r.line_no, r.line) for r in want)
    assert not any("=P" in r.line or "=Q" in r.line for r in got)


def test_following_a_growing_file(spark, tmp_path):
    file = tmp_path / "live.log"
    file.write_text(HEARTBEAT + "\n" + HEARTBEAT[:30])
    rows = tail.follow_messages(spark, str(tmp_path / "*.log"))
    job = rows.select("line_no", "raw").writeStream.format("memory").queryName("followed").start()
    try:
        job.processAllAvailable()
        assert spark.table("followed").count() == 1
        with file.open("a") as f:
            f.write(HEARTBEAT[30:])  # whole, though its line has not ended
        job.processAllAvailable()
        assert [(r.line_no, r.raw) for r in spark.table("followed").orderBy("line_no").collect()] == [(1, HEARTBEAT), (2, HEARTBEAT)]
    finally:
        job.stop()


def test_orders_as_a_stream(spark, tables, tmp_path):
    steps = [[enc("35=D|11=A|55=I|"), enc("35=8|37=O|11=A|39=1|")], [enc("35=8|37=O|39=2|")]]
    at = 0
    source = tmp_path / "in"
    schema = "file string, line_no long, msg_idx int, line string"

    def put():
        nonlocal at
        own = [("f", at * 10 + i, 0, x) for i, x in enumerate(steps[at])]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(source))
        at += 1

    put()
    lines = spark.readStream.schema(schema).parquet(str(source))
    own = messages.parse(lines.withColumnRenamed("line", "raw")).withColumn("dict_id", F.lit("FIX44@built-in"))
    job = orders.stream_summaries(own, tables).writeStream.format("memory").queryName("orders_seen").outputMode("append").start()
    try:
        job.processAllAvailable()
        put()
        job.processAllAvailable()
        rows = spark.table("orders_seen").orderBy("events").collect()
        assert [(r.key, r.events, r.symbol, r.terminal) for r in rows] == [("A", 1, "I", False), ("A", 2, "I", False), ("A", 3, "I", True)]
    finally:
        job.stop()


# --- queries ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for f in os.listdir(SF) if os.path.exists(SF) else ():
        own.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return own


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(fix_queries.ORACLES))
def test_query_against_sql(spark, duck, name):
    got = fix_queries.QUERIES[name](spark, SF)
    want = duck.execute(fix_queries.ORACLES[name])
    names = sorted(got.columns)
    places = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == sorted(str([r[i] for i in places]) for r in want.fetchall())


def test_a_line_is_made_once(spark, tables, fix44):
    """What is passed over, extracted and validated makes no filter on the text of lines, nor on arrays that generators take."""
    lines = spark.range(9).select(F.lit("f").alias("file"), F.lit(0).alias("file_ordinal"), F.col("id").alias("line_no"), F.concat(F.lit("made here "), F.lit(HEARTBEAT), F.col("id").cast("string")).alias("line"))
    own = messages.parse(messages.extract(lines))
    found = validate.errors(own.withColumn("dict_id", F.lit(fix44)), tables)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("made here ") == 1
    assert plan.count("(?s)8=FIX") == 1
    assert own.count() == 9 and found.count() == 0


def test_lines_are_decoded_and_values_found_in_one_pass(spark, tables, fix44):
    lines = spark.range(3).select(F.lit("f").alias("file"), F.lit(0).alias("file_ordinal"), F.col("id").alias("line_no"), F.concat(F.lit("made here "), F.lit(HEARTBEAT), F.col("id").cast("string")).alias("line"))
    own = messages.parse(messages.extract(lines)).withColumn("dict_id", F.lit(fix44))
    for once in (decode.lines(own, tables), obfuscate.values(lines, tables)):
        assert once._jdf.queryExecution().optimizedPlan().toString().count("made here ") == 1
