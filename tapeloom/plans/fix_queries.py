"""Queries over FIX text made from the tables, and DuckDB SQL for what they give.

The text is built alike in both engines: from whole numbers, codes and formatted times, never from floating point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from tapeloom.functions import fix
from tapeloom.operators import counts, decode, dictionary, explore, messages, obfuscate, orders, session, validate
from tapeloom.session import scratch, spread, table

SOH = fix.SOH
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- text from orders ----------------------------------------------------------------------------------------------------

#: A field list: (tag, Spark SQL, DuckDB SQL where it differs). k is the order's key, s its status as a code.
_REPORT = [
    (35, "'8'"), (49, "'BROKER'"), (56, "concat('C', o_custkey)"), (34, "k"), (52, "date_format(o_orderdate, 'yyyyMMdd-HH:mm:ss.SSS')", "strftime(o_orderdate, '%Y%m%d-%H:%M:%S.%g')"), (37, "concat('O', k)"), (11, "concat('C', k)"),
    (17, "concat('E', k)"), (150, "CASE WHEN s = '0' THEN '0' ELSE 'F' END"), (39, "s"), (55, "concat('SYM', k % 50)"), (54, "1 + k % 2"), (38, "100 + k % 900"), (44, "1 + k % 97"), (151, "k % 100"), (14, "100"), (6, "0"),
]
_STATUS = "CASE o_orderstatus WHEN 'F' THEN '2' WHEN 'P' THEN '1' ELSE '0' END"


def _fields(names, own=None) -> tuple[list[str], list[str]]:
    spark, duck = {}, {}
    for tag, a, *b in _REPORT:
        spark[tag], duck[tag] = a, b[0] if b else a
    for tag, text in (own or {}).items():
        spark[tag] = duck[tag] = text
    part = lambda t, x: f"concat('{t}=', {x}, chr(1))"
    return [part(t, spark[t]) for t in names], [part(t, duck[t]) for t in names]


_ALL = [t for t, *_ in _REPORT]
_BODY, _DUCK_BODY = _fields(_ALL)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).withColumn("k", F.col("o_orderkey")).withColumn("s", F.expr(_STATUS))


def _lines(df: DataFrame, line: Column) -> DataFrame:
    """Log lines: sixteen files, numbered by key."""
    return df.select(F.concat(F.lit("f"), (F.col("k") % 16).cast("string")).alias("file"), F.lit(0).alias("file_ordinal"), F.col("k").alias("line_no"), line.alias("line"))


def _raw(parts: list[str] = _BODY) -> Column:
    return fix.encode("FIX.4.4", F.expr(f"concat({', '.join(parts)})"))


def _with(body: str, name: str = "r", where: str = "", begin: str = "FIX.4.4") -> str:
    """Common table expressions up to one with k and raw."""
    ck = "lpad(CAST(list_sum(list_transform(string_split(head, ''), lambda c: unicode(c))) % 256 AS VARCHAR), 3, '0')"
    return f"""WITH o AS (SELECT *, o_orderkey AS k, {_STATUS} AS s FROM orders), b AS (SELECT *, {body} AS body FROM o {where}),
h AS (SELECT *, concat('8={begin}', chr(1), '9=', length(body), chr(1), body) AS head FROM b),
{name} AS (SELECT *, concat(head, '10=', {ck}, chr(1)) AS raw FROM h)"""


_R = _with(f"concat({', '.join(_DUCK_BODY)})")


def _reports(spark, sf_dir) -> DataFrame:
    return messages.parse(messages.extract(_lines(_keyed(spark, sf_dir), _raw())))


@query(f"{_R} SELECT k AS o_orderkey, raw FROM r")
def encode_exec_reports(spark, sf_dir):
    return _keyed(spark, sf_dir).select("o_orderkey", _raw().alias("raw"))


@query(f"{_R} SELECT k AS line_no, 0 AS msg_idx, raw FROM r")
def extract_messages(spark, sf_dir):
    lines = _lines(_keyed(spark, sf_dir), F.concat(F.lit("INFO "), _raw(), F.lit(" tail 10=1")))
    return messages.extract(lines).select("line_no", "msg_idx", "raw")


@query(f"{_R} SELECT k AS line_no, i AS msg_idx, raw FROM r, (VALUES (0), (1), (2)) AS t(i)")
def extract_embedded(spark, sf_dir):
    own = _keyed(spark, sf_dir).withColumn("raw", _raw())
    lines = _lines(own, F.concat("raw", F.lit("then "), "raw", "raw", F.lit("end")))
    return messages.extract(lines).select("line_no", "msg_idx", "raw")


@query(f"{_R} SELECT k AS line_no, 0 AS msg_idx, raw FROM r")
def extract_stale_partial(spark, sf_dir):
    own = _keyed(spark, sf_dir).withColumn("raw", _raw())
    lines = _lines(own, F.concat(F.expr("left(raw, cast(25 + k % 20 as int))"), F.lit(" "), "raw"))
    return messages.extract(lines).select("line_no", "msg_idx", "raw")


@query(f"{_R} SELECT k AS line_no, left(raw, CAST(12 + k % 40 AS INT)) AS tail, concat(raw, ' and ') AS stable FROM r")
def extract_tail(spark, sf_dir):
    own = _keyed(spark, sf_dir).withColumn("raw", _raw())
    lines = _lines(own, F.concat("raw", F.lit(" and "), F.expr("left(raw, cast(12 + k % 40 as int))"))).withColumn("tail", fix.tail("line"))
    return lines.select("line_no", "tail", fix.stable_prefix("line", "tail").alias("stable"))


@query("""SELECT o_orderkey AS line_no, CASE o_orderkey % 3 WHEN 0 THEN concat('8=FIX', repeat('x', 60)) WHEN 1 THEN repeat('8=FIX', 19) ELSE '' END AS flushed,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '8=FIX' ELSE '8=FIX.4.4' END AS kept FROM orders""")
def bounded_tail(spark, sf_dir):
    own = _keyed(spark, sf_dir).withColumn("t", F.expr("CASE WHEN k % 3 = 0 THEN concat('8=FIX', repeat('x', 60)) WHEN k % 3 = 1 THEN repeat('8=FIX', 20) ELSE '8=FIX.4.4' END")).withColumn("b", fix.bounded_tail("t", 50))
    return own.select(F.col("k").alias("line_no"), "b.flushed", "b.kept")


@query(f"{_R} SELECT k AS line_no, 0 AS msg_idx, raw FROM r")
def custom_delimiter(spark, sf_dir):
    lines = _lines(_keyed(spark, sf_dir), F.concat(F.lit("x "), F.translate(_raw(), SOH, "|")))
    return messages.extract(lines, "|").select("line_no", "msg_idx", "raw")


# --- fields ------------------------------------------------------------------------------------------------------------


@query(f"""{_R}, f AS (SELECT k, string_split(rtrim(raw, chr(1)), chr(1)) AS p FROM r)
SELECT k AS line_no, CAST(i AS INT) AS field_idx, CAST(split_part(p[i + 1], '=', 1) AS INT) AS tag, split_part(p[i + 1], '=', 2) AS value FROM f, unnest(range(0, len(p))) AS t(i)""")
def parse_fields(spark, sf_dir):
    return messages.explode(_reports(spark, sf_dir)).select("line_no", "field_idx", "tag", "value")


@query("""SELECT o_orderkey AS line_no, 'a' AS first_58, concat('b', o_orderkey % 7) AS last_58, o_orderkey % 2 = 0 AS has_60, 'BROKER' AS sender, CAST(NULL AS VARCHAR) AS absent FROM orders""")
def first_and_last_values(spark, sf_dir):
    body = [*_BODY, "concat('58=a', chr(1))", "concat('58=m', chr(1))", "CASE WHEN k % 2 = 0 THEN concat('60=x', chr(1)) ELSE '' END", "concat('58=b', k % 7, chr(1))"]
    own = messages.parse(messages.extract(_lines(_keyed(spark, sf_dir), _raw(body))))
    return own.select("line_no", fix.first_value("fields", 58).alias("first_58"), fix.last_value("fields", 58).alias("last_58"), fix.has_tag("fields", 60).alias("has_60"), fix.first_value("fields", 49).alias("sender"), fix.first_value("fields", 999).alias("absent"))


@query("""SELECT o_orderkey AS line_no, tag, concat(v, CASE WHEN tag = 58 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END) AS value FROM orders, (VALUES (58, 'lead'), (60, 'a=b'), (61, '')) AS t(tag, v)""")
def malformed_fragments(spark, sf_dir):
    body = ["concat('abc', chr(1))", "concat('=x', chr(1))", "concat('x9=1', chr(1))", "concat('0058=lead', k, chr(1))", "chr(1)", "concat('60=a=b', chr(1))", "concat('61=', chr(1))", "concat('99999999999=1', chr(1))"]
    own = messages.parse(messages.extract(_lines(_keyed(spark, sf_dir), _raw(body))))
    return messages.explode(own).where(~F.col("tag").isin(8, 9, 10)).select("line_no", "tag", "value")


@query("""SELECT o_orderkey AS line_no, CASE o_orderkey % 5 WHEN 0 THEN 12 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN -1 ELSE 7 END AS parsed FROM orders""")
def int_values(spark, sf_dir):
    value = F.expr("element_at(array('12', '-1', '1a', '', '007'), cast(k % 5 + 1 as int))")
    return _keyed(spark, sf_dir).select(F.col("k").alias("line_no"), fix.int_value(value).alias("parsed"))


@query(f"""{_R} SELECT k AS line_no, CAST(substr(raw, length(raw) - 3, 3) AS INT) AS expected, CAST((CAST(substr(raw, length(raw) - 3, 3) AS INT) + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 256 AS INT) AS stated, k % 5 <> 0 AS correct FROM r""")
def checksum_check(spark, sf_dir):
    wrong = F.concat(F.expr("left(raw, length(raw) - 4)"), fix.digits(F.pmod(F.expr("cast(substr(raw, length(raw) - 3, 3) as int)") + F.when(F.col("k") % 5 == 0, 1).otherwise(0), F.lit(256)), 3), F.lit(SOH))
    own = messages.parse(messages.extract(_lines(_keyed(spark, sf_dir).withColumn("raw", _raw()), wrong)))
    expected, stated = fix.expected_checksum("raw").cast("int"), fix.int_value(fix.last_value("fields", 10))
    return own.select("line_no", expected.alias("expected"), stated.alias("stated"), (expected == stated).alias("correct"))


@query(f"""{_R} SELECT k AS line_no, CAST(length(body) AS INT) AS expected, CAST(length(body) + k % 3 AS INT) AS stated, k % 3 = 0 AS correct FROM r""")
def body_length_check(spark, sf_dir):
    raw = F.concat(F.lit(f"8=FIX.4.4{SOH}9="), (F.length("body") + F.col("k") % 3).cast("string"), F.lit(SOH), "body", F.lit(f"10=000{SOH}"))
    own = messages.parse(messages.extract(_lines(_keyed(spark, sf_dir).withColumn("body", F.expr(f"concat({', '.join(_BODY)})")), raw)))
    expected, stated = fix.expected_length("raw").cast("int"), fix.int_value(fix.last_value("fields", 9))
    return own.select("line_no", expected.alias("expected"), stated.alias("stated"), (expected == stated).alias("correct"))


# --- value checks: texts with what is known of them ------------------------------------------------------------------------

_CHECKS = {
    "validate_int": (fix.is_integer, [("12", True), ("-1", False), ("+1", False), ("", False), ("1.0", False), ("007", True), ("12 ", False)]),
    "validate_bool": (fix.is_boolean, [("Y", True), ("N", True), ("y", False), ("", False), ("YES", False)]),
    "validate_timestamp": (fix.is_timestamp, [("20250101-09:30", True), ("20250101-09:30:00", True), ("20250101-09:30:00.", True), ("20250101-09:30:00.123456789", True), ("20250101-24:00:00", False), ("20250101-23:59:60", False), ("20250101-09:30:00.1234567890", False), ("20250101-09:30:00Z", False), ("20250101-9:30:00", False), ("20230230-09:30:00", False), ("20240229-00:00:00", True), ("20250101-00:00:00BAD", False), ("2025-01-01", False)]),
    "validate_date": (fix.is_date, [("20250101", True), ("20230230", False), ("20240229", True), ("00000229", True), ("20250101Z", True), ("20250101+0100", True), ("20250101+01", True), ("2025011", False), ("2025-01-01", False), ("", False), ("20251301", False)]),
}


def _check(name: str):
    test, cases = _CHECKS[name]
    values = ", ".join(f"({i}, '{v}', {ok})" for i, (v, ok) in enumerate(cases))

    def run(spark, sf_dir):
        value = F.element_at(F.array(*(F.lit(v) for v, _ in cases)), (F.col("event_id") % len(cases) + 1).cast("int"))
        own = spread(table(spark, sf_dir, "events")).select("event_id", value.alias("value"))
        return own.select("event_id", "value", test("value").alias("valid"))

    run.__name__ = name
    query(f"SELECT event_id, v AS value, ok AS valid FROM events JOIN (VALUES {values}) AS t(i, v, ok) ON event_id % {len(cases)} = i")(run)


for _name in _CHECKS:
    _check(_name)


@query("SELECT event_id, ['FIX44', 'FIX44', 'FIX44', 'FIX44', 'FIX50SP2', 'FIXT11', 'FIXT11'][CAST(event_id % 7 + 1 AS INT)] AS version FROM events")
def normal_versions(spark, sf_dir):
    value = F.expr("element_at(array('44', '4.4', 'fix44', ' FIX.4.4 ', 'FIX50SP2', 'FIXT.1.1', 'fixt11'), cast(event_id % 7 + 1 as int))")
    return spread(table(spark, sf_dir, "events")).select("event_id", fix.version(value).alias("version"))


@query("""SELECT o_orderkey AS line_no, CAST(100 + o_orderkey % 900 AS DECIMAL(38, 10)) AS quantity, CAST(o_orderkey AS BIGINT) AS sequence, date_trunc('second', o_orderdate) AS sent FROM orders""")
def typed_values(spark, sf_dir):
    own = _reports(spark, sf_dir)
    value = lambda tag: fix.first_value("fields", tag)
    return own.select("line_no", fix.typed(value(38), F.lit("QTY"))["as_decimal"].alias("quantity"), fix.typed(value(34), F.lit("SEQNUM"))["as_long"].alias("sequence"), F.date_trunc("second", fix.typed(value(52), F.lit("UTCTIMESTAMP"))["as_timestamp"]).alias("sent"))


# --- dictionaries, validation, decoding ------------------------------------------------------------------------------------

#: A small dictionary as a user would give it.
CUSTOM = """<fix type='FIX' major='5' minor='0' servicepack='2'><header><field name='BeginString' required='Y'/><field name='MsgType' required='Y'/></header><trailer/>
<messages><message name='Custom' msgtype='U1' msgcat='app'><field name='Mark' required='Y'/><group name='NoMarks' required='N'><field name='Mark' required='N'/></group></message></messages>
<components/><fields><field number='8' name='BeginString' type='STRING'/><field number='35' name='MsgType' type='STRING'/><field number='5001' name='Mark' type='CHAR'><values><value enum='a' description='FIRST'/></values></field><field number='5002' name='NoMarks' type='NUMINGROUP'/></fields></fix>"""


def registry() -> dictionary.Registry:
    return dictionary.Registry([(CUSTOM, "custom.xml")])


def _tables(spark) -> dictionary.Tables:
    return dictionary.tables(spark, registry())


_FIX44 = "FIX44@built-in"
_CASE = "k % 7"
#: Each case changes one thing of a valid report; the errors it must give are stated beside the SQL.


def _mutated(parts: list[str]) -> str:
    by = dict(zip(_ALL, parts, strict=True))
    by[49] = f"CASE WHEN {_CASE} = 2 THEN '' ELSE {by[49]} END"
    by[38] = f"concat({by[38]}, CASE WHEN {_CASE} = 1 THEN concat('9999=x', chr(1)) ELSE '' END)"
    swapped = f"CASE WHEN {_CASE} = 4 THEN concat({by[54]}, {by[55]}) WHEN {_CASE} = 5 THEN concat({by[55]}, '54=9', chr(1)) ELSE concat({by[55]}, {by[54]}) END"
    by[55], by[54] = swapped, "''"
    by[6] = f"concat({by[6]}, CASE WHEN {_CASE} = 3 THEN concat('55=AGAIN', chr(1)) ELSE '' END)"
    by[34] = f"CASE WHEN {_CASE} = 6 THEN concat('34=', chr(1)) ELSE {by[34]} END"
    return f"concat({', '.join(by[t] for t in _ALL)})"


def _mutants(spark, sf_dir) -> DataFrame:
    raw = fix.encode("FIX.4.4", F.expr(_mutated(_BODY)))
    wrong = F.when(F.col("k") % 11 == 0, F.concat(F.expr("left(raw, length(raw) - 4)"), F.lit(f"999{SOH}"))).otherwise(F.col("raw"))
    lines = _lines(_keyed(spark, sf_dir).withColumn("raw", raw), wrong)
    return session.choose(messages.parse(messages.extract(lines)), _tables(spark), _FIX44)


_M = _with(_mutated(_DUCK_BODY))
_ERRORS = f"""{_M}, e AS (
  SELECT k, phase, tag, error FROM r JOIN (VALUES (1, 1, 9999, 'Unknown tag 9999 in FIX44'), (2, 3, 49, 'Missing required tag 49 (SenderCompID)'), (3, 2, 55, 'Duplicate tag 55 encountered'),
    (4, 4, 55, 'Tag 55 appears out of dictionary order'), (5, 1, 54, 'Invalid enum value 9 for tag 54'), (6, 1, 34, 'Invalid numeric value for tag 34')) AS t(c, phase, tag, error) ON {_CASE} = c
  UNION ALL SELECT k, 6, 10, concat('Checksum mismatch: got 999, expected ', substr(raw, length(raw) - 3, 3)) FROM r WHERE k % 11 = 0)"""


@query(f"{_ERRORS} SELECT k AS line_no, phase, tag, error FROM e")
def validation_errors(spark, sf_dir):
    return validate.errors(_mutants(spark, sf_dir), _tables(spark)).select("line_no", "phase", "tag", "error")


def _phase(name: str, phase: int, text: str):
    def run(spark, sf_dir):
        found = validate.errors(_mutants(spark, sf_dir), _tables(spark))
        return found.where((F.col("phase") == phase) & F.col("error").startswith(text)).select("line_no", "tag")

    run.__name__ = name
    query(f"{_ERRORS} SELECT k AS line_no, tag FROM e WHERE phase = {phase} AND starts_with(error, '{text}')")(run)


for _name, _n, _text in (("unknown_tags", 1, "Unknown tag"), ("validate_enum", 1, "Invalid enum"), ("duplicate_tags", 2, "Duplicate"), ("missing_required", 3, "Missing"), ("field_order", 4, "Tag ")):
    _phase(_name, _n, _text)


@query(f"{_ERRORS} SELECT phase, tag, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY phase, tag")
def error_summary(spark, sf_dir):
    return validate.errors(_mutants(spark, sf_dir), _tables(spark)).groupBy("phase", "tag").agg(F.count("*").alias("n"))


@query(f"{_ERRORS} SELECT k AS line_no, CAST(count(*) AS BIGINT) AS n_errors, string_agg(error, '; ' ORDER BY phase) AS errors FROM e GROUP BY k")
def errors_joined(spark, sf_dir):
    return validate.joined(validate.errors(_mutants(spark, sf_dir), _tables(spark))).select("line_no", "n_errors", "errors")


@query(f"{_ERRORS} SELECT k AS line_no, concat('Line ', k, ': ', string_agg(error, '; ' ORDER BY phase)) AS rendered FROM e GROUP BY k")
def error_lines(spark, sf_dir):
    return decode.line_prefixes(validate.errors(_mutants(spark, sf_dir), _tables(spark))).select("line_no", "rendered")


_NAMES = """(VALUES (8, 'BeginString', 'STRING'), (9, 'BodyLength', 'LENGTH'), (35, 'MsgType', 'STRING'), (49, 'SenderCompID', 'STRING'), (56, 'TargetCompID', 'STRING'), (34, 'MsgSeqNum', 'SEQNUM'), (52, 'SendingTime', 'UTCTIMESTAMP'),
  (37, 'OrderID', 'STRING'), (11, 'ClOrdID', 'STRING'), (17, 'ExecID', 'STRING'), (150, 'ExecType', 'CHAR'), (39, 'OrdStatus', 'CHAR'), (55, 'Symbol', 'STRING'), (54, 'Side', 'CHAR'), (38, 'OrderQty', 'QTY'), (44, 'Price', 'PRICE'),
  (151, 'LeavesQty', 'QTY'), (14, 'CumQty', 'QTY'), (6, 'AvgPx', 'PRICE'), (10, 'CheckSum', 'STRING')) AS n(tag, name, type)"""
_ENUMS = "(VALUES (35, '8', 'EXECUTION_REPORT'), (39, '0', 'NEW'), (39, '1', 'PARTIALLY_FILLED'), (39, '2', 'FILLED'), (54, '1', 'BUY'), (54, '2', 'SELL'), (150, '0', 'NEW'), (150, 'F', 'TRADE')) AS d(tag, value, description)"
_SPLIT = f"""{_R}, l AS (SELECT k, string_split(rtrim(raw, chr(1)), chr(1)) AS fs FROM r), p AS (SELECT k, generate_subscripts(fs, 1) - 1 AS pos, unnest(fs) AS f FROM l),
v AS (SELECT k, pos, CAST(split_part(f, '=', 1) AS INT) AS tag, split_part(f, '=', 2) AS value FROM p)"""


@query(f"{_SPLIT} SELECT k AS line_no, CAST(pos AS INTEGER) AS field_idx, tag, coalesce(name, CAST(tag AS VARCHAR)) AS name, type, value, description FROM v LEFT JOIN {_NAMES} USING (tag) LEFT JOIN {_ENUMS} USING (tag, value)")
def decode_fields(spark, sf_dir):
    own = session.choose(_reports(spark, sf_dir), _tables(spark), _FIX44)
    return decode.fields(own, _tables(spark)).select("line_no", "field_idx", "tag", "name", "type", "value", "description")


@query(f"{_SPLIT} SELECT tag, value, description, CAST(count(*) AS BIGINT) AS n FROM v JOIN {_ENUMS} USING (tag, value) GROUP BY ALL")
def enum_decode(spark, sf_dir):
    own = session.choose(_reports(spark, sf_dir), _tables(spark), _FIX44)
    return decode.fields(own, _tables(spark)).where("description IS NOT NULL").groupBy("tag", "value", "description").agg(F.count("*").alias("n"))


@query(f"""{_SPLIT}, x AS (SELECT k, pos, concat(lpad(CAST(tag AS VARCHAR), 6, ' '), ' (', coalesce(name, CAST(tag AS VARCHAR)), '): ', value, CASE WHEN description IS NULL THEN '' ELSE concat(' (', description, ')') END) AS rendered
  FROM v LEFT JOIN {_NAMES} USING (tag) LEFT JOIN {_ENUMS} USING (tag, value))
SELECT k AS line_no, CAST(pos AS BIGINT) AS place, rendered FROM x UNION ALL SELECT k, -2, raw FROM r UNION ALL SELECT k, -1, '' FROM r UNION ALL SELECT k, {1 << 62}, '' FROM r""")
def decode_lines(spark, sf_dir):
    """Every line of every message: its text, an empty line, all fields, an empty line."""
    own = session.choose(_reports(spark, sf_dir), _tables(spark), _FIX44)
    return decode.lines(own, _tables(spark)).select("line_no", F.col("at").alias("place"), "rendered")


@query(f"""{_ERRORS} SELECT k AS line_no, concat(lpad(CAST(tag AS VARCHAR), 6, ' '), CASE tag WHEN 49 THEN ' (SenderCompID): ' ELSE '' END, error) AS rendered FROM e WHERE tag = 49""")
def decode_absent_tags(spark, sf_dir):
    own, tables = _mutants(spark, sf_dir), _tables(spark)
    return decode.absent(validate.told(own, tables), tables).select("line_no", "rendered")


# --- counts --------------------------------------------------------------------------------------------------------------

_TYPES = {"signup": "A", "purchase": "D", "view": "0", "click": "ZZ", "error": None}


def _event_messages(spark, sf_dir) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in _TYPES.items() if pair[1] for x in pair))[F.col("event_type")]
    body = F.concat(F.coalesce(F.concat(F.lit("35="), kind, F.lit(SOH)), F.lit("")), F.lit("34="), F.col("event_id").cast("string"), F.lit(SOH))
    lines = spread(table(spark, sf_dir, "events")).select(F.lit("events").alias("file"), F.lit(0).alias("file_ordinal"), F.col("event_id").alias("line_no"), fix.encode("FIX.4.4", body).alias("line"))
    own = messages.parse(messages.extract(lines))
    return counts.described(own.withColumn("dict_id", F.lit(_FIX44)), _tables(spark))


_COUNTED = "(VALUES ('signup', 'Session/Admin', 'A', 'Logon'), ('purchase', 'Business', 'D', 'NewOrderSingle'), ('view', 'Session/Admin', '0', 'Heartbeat'), ('click', 'Unknown', 'ZZ', NULL), ('error', 'Unknown', 'Unknown', NULL)) AS t(event_type, bucket, msg_type, label)"


@query(f"SELECT msg_type, CAST(count(*) AS BIGINT) AS n FROM events JOIN {_COUNTED} USING (event_type) GROUP BY msg_type")
def count_by_type(spark, sf_dir):
    return _event_messages(spark, sf_dir).groupBy("msg_type").agg(F.count("*").alias("n"))


@query(f"SELECT bucket, msg_type, label, CAST(count(*) AS BIGINT) AS n FROM events JOIN {_COUNTED} USING (event_type) GROUP BY ALL")
def count_by_bucket(spark, sf_dir):
    return counts.count(_event_messages(spark, sf_dir), ["line_no", "msg_idx"]).select("bucket", "msg_type", "label", "n")


@query(f"SELECT bucket, msg_type, min(event_id) AS first_line, CAST(row_number() OVER (PARTITION BY bucket ORDER BY min(event_id)) AS INT) AS place FROM events JOIN {_COUNTED} USING (event_type) GROUP BY bucket, msg_type")
def count_first_seen(spark, sf_dir):
    own = counts.count(_event_messages(spark, sf_dir), ["line_no", "msg_idx"])
    return own.select("bucket", "msg_type", F.col("first.line_no").alias("first_line"), F.row_number().over(Window.partitionBy("bucket").orderBy("first")).alias("place"))


@query(f"SELECT bucket, msg_type, CAST(2 * count(*) AS BIGINT) AS n FROM events JOIN {_COUNTED} USING (event_type) GROUP BY bucket, msg_type")
def count_merge(spark, sf_dir):
    own = counts.count(_event_messages(spark, sf_dir), ["line_no", "msg_idx"])
    return counts.merge(own.unionByName(own)).select("bucket", "msg_type", "n")


@query(f"SELECT bucket, concat(rpad(msg_type, 18, ' '), ' ', lpad(CAST(count(*) AS VARCHAR), 7, ' '), '  ', coalesce(label, '')) AS rendered FROM events JOIN {_COUNTED} USING (event_type) GROUP BY bucket, msg_type, label")
def count_lines(spark, sf_dir):
    return counts.lines(counts.count(_event_messages(spark, sf_dir), ["line_no", "msg_idx"]))


# --- sessions ------------------------------------------------------------------------------------------------------------

_FIXT, _CUSTOM = "FIXT11@built-in", "FIX50SP2@custom.xml"


def _sessions(spark, sf_dir) -> DataFrame:
    """A stream a user; logons negotiate, some orders state a version, some messages are not transport messages."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "view", "0").otherwise("D")
    n = (e % 10).cast("string")
    parts = [F.lit("35="), kind, F.lit(f"{SOH}34="), e.cast("string"), F.lit(SOH), F.when((kind == "A"), F.concat(F.lit("1137="), n, F.lit(SOH))).otherwise(F.lit("")), F.when((kind == "D") & (e % 4 == 0), F.concat(F.lit("1128="), n, F.lit(SOH))).otherwise(F.lit(""))]
    begin = F.when(e % 9 == 0, F.lit("FIX.4.4")).when(e % 9 == 1, F.lit("FIX.9.9")).otherwise(F.lit("FIXT.1.1"))
    own = spread(table(spark, sf_dir, "events")).withColumn("line", fix.encode(begin, F.concat(*parts)))
    lines = own.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.lit(0).alias("file_ordinal"), F.col("event_id").alias("line_no"), "line")
    return messages.parse(messages.extract(lines))


_SEEN = f"""WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'A' WHEN 'view' THEN '0' ELSE 'D' END AS kind, CASE event_id % 10 WHEN 6 THEN '{_FIX44}' WHEN 9 THEN '{_CUSTOM}' END AS named FROM events),
w AS (SELECT *, last_value(CASE WHEN kind = 'A' THEN named END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS negotiated FROM e)"""


@query(f"{_SEEN} SELECT event_id AS line_no, negotiated FROM w")
def session_version(spark, sf_dir):
    return session.negotiated(_sessions(spark, sf_dir), _tables(spark), ["file"], ["line_no", "msg_idx"]).select("line_no", "negotiated")


@query(f"""{_SEEN} SELECT event_id AS line_no, CASE WHEN event_id % 9 = 0 THEN '{_FIX44}' WHEN event_id % 9 = 1 THEN '{_FIX44}' WHEN kind IN ('A', '0') THEN '{_FIXT}'
  WHEN event_id % 4 = 0 AND named IS NOT NULL THEN named ELSE coalesce(negotiated, '{_FIX44}') END AS dict_id FROM w""")
def dictionary_choice(spark, sf_dir):
    return session.choose(_sessions(spark, sf_dir), _tables(spark), _FIX44).select("line_no", "dict_id")


# --- hiding --------------------------------------------------------------------------------------------------------------


def _alias(prefix: str, value: str, name: str) -> str:
    return f"{name} AS (SELECT f, v, concat('{prefix}', lpad(CAST(row_number() OVER (PARTITION BY f ORDER BY first) % 10000 AS VARCHAR), 4, '0')) AS alias FROM (SELECT o_orderkey % 16 AS f, {value} AS v, min(o_orderkey) AS first FROM orders GROUP BY ALL))"


@query(f"WITH {_alias('TargetCompID', 'o_custkey', 'a')} SELECT concat('f', f) AS file, concat('C', v) AS value, alias FROM a")
def alias_assign(spark, sf_dir):
    lines = _lines(_keyed(spark, sf_dir), _raw())
    framed = obfuscate.frames(lines)
    parts = obfuscate.fragments(framed, ["file", "line_no", "seq"]).join(F.broadcast(_tables(spark).sensitive), "tag")
    values = parts.where("tag = 56").withColumn("value", F.substr("fragment", F.lit(4)))
    return obfuscate.aliases(values, ["line_no", "seq", "at"]).select("file", "value", "alias")


_HIDDEN = [x if t not in (49, 56) else {49: "concat('49=SenderCompID0001', chr(1))", 56: "concat('56=', alias, chr(1))"}[t] for t, x in zip(_ALL, _DUCK_BODY, strict=True)]
_HIDE = _with(f"concat({', '.join(_HIDDEN)})", where="JOIN a ON a.f = k % 16 AND a.v = o_custkey").replace("WITH o AS", f"WITH {_alias('TargetCompID', 'o_custkey', 'a')}, o AS")


@query(f"{_HIDE} SELECT k AS line_no, concat('INFO ', raw, ' tail') AS line FROM r")
def obfuscate_lines(spark, sf_dir):
    lines = _lines(_keyed(spark, sf_dir), F.concat(F.lit("INFO "), _raw(), F.lit(" tail")))
    return obfuscate.lines(lines, _tables(spark)).select("line_no", "line")


@query(f"{_HIDE} SELECT k AS line_no, replace(concat(raw, ' tail'), chr(1), '|') AS line FROM r")
def obfuscate_delimited(spark, sf_dir):
    lines = _lines(_keyed(spark, sf_dir), F.concat(F.translate(_raw(), SOH, "|"), F.lit(" tail")))
    return obfuscate.lines(lines, _tables(spark), "|").select("line_no", "line")


@query(ORACLES["obfuscate_lines"])
def hide_files(spark, sf_dir):
    """Log files written by file, hidden as ranges of bytes that cut messages anywhere, and read back."""
    path = scratch(spark, "hide")
    lines = _lines(_keyed(spark, sf_dir), F.concat(F.lit("INFO "), _raw(), F.lit(" tail"))).repartition("file").sortWithinPartitions("file", "line_no")
    lines.select("file", F.col("line").alias("value")).write.partitionBy("file").text(f"{path}/log")
    obfuscate.files(spark, [f"{path}/log/*/*.txt"], _tables(spark), size=1 << 16)
    hidden = spark.read.text(f"{path}/log/*/*.secret.txt")
    return hidden.select(F.regexp_extract("value", f"{SOH}34=([0-9]+){SOH}", 1).cast("long").alias("line_no"), F.col("value").alias("line"))


@query(ORACLES["obfuscate_lines"])
def hide_stream(spark, sf_dir):
    """The lines as a stream in three batches, with aliases in the state store."""
    from tapeloom.streaming import carried

    path = scratch(spark, "hide-stream")
    lines = _lines(_keyed(spark, sf_dir), F.concat(F.lit("INFO "), _raw(), F.lit(" tail")))
    write = lambda rows, number: rows.select("line_no", "line").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    _in_batches(lines, path, lambda stream: carried.hide(stream, _tables(spark), write))
    return spark.read.parquet(f"{path}/out").select("line_no", "line")


# --- orders --------------------------------------------------------------------------------------------------------------


def _lifecycles(spark, sf_dir) -> DataFrame:
    """A new order, then a report for each of its line items; the last fills it."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), place.alias("n"), F.col("l_quantity").cast("int").alias("q"))
    sizes = items.groupBy("k").agg(F.max("n").alias("last"))
    new = sizes.select("k", F.lit(0).alias("n"), fix.encode("FIX.4.4", F.expr(f"concat('35=D{SOH}11=C', k, '{SOH}55=SYM', k % 50, '{SOH}54=1{SOH}')")).alias("line"))
    fill = items.join(sizes, "k").select("k", "n", fix.encode("FIX.4.4", F.expr(f"concat('35=8{SOH}37=O', k, '{SOH}11=C', k, '{SOH}150=F{SOH}39=', CASE WHEN n = last THEN '2' ELSE '1' END, '{SOH}32=', q, '{SOH}')")).alias("line"))
    lines = new.unionByName(fill).select(F.concat(F.lit("f"), (F.col("k") % 16).cast("string")).alias("file"), F.lit(0).alias("file_ordinal"), (F.col("k") * 1000 + F.col("n")).alias("line_no"), "line")
    return messages.parse(messages.extract(lines)).withColumn("dict_id", F.lit(_FIX44))


_LIFE = """WITH j AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, CAST(l_quantity AS INT) AS q FROM lineitem),
i AS (SELECT *, max(n) OVER (PARTITION BY k) AS last FROM j),
s AS (SELECT k, 0 AS n, 1 AS events, NULL AS q, FALSE AS terminal FROM i GROUP BY k UNION ALL SELECT k, n, n + 1, q, n = last FROM i)"""


@query(f"{_LIFE} SELECT k * 1000 + n AS line_no, concat('C', k) AS key, CAST(events AS BIGINT) AS events, CAST(q AS VARCHAR) AS last_quantity, CASE WHEN n = 0 THEN 'NewOrderSingle (D)' ELSE 'ExecutionReport (8)' END AS message, '1 (BUY)' AS side, concat('SYM', k % 50) AS symbol, terminal FROM s")
def order_summaries(spark, sf_dir):
    return orders.summaries(_lifecycles(spark, sf_dir), _tables(spark)).select("line_no", "key", "events", "last_quantity", "message", "side", "symbol", "terminal")


@query(f"{_LIFE} SELECT k AS order_key, CAST(max(events) AS BIGINT) AS events, CAST(arg_max(q, n) AS VARCHAR) AS last_quantity FROM s GROUP BY k")
def order_latest_state(spark, sf_dir):
    """The last state of each order where ids are not shared between orders: windows of the orders themselves, no fold."""
    own = _lifecycles(spark, sf_dir).select("line_no", fix.first_value("fields", 11).alias("id"), fix.blank_to_null(fix.first_value("fields", 32)).alias("q"))
    last = own.groupBy("id").agg(F.count("*").alias("events"), F.max_by("q", F.when(F.col("q").isNotNull(), F.col("line_no"))).alias("last_quantity"))
    return last.select(F.substr("id", F.lit(2)).cast("long").alias("order_key"), "events", "last_quantity")


@query(f"{_LIFE} SELECT terminal, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY terminal")
def order_terminal(spark, sf_dir):
    return _lifecycles(spark, sf_dir).select(orders.terminal("fields").alias("terminal")).groupBy("terminal").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS order_key, concat('A', o_orderkey) AS key, CAST(n AS BIGINT) AS events FROM orders, (VALUES (1), (2), (3)) AS t(n) UNION ALL SELECT o_orderkey, concat('B', o_orderkey), 1 FROM orders""")
def order_alias_chain(spark, sf_dir):
    """New, replaced under another id, cancelled under a third; then an old id starts a new order."""
    own = _keyed(spark, sf_dir)
    steps = [("35=D{s}11=A', k, '{s}", 0), ("35=G{s}41=A', k, '{s}11=B', k, '{s}", 1), ("35=8{s}37=X', k, '{s}11=Z', k, '{s}41=B', k, '{s}39=4{s}", 2), ("35=D{s}11=B', k, '{s}", 3)]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), fix.encode("FIX.4.4", F.expr("concat('" + text.replace("{s}", SOH) + "')")).alias("line")) for text, n in steps)))
    lines = own.select("k", rows.alias("x")).select(F.concat(F.lit("f"), (F.col("k") % 16).cast("string")).alias("file"), F.lit(0).alias("file_ordinal"), (F.col("k") * 10 + F.col("x.n")).alias("line_no"), "x.line")
    found = orders.summaries(messages.parse(messages.extract(lines)).withColumn("dict_id", F.lit(_FIX44)), _tables(spark))
    return found.select(F.floor(F.col("line_no") / 10).cast("long").alias("order_key"), "key", "events")


_BOUND = """WITH r AS (SELECT o_orderkey // 4 AS r, concat('f', o_orderkey % 4) AS file, o_orderkey AS k, (SELECT max(o_orderkey) // 4 FROM orders) AS last FROM orders)
SELECT file, r * 10 AS line_no, concat('C', k) AS key, CAST(1 AS BIGINT) AS events FROM r UNION ALL
SELECT file, CASE WHEN r % 2 = 0 THEN r * 10 + 105 ELSE r * 10 + 1005 END, concat(CASE WHEN r % 2 = 0 THEN 'C' ELSE 'O' END, k), CASE WHEN r % 2 = 0 THEN 2 ELSE 1 END FROM r WHERE r + 101 < last"""


def _bounded(spark, sf_dir) -> DataFrame:
    own = _keyed(spark, sf_dir).withColumn("r", F.expr("k div 4"))
    own = own.crossJoin(F.broadcast(own.agg(F.max("r").alias("last"))))  # one row
    new = F.struct((F.col("r") * 10).alias("line_no"), fix.encode("FIX.4.4", F.expr(f"concat('35=D{SOH}11=C', k, '{SOH}')")).alias("line"))
    fill = F.struct(F.expr("r * 10 + if(r % 2 = 0, 105, 1005)").alias("line_no"), fix.encode("FIX.4.4", F.expr(f"concat('35=8{SOH}37=O', k, '{SOH}11=C', k, '{SOH}39=1{SOH}')")).alias("line"))
    steps = F.when(F.expr("r + 101 < last"), F.array(new, fill)).otherwise(F.array(new))
    return own.select(F.concat(F.lit("f"), (F.col("k") % 4).cast("string")).alias("file"), F.explode(steps).alias("x")).select("file", F.lit(0).alias("file_ordinal"), "x.*")


def _in_batches(lines: DataFrame, path: str, writer: Callable[[DataFrame], DataStreamWriter], parts: int = 3) -> None:
    """Runs a stream over the lines in so many batches, by line numbers; between them it is stopped and goes on from its checkpoint."""
    last = lines.agg(F.max("line_no")).first()[0] or 0
    lines.withColumn("part", F.expr(f"line_no * {parts} div {last + 1}")).write.partitionBy("part").parquet(f"{path}/all")  # lines are made once
    every = lines.sparkSession.read.schema(StructType([*lines.schema, StructField("part", LongType())])).parquet(f"{path}/all")
    for i in range(parts):
        every.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = lines.sparkSession.readStream.schema(lines.schema).parquet(f"{path}/in")
        writer(stream).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


@query(_BOUND)
def order_bound(spark, sf_dir):
    """At most 50 open orders a stream: a fill after ten more orders finds its order, one after a hundred starts another under its OrderID."""
    found = orders.summaries(messages.parse(messages.extract(_bounded(spark, sf_dir))).withColumn("dict_id", F.lit(_FIX44)), _tables(spark), most_open=50)
    return found.select("file", "line_no", "key", "events")


@query(f"SELECT file, key, events FROM ({_BOUND})")
def order_stream(spark, sf_dir):
    """The same as a stream in three batches, with open orders in the state store."""
    path = scratch(spark, "order-stream")

    def told(lines: DataFrame) -> DataStreamWriter:
        found = orders.stream_summaries(messages.parse(messages.extract(lines)).withColumn("dict_id", F.lit(_FIX44)), _tables(spark), most_open=50)
        return found.select("file", "key", "events").writeStream.format("parquet").option("path", f"{path}/out")

    _in_batches(_bounded(spark, sf_dir), path, told)
    return spark.read.parquet(f"{path}/out")


# --- dictionaries ----------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (6, 'FIX44', '0', 58, 3, 12, 'built-in', TRUE), (9, 'FIX50SP2', '2', 4, 2, 1, 'custom.xml', FALSE), (10, 'FIXT11', '0', 71, 4, 8, 'built-in', FALSE)) AS t(ordinal, key, service_pack, fields, components, messages, source, selected)")
def dict_info(spark, sf_dir):
    own = registry()
    return explore.info(spark, own, own.resolve())


@query("SELECT * FROM (VALUES (98, '0', '0', 'NONE_OTHER'), (98, '1', '1', 'PKCS'), (98, '2', '2', 'DES'), (98, '3', '3', 'PKCSDES'), (98, '4', '4', 'PGPDES'), (98, '5', '5', 'PGPDESMD5'), (98, '6', '6', 'PEMDESMD5')) AS t(tag, value, padded, description)")
def dict_enums(spark, sf_dir):
    return explore.enums(spark, registry().resolve("FIXT11"), 98)


@query("SELECT * FROM (VALUES ('Heartbeat', '0', 'admin'), ('Logon', 'A', 'admin'), ('Logout', '5', 'admin'), ('Reject', '3', 'admin'), ('ResendRequest', '2', 'admin'), ('SequenceReset', '4', 'admin'), ('TestRequest', '1', 'admin'), ('XMLnonFIX', 'n', 'admin')) AS t(name, msg_type, category)")
def dict_messages(spark, sf_dir):
    return explore.messages(spark, registry().resolve("FIXT11"))


@query("SELECT * FROM (VALUES ('HopGrp'), ('MsgTypeGrp')) AS t(name)")
def dict_components(spark, sf_dir):
    return explore.components(spark, registry().resolve("FIXT11"))


@query("SELECT 1128 AS tag, 'ApplVerID' AS name, 'STRING' AS type")
def dict_tag(spark, sf_dir):
    return explore.tags(spark, registry().resolve("FIXT11"), 1128)


@query("""SELECT * FROM (VALUES (0, 0, 4, 'group', 453, 'NoPartyIDs', 'NUMINGROUP', FALSE), (1, 1, 10, 'field', 448, 'PartyID', 'STRING', FALSE), (2, 1, 10, 'field', 447, 'PartyIDSource', 'CHAR', FALSE), (3, 1, 10, 'field', 452, 'PartyRole', 'INT', FALSE),
(4, 1, 10, 'group', 802, 'NoPartySubIDs', 'NUMINGROUP', FALSE), (5, 2, 16, 'field', 523, 'PartySubID', 'STRING', FALSE), (6, 2, 16, 'field', 803, 'PartySubIDType', 'INT', FALSE)) AS t(ordinal, depth, indent, kind, tag, name, type, required)""")
def dict_component(spark, sf_dir):
    return explore.expanded(spark, registry().resolve(), "Parties", "component")


@query("SELECT * FROM (VALUES (0, 0, 8, 'field', 7, 'BeginSeqNo', 'SEQNUM', TRUE), (1, 0, 8, 'field', 16, 'EndSeqNo', 'SEQNUM', TRUE)) AS t(ordinal, depth, indent, kind, tag, name, type, required)")
def dict_message(spark, sf_dir):
    return explore.expanded(spark, registry().resolve("FIXT11"), "ResendRequest")


@query("SELECT * FROM (VALUES (8, 0, TRUE, FALSE), (35, 1, TRUE, FALSE), (5001, 2, TRUE, TRUE), (5002, 3, FALSE, FALSE)) AS t(tag, ord, required, dup_ok)")
def dict_shape(spark, sf_dir):
    return _tables(spark).shape.where(F.col("dict_id") == _CUSTOM).select("tag", "ord", "required", "dup_ok")


# --- streams -------------------------------------------------------------------------------------------------------------


@query(f"SELECT date_trunc('day', o_orderdate) AS day, '8' AS msg_type, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    """Reports read as a stream, counted by day of SendingTime, written by the stream and read back."""
    from tapeloom.streaming import windows

    schema = table(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parque[t]")
    own = stream.withColumn("k", F.col("o_orderkey")).withColumn("s", F.expr(_STATUS))
    parsed = messages.parse(messages.extract(_lines(own, _raw())))
    counted = windows.counts(parsed, "1 day", "1 day").select(F.col("window.start").alias("day"), "msg_type", "n")
    path = scratch(spark, "stream")
    job = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(f"{_R} SELECT k AS o_orderkey, raw FROM r")
def follow_messages(spark, sf_dir):
    """Reports written as log files, followed as a stream in several batches that cut lines anywhere, written by the stream and read back."""
    from tapeloom.streaming import tail

    path = scratch(spark, "follow")
    _keyed(spark, sf_dir).select(F.concat(F.lit("note "), _raw(), F.lit(" end")).alias("value")).write.text(f"{path}/log")
    found = tail.follow_messages(spark, f"{path}/log/*.txt", maxBytes=str(1 << 18)).select(fix.first_value("fields", 34).cast("long").alias("o_orderkey"), "raw")
    job = found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").start(f"{path}/out")
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    return spark.read.parquet(f"{path}/out")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract, parse, choose the dictionary, validate and count: messages and errors by bucket, type and status."""
    tables = _tables(spark)
    own = _mutants(spark, sf_dir)
    told = validate.errors(own, tables).groupBy(*messages.KEYS).agg(F.count("*").alias("errors"))
    shown = counts.described(own, tables).withColumn("status", fix.first_value("fields", 39)).join(told, messages.KEYS, "left")
    return shown.groupBy("bucket", "msg_type", "label", "status").agg(F.count("*").alias("n"), F.count("errors").alias("invalid"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))


ENTRY_SQL = f"""{_ERRORS}, t AS (SELECT k, count(*) AS errors FROM e GROUP BY k)
SELECT 'Business' AS bucket, '8' AS msg_type, 'ExecutionReport' AS label, s AS status, CAST(count(*) AS BIGINT) AS n, CAST(count(errors) AS BIGINT) AS invalid, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors FROM r LEFT JOIN t USING (k) GROUP BY s"""
QUERIES["validated_counts"], ORACLES["validated_counts"] = entry, ENTRY_SQL
