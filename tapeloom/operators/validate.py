"""Validation of messages against their dictionaries, in one pass and without a shuffle.

What concerns a message as a whole is found on its own row, then it becomes one row a field, for what concerns that, and
one more if it has errors as a whole. The dictionary's tables and the message's shape come by broadcast joins, one of
messages and one of fields; fields that are right are dropped before errors are made. Errors only meet where they are
gathered by message.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import fix
from tapeloom.operators.dictionary import Tables
from tapeloom.operators.messages import KEYS, each

ERROR = "phase int, place int, tag int, error string, absent boolean"
_ERRORS = f"array<struct<{ERROR.replace(' ', ':').replace(',:', ',')}>>"


def _text(tag: Column) -> Column:
    return tag.cast("string")


def _error(phase: int, place: Column, tag: Column, text: Column) -> Column:
    """absent: whether the message lacks the tag; a field's own never is, of a message's errors it is found for all at once."""
    return F.struct(F.lit(phase).alias("phase"), place.cast("int").alias("place"), tag.cast("int").alias("tag"), text.alias("error"), F.lit(False).alias("absent"))


def _checks() -> list[tuple[Column, Column]]:
    """(whether a field has it, its text) of unknown tags, values that are no enum's, and values of each wrong form."""
    tag, value, kind = _text(F.col("tag")), F.col("value"), F.col("type")
    wrong = lambda what: F.concat(F.lit(f"Invalid {what} "), value, F.lit(" for tag "), tag)
    number = kind.isin("INT", "SEQNUM", "NUMINGROUP", "LENGTH")
    return [
        (kind.isNull(), F.concat(F.lit("Unknown tag "), tag, F.lit(" in "), F.col("key"))),
        (F.col("listed").isNotNull() & ~F.array_contains("listed", value), wrong("enum value")),
        (number & ~fix.is_integer(value), F.when(fix.blank(value), F.concat(F.lit("Invalid numeric value for tag "), tag)).otherwise(wrong("numeric value"))),
        ((kind == "BOOLEAN") & ~fix.is_boolean(value), wrong("BOOLEAN value")),
        ((kind == "UTCTIMESTAMP") & ~fix.is_timestamp(value), wrong("UTCTIMESTAMP value")),
        (kind.isin("LOCALMKTDATE", "UTCDATEONLY") & ~fix.is_date(value), wrong("date value")),
    ]


def _of_field(checks: list[tuple[Column, Column]]) -> Column:
    """The errors of a field: phase 1, in the order of fields; its type has one form at most."""
    texts = [F.when(has, text) for has, text in checks]
    return F.array(*(_error(1, F.col("field_idx") * 3 + i, F.col("tag"), text) for i, text in enumerate((*texts[:2], F.coalesce(*texts[2:])))))


def _late(tags: Column) -> Column:
    """The tags with a place in the message's order that stand behind one of a later place, by one walk that carries the furthest place."""
    placed = F.filter(F.transform(tags, lambda t: F.struct(t.alias("t"), F.array_position("order", t).alias("p"))), lambda x: x["p"] > 0)
    start = F.struct(F.lit(0).cast("bigint").alias("far"), F.array().cast("array<int>").alias("late"))
    step = lambda acc, x: F.struct(F.greatest(acc["far"], x["p"]).alias("far"), F.when(x["p"] < acc["far"], F.concat(acc["late"], F.array(x["t"]))).otherwise(acc["late"]).alias("late"))
    return F.aggregate(placed, start, step, lambda acc: acc["late"])


def _of_message() -> Column:
    """Duplicates (2), missing MsgType or required tags (3), order (4), body length (5) and checksum (6); tags and twice: the
    message's tags and those met again."""
    tags, twice, known, kind = F.col("tags"), F.col("twice"), F.col("known").isNotNull(), F.col("lookup")
    none = F.array().cast(_ERRORS)
    told = lambda phase, own, tag, text: F.transform(own, lambda x, i: _error(phase, i, tag(x), text(x)))
    duplicates = told(2, F.array_except(twice, F.coalesce("repeats", F.array().cast("array<int>"))), lambda t: t, lambda t: F.concat(F.lit("Duplicate tag "), _text(t), F.lit(" encountered")))
    missing_type = F.array(_error(3, F.lit(0), F.lit(35), F.when(kind.isNull(), F.lit("Missing required tag 35 (MsgType)")).otherwise(F.concat(F.lit("Unknown MsgType: "), kind))))
    required = told(3, F.filter("required", lambda r: ~F.array_contains(tags, r["tag"])), lambda r: r["tag"], lambda r: F.concat(F.lit("Missing required tag "), _text(r["tag"]), F.lit(" ("), r["name"], F.lit(")")))
    order = told(4, _late(tags), lambda t: t, lambda t: F.concat(F.lit("Tag "), _text(t), F.lit(" appears out of dictionary order")))
    length, stated = fix.expected_length("raw"), fix.int_value(fix.last_value("fields", 9))
    body = F.when(~fix.has_tag("fields", 9), F.lit("Missing required tag 9 (BodyLength)")).when(length.isNotNull() & (stated != length), F.concat(F.lit("BodyLength mismatch: got "), _text(stated), F.lit(", expected "), _text(length)))
    check, given = F.col("checksum"), fix.int_value(fix.last_value("fields", 10))
    total = F.when(~fix.has_tag("fields", 10), F.lit("Missing required tag 10 (CheckSum)")).when(check.isNotNull() & (given != check), F.concat(F.lit("Checksum mismatch: got "), fix.digits(given, 3), F.lit(", expected "), fix.digits(check, 3)))
    parts = duplicates, F.when(~known, missing_type).otherwise(F.coalesce(required, none)), F.when(known & (F.size(twice) == 0), F.coalesce(order, none)).otherwise(none)
    return F.concat(*parts, F.array(_error(5, F.lit(0), F.lit(9), body), _error(6, F.lit(0), F.lit(10), total)))


def errors(messages: DataFrame, tables: Tables, keys: list[str] = KEYS) -> DataFrame:
    """Every error of messages with raw, fields and dict_id: keys, phase, place, tag, error; phase and place give a message's order of report."""
    return told(messages, tables, keys).drop("dict_id", "absent")


def told(messages: DataFrame, tables: Tables, keys: list[str] = KEYS) -> DataFrame:
    """errors() with the message's dict_id and absent, whether it lacks the tag, as seen where it is checked."""
    tags = F.col("tags")
    again = F.filter(F.transform(tags, lambda t, i: F.when(F.array_position(tags, t) < i + 1, t)), lambda t: t.isNotNull())
    twice = F.when(F.size(F.array_distinct(tags)) < F.size(tags), F.array_distinct(again)).otherwise(F.array().cast("array<int>"))
    own = messages.select(*keys, "dict_id", "raw", "fields", fix.expected_checksum("raw").cast("int").alias("checksum"), fix.last_value("fields", 35).alias("lookup"))
    own = own.withColumn("tags", F.transform("fields", lambda f: f["tag"])).withColumn("twice", twice)
    own = own.join(F.broadcast(tables.keys), "dict_id", "left").join(F.broadcast(tables.shapes.withColumn("known", F.lit(True))), ["dict_id", "lookup"], "left")
    lacking = lambda e: F.struct(*(e[c].alias(c) for c in ("phase", "place", "tag", "error")), (~F.coalesce(F.array_contains(tags, e["tag"]), F.lit(False))).alias("absent"))
    own = own.select(*keys, "dict_id", "key", "fields", F.transform(F.filter(_of_message(), lambda e: e["error"].isNotNull()), lacking).alias("whole"))
    row = lambda tag, value, whole: F.struct(tag.cast("int").alias("tag"), value.cast("string").alias("value"), whole.cast(_ERRORS).alias("whole"))
    nothing = F.lit(None)
    rows = F.concat(F.transform("fields", lambda f: row(f["tag"], f["value"], nothing)), F.filter(F.array(row(nothing, nothing, F.col("whole"))), lambda x: F.size(x["whole"]) > 0))
    own = each(own, [*keys, "dict_id", "key"], rows, "field_idx", "x").select(*keys, "dict_id", "key", "field_idx", "x.*")
    own = own.join(F.broadcast(tables.checks), ["dict_id", "tag"], "left")
    checks = _checks()
    wrong = own.where(F.col("whole").isNotNull() | reduce(or_, (F.coalesce(has, F.lit(False)) for has, _ in checks)))
    found = F.coalesce("whole", F.filter(_of_field(checks), lambda e: e["error"].isNotNull()))
    return each(wrong, [*keys, "dict_id"], found, "_at", "e").select(*keys, "dict_id", "e.*")


def joined(found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """n_errors and all errors of a message as one text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("phase", "place", "error"))), lambda e: e["error"])
    return found.groupBy(*keys).agg(F.count("*").alias("n_errors"), F.array_join(listed, "; ").alias("errors"))


def by_tag(found: DataFrame, keys: list[str] = KEYS, more: list[str] = ()) -> DataFrame:
    """All errors of a message's tag as one text, and where the first stands."""
    one = F.struct("phase", "place", "error")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda e: e["error"])
    return found.groupBy(*keys, *more, "tag").agg(F.min(F.struct("phase", "place")).alias("first"), F.array_join(listed, "; ").alias("errors"))
