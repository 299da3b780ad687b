"""Decoded fields and the text lines that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import validate
from tapeloom.operators.dictionary import Tables
from tapeloom.operators.messages import KEYS, each, explode


def _described(rows: DataFrame, tables: Tables) -> DataFrame:
    """Rows of dict_id, tag and value with name, type and description."""
    return rows.join(F.broadcast(tables.fields.drop("has_enums")), ["dict_id", "tag"], "left").join(F.broadcast(tables.enums), ["dict_id", "tag", "value"], "left")


def fields(messages: DataFrame, tables: Tables, keys: list[str] = KEYS) -> DataFrame:
    """field_idx, tag, name (the number where unknown), type, value, description of every field, by broadcast joins."""
    own = _described(explode(messages.select(*keys, "dict_id", "fields")), tables)
    return own.select(*keys, "dict_id", "field_idx", "tag", F.coalesce("name", F.col("tag").cast("string")).alias("name"), "type", "value", "description")


def _line(tag="tag", name="name", value="value"):
    return F.format_string("%6d (%s): %s", tag, name, value)


def lines(messages: DataFrame, tables: Tables, found: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """at and rendered: each message's raw text, an empty line, its fields with their errors, and errors of tags that it lacks.

    found: errors by validate.told() or errors(), or None to show none. Lines of a message are ordered by at. A message
    meets its errors before it becomes lines.
    """
    row = lambda at, tag, value, text, said: F.struct(F.lit(at).cast("long").alias("at"), F.lit(tag).cast("int").alias("tag"), F.lit(value).cast("string").alias("value"), F.lit(text).cast("string").alias("text"), F.lit(said).cast("string").alias("said"))
    said = lambda tag: None
    if found is not None:
        own = F.map_from_entries(F.collect_list(F.struct("tag", "errors"))).alias("_said")
        messages = messages.join(validate.by_tag(found, keys).groupBy(*keys).agg(own), keys, "left")
        said = lambda tag: F.try_element_at("_said", tag)
    own = F.coalesce(F.transform("fields", lambda f, i: row(i, f["tag"], f["value"], None, said(f["tag"]))), F.array().cast("array<struct<at:bigint,tag:int,value:string,text:string,said:string>>"))
    rows = F.concat(F.array(row(-2, None, None, F.col("raw"), None), row(-1, None, None, "", None)), own, F.array(row(1 << 62, None, None, "", None)))
    shown = _described(each(messages, [*keys, "dict_id"], rows, "_at", "x").select(*keys, "dict_id", "x.*"), tables)
    text = F.concat(_line(name=F.coalesce("name", F.col("tag").cast("string"))), F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.concat(F.lit(" ("), "description", F.lit(")"))).otherwise(F.lit("")), F.coalesce(F.concat(F.lit("  "), "said"), F.lit("")))
    shown = shown.select(*keys, "at", F.when(F.col("tag").isNull(), F.col("text")).otherwise(text).alias("rendered"))
    if found is None:
        return shown
    if "absent" not in found.columns:
        has = F.array_contains(F.transform("fields", lambda f: f["tag"]), F.col("tag"))
        found = found.join(messages.select(*keys, "dict_id", "fields"), keys).withColumn("absent", ~F.coalesce(has, F.lit(False)))
    return shown.unionByName(absent(found, tables, keys))


def absent(found: DataFrame, tables: Tables, keys: list[str] = KEYS) -> DataFrame:
    """at and rendered: the lines of errors whose tags a message lacks, of errors by validate.told(). No other error and no message is moved for them."""
    own = validate.by_tag(found.where("absent"), keys, ["dict_id"])
    named = own.join(F.broadcast(tables.fields.select("dict_id", "tag", "name")), ["dict_id", "tag"], "left")
    at = F.lit(1 << 40) + F.col("first.phase").cast("long") * (1 << 30) + F.col("first.place")
    return named.select(*keys, at.alias("at"), _line(name=F.coalesce("name", F.col("tag").cast("string")), value="errors").alias("rendered"))


def line_prefixes(found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For messages with errors: `Line n: ` and their errors, as summaries show them."""
    return validate.joined(found, keys).select(*keys, F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": "), "errors").alias("rendered"))
