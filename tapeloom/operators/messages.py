"""From log lines to messages with fields, and the long form of one row a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import fix

KEYS = ["file", "line_no", "msg_idx"]


def each(df: DataFrame, kept: list[str], array: Column, at: str, item: str) -> DataFrame:
    """kept, the place and the item of each of an array's items, none of which is null.

    The array is made in a projection of its own, and arrays without items are dropped after, so that it is made once:
    else it is made in the generator, step by step, and once more in a filter that Spark infers for it.
    """
    own = df.select(*kept, array.alias("_array"))
    return own.select(*kept, F.posexplode_outer("_array").alias(at, item)).where(F.col(item).isNotNull())


def extract(lines: DataFrame, delim: str = fix.SOH) -> DataFrame:
    """The lines' columns but the line, msg_idx and raw of each complete message. Lines without a start are passed over first.

    That is no filter, which Spark would move to where a line is made, to make it once more.
    """
    others = [c for c in lines.columns if c != "line"]
    return each(lines, others, F.when(F.contains("line", F.lit(fix.BEGIN)), fix.messages("line", delim)), "msg_idx", "raw")


def parse(messages: DataFrame) -> DataFrame:
    """With fields, an array of (tag, value) in order."""
    return messages.withColumn("fields", fix.fields("raw"))


def explode(messages: DataFrame) -> DataFrame:
    """One row a field: field_idx, tag, value."""
    others = [c for c in messages.columns if c not in ("fields", "raw")]
    return each(messages, others, F.col("fields"), "field_idx", "f").select(*others, "field_idx", "f.tag", "f.value")
