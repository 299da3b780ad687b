"""Message counts by bucket and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import fix
from tapeloom.operators.dictionary import Tables

ADMIN, BUSINESS, UNKNOWN = "Session/Admin", "Business", "Unknown"


def described(messages: DataFrame, tables: Tables) -> DataFrame:
    """With msg_type (Unknown where there is none), bucket and label."""
    own = messages.withColumn("lookup", fix.first_value("fields", 35))
    names = F.broadcast(tables.messages.select("dict_id", "lookup", F.col("name").alias("label"), "category"))
    bucket = F.when(F.col("category").isNull(), F.lit(UNKNOWN)).when(F.lower("category") == "admin", F.lit(ADMIN)).otherwise(F.lit(BUSINESS))
    joined = own.join(names, ["dict_id", "lookup"], "left")
    return joined.withColumn("bucket", bucket).withColumn("msg_type", F.coalesce("lookup", F.lit(UNKNOWN))).drop("lookup", "category")


def count(rows: DataFrame, position: list[str]) -> DataFrame:
    """bucket, msg_type, n, label of the first, and first (a struct of the position columns). Partial sums merge by themselves."""
    at = F.struct(*position)
    return rows.groupBy("bucket", "msg_type").agg(F.count("*").alias("n"), F.min_by("label", at).alias("label"), F.min(at).alias("first"))


def merge(parts: DataFrame) -> DataFrame:
    """Counts of several inputs as one, the first of the earliest counting."""
    return parts.groupBy("bucket", "msg_type").agg(F.sum("n").alias("n"), F.min_by("label", "first").alias("label"), F.min("first").alias("first"))


def ordered(counted: DataFrame) -> DataFrame:
    """By bucket, then as first seen."""
    place = F.when(F.col("bucket") == ADMIN, 0).when(F.col("bucket") == BUSINESS, 1).otherwise(2)
    return counted.orderBy(place, "first")


def lines(counted: DataFrame) -> DataFrame:
    """The table's rows as text, in order."""
    return ordered(counted).select("bucket", F.format_string("%-18s %7d  %s", "msg_type", "n", F.coalesce("label", F.lit(""))).alias("rendered"))
