"""Counts over event time: SendingTime as the clock, with a watermark for late messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import fix


def with_time(messages: DataFrame, tag: int = 52) -> DataFrame:
    """With sent, the time of a valid timestamp field; null where it is none."""
    value = fix.first_value("fields", tag)
    return messages.withColumn("sent", F.when(fix.is_timestamp(value), F.try_to_timestamp(F.concat(F.substring(value, 1, 8), F.lit(" "), F.substring(value, 10, 8)), F.lit("yyyyMMdd HH:mm:ss"))))


def counts(messages: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Messages by window of SendingTime and MsgType; in a stream, windows close once the watermark is past them."""
    timed = with_time(messages).where("sent IS NOT NULL").withWatermark("sent", late)
    return timed.groupBy(F.window("sent", width), fix.first_value("fields", 35).alias("msg_type")).agg(F.count("*").alias("n"))
