"""Which dictionary each message of a stream is read by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import fix
from tapeloom.operators.dictionary import Tables
from tapeloom.session import cut
from tapeloom.sources.builtin import APPL_VERSIONS


def application_key(value: Column) -> Column:
    """An ApplVerID as the applications table has it."""
    clean = F.upper(F.trim(value))
    return F.when(clean.isin(*APPL_VERSIONS), clean).when(clean != "", fix.version(clean))


#: Lines of a block, within which a message's version is looked up; the most changes and blocks that are broadcast.
BLOCK, MOST = 1 << 16, 1 << 20


def negotiated(messages: DataFrame, tables: Tables, stream: list[str], order: list[str], carried: DataFrame | None = None) -> DataFrame:
    """With negotiated: the dictionary of the last resolvable tag 1137 of the stream so far, this message's included.

    Only messages that change it are gathered, by blocks of lines (order begins with the line's number); each block starts
    from what the blocks before it left. Messages themselves stay where they are, so a single file is read by as many
    tasks as it has parts; with more changes or blocks than MOST they are joined by shuffle. Finding the changes runs at once.
    carried: stream and carried, what was negotiated before these messages.
    """
    block, place = F.floor(F.col(order[0]) / BLOCK).alias("_block"), F.struct(*order)
    applications = F.broadcast(tables.applications.select(F.col("version").alias("_k"), F.col("dict_id").alias("_d")))
    maybe = messages.where(F.contains("raw", F.lit("1137="))) if "raw" in messages.columns else messages  # most are never parsed for it
    told = maybe.select(*stream, *order, application_key(fix.first_value("fields", 1137)).alias("_k")).where("_k IS NOT NULL").join(applications, "_k")
    changes = cut(told.groupBy(*stream, block).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "_d"))).alias("_list")))
    n = changes.agg(F.coalesce(F.sum(F.size("_list")), F.lit(0))).first()[0]
    none = F.lit(None).cast("string")
    if n:
        w = Window.partitionBy(*stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = messages.select(*stream, block).distinct().join(changes, [*stream, "_block"], "left")
        blocks = cut(blocks.withColumn("_carry", F.last(F.element_at("_list", -1)["_d"], ignorenulls=True).over(w)).where("_carry IS NOT NULL OR _list IS NOT NULL"))
        few = n + blocks.count() <= MOST
        inside = F.try_element_at(F.filter("_list", lambda x: x["at"] <= place), F.lit(-1))["_d"]
        own = messages.withColumn("_block", block).join(F.broadcast(blocks) if few else blocks, [*stream, "_block"], "left")
        found = own.withColumn("negotiated", F.coalesce(inside, "_carry")).drop("_block", "_list", "_carry")
    else:
        found = messages.withColumn("negotiated", none)
    return found if carried is None else found.join(carried, stream, "left").withColumn("negotiated", F.coalesce("negotiated", "carried")).drop("carried")


def choose(messages: DataFrame, tables: Tables, fallback: str, stream: list[str] = ("file",), order: list[str] = ("line_no", "msg_idx"), carried: DataFrame | None = None) -> DataFrame:
    """With dict_id, the first that holds of: a BeginString of no transport version names it; the transport dictionary
    has the MsgType; tag 1128 names it; an earlier 1137 did; the fallback.

    messages: with fields. fallback: a dict_id.
    """
    begin, kind = F.col("_begin"), F.col("_type")
    own = negotiated(messages, tables, list(stream), list(order), carried).withColumn("_begin", fix.first_value("fields", 8)).withColumn("_type", fix.first_value("fields", 35)).withColumn("_a", application_key(fix.first_value("fields", 1128)))
    own = own.withColumn("_key", fix.begin_string_key(begin))
    catalog = F.broadcast(tables.catalog.select(F.col("key").alias("_key"), F.col("dict_id").alias("_named")))
    applications = F.broadcast(tables.applications.select(F.col("version").alias("_a"), F.col("dict_id").alias("_stated")))
    session = F.broadcast(tables.messages.select(F.col("dict_id").alias("_named"), F.col("lookup").alias("_type"), F.lit(True).alias("_own")))
    joined = own.join(catalog, "_key", "left").join(applications, "_a", "left").join(session, ["_named", "_type"], "left")
    transport = F.coalesce(begin.startswith("FIXT."), F.lit(False))
    chosen = F.when(~transport, F.coalesce("_named", F.lit(fallback))).when(F.coalesce("_own", F.lit(False)), F.col("_named")).otherwise(F.coalesce("_stated", "negotiated", F.lit(fallback)))
    return joined.withColumn("dict_id", chosen).drop("_key", "_named", "_a", "_stated", "_own", "_begin", "_type")
