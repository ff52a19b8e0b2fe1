"""The change log: append with dedup and sequence, pending entries, the fold to a net delta, and snapshot diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialise


def _key_part(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(fallback))


def keyed(changes: DataFrame) -> DataFrame:
    """changes (event_type, src, rel, dst, source, batch_id, idempotency_key, position) with their dedup_key."""
    parts = [_key_part(F.col("source"), "api"), _key_part(F.col("batch_id"), ""), _key_part(F.col("idempotency_key"), ""), F.col("event_type"), F.col("src"), F.col("rel"), F.col("dst"), F.col("position").cast("string")]
    return changes.withColumn("dedup_key", F.concat_ws("|", *parts))


def append(log: DataFrame, changes: DataFrame, last_seq: int = 0) -> DataFrame:
    """New entries with their sequence numbers: positions after last_seq, also used up by changes the log has already.

    changes: one request, as in keyed(), with metadata and created_at. Positions of a request run from 0.
    """
    fresh = keyed(changes).withColumn("change_seq", F.lit(last_seq) + 1 + F.col("position").cast("long"))
    first = Window.partitionBy("dedup_key").orderBy("change_seq")
    fresh = fresh.withColumn("place", F.row_number().over(first)).where("place = 1")
    # What the log has of the request's keys: a small request is broadcast, and the log is not shuffled.
    known = log.select("dedup_key").join(fresh.select("dedup_key"), "dedup_key", "left_semi")
    kept = fresh.join(known, "dedup_key", "left_anti")
    names = ("change_seq", "event_type", "src", "rel", "dst", "source", "batch_id", "idempotency_key", "metadata", "dedup_key", "created_at")
    return kept.select(*names)


def numbered(rows: DataFrame, start: int, *order: str) -> DataFrame:
    """rows with change_seq start + 1, start + 2, ... in order, without a task that sees them all.

    Rows are dealt by range and written; the sizes of the ranges, a row for each, say where a range's numbers begin.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "range").withColumn("change_seq", F.lit(start) + F.col("before") + place).drop("range", "before")  # starts: a row a range


def sequenced(log: DataFrame, last_seq: int = 0) -> DataFrame:
    """log with numbers after the last one given out for entries that have none, by time."""
    missing = log.where(F.col("change_seq").isNull())
    last = max(last_seq, log.agg(F.max("change_seq")).first()[0] or 0)
    return log.where(F.col("change_seq").isNotNull()).unionByName(numbered(missing, last, "created_at", "dedup_key").select(*log.columns))


def pending(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The first limit entries after the cursor, in sequence."""
    return log.where(F.col("change_seq") > cursor).orderBy("change_seq").limit(limit)


def folded(entries: DataFrame) -> DataFrame:
    """(src, rel, dst, state) with state added, removed or cancelled.

    An add followed by a remove cancels; a remove followed by an add is an add; otherwise the last operation counts.
    Aggregates only: the last add, then a count of the removes after it, so a key of many changes needs no list.
    """
    key = ["src", "rel", "dst"]
    added = F.max(F.when(F.col("event_type") == "added", F.col("change_seq"))).over(Window.partitionBy(*key))
    marked = entries.select(*key, "event_type", "change_seq").withColumn("last_add", added)
    late = F.count_if((F.col("event_type") == "removed") & (F.col("change_seq") > F.col("last_add"))).alias("late")
    states = marked.groupBy(*key).agg(F.max("last_add").alias("last_add"), late)
    state = F.when(F.col("last_add").isNull(), "removed").when(F.col("late") == 0, "added").when(F.col("late") == 1, "cancelled").otherwise("removed")
    return states.select(*key, state.alias("state"))


def delta(entries: DataFrame) -> DataFrame:
    """(src, rel, dst, op): the folded entries that leave something."""
    return folded(entries).where(F.col("state") != "cancelled").withColumnRenamed("state", "op")


def affected_relations(entries: DataFrame) -> DataFrame:
    """(rel) of the delta, in order."""
    return delta(entries).select("rel").where("rel <> ''").distinct().orderBy("rel")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event_type, src, rel, dst, idempotency_key) that turn old into new; edges are told apart by eid.

    Each edge has one key for its addition and one for its removal, so a diff taken twice appends nothing.
    """
    columns = ["eid", "src", "rel", "dst"]
    added = new.select(*columns).join(old.select("eid"), "eid", "left_anti").withColumn("event_type", F.lit("added"))
    removed = old.select(*columns).join(new.select("eid"), "eid", "left_anti").withColumn("event_type", F.lit("removed"))
    short = F.when(F.col("event_type") == "added", "add").otherwise("remove")
    return added.unionByName(removed).select("event_type", "src", "rel", "dst", F.concat_ws("|", F.lit("trigger"), short, F.col("eid").cast("string")).alias("idempotency_key"))
