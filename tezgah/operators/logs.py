"""State from append logs: latest record, deduplication, upsert, state by event, stale reservations, anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first). An aggregation with partial results: a key with a third of all rows is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    v = F.max(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.struct(*rest).alias("r"))).alias("v")
    return rows.groupBy(*keys).agg(v).select(*keys, *[F.col(f"v.r.{c}").alias(c) for c in rest])


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    v = F.min(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.struct(*rest).alias("r"))).alias("v")
    return rows.groupBy(*keys).agg(v).select(*keys, *[F.col(f"v.r.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The table with the changes: of equal keys the row with the greatest ``at``; among equal ones the change."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, [at, "_new"]).drop("_new")


def state(events: DataFrame) -> DataFrame:
    """Of each slot: its last state, how often it was reserved, and when it was last reserved, from its distinct events (``event_id, slot_id, event_type,
    created_at``). The order is that of ``created_at``, then ``event_id``."""
    e = events.where("slot_id is not null").select("event_id", "slot_id", "event_type", "created_at").distinct()
    last = F.max(F.struct("created_at", "event_id", "event_type")).alias("l")
    return e.groupBy("slot_id").agg(last, F.count("*").alias("events"), F.count_if(F.col("event_type") == "reserved").alias("reservations"), F.max(F.when(F.col("event_type") == "reserved", F.col("created_at"))).alias("reserved_at")).select("slot_id", F.col("l.event_type").alias("state"), F.col("l.created_at").alias("since"), "events", "reservations", "reserved_at")


def stale(states: DataFrame, seconds: int, now: F.Column) -> DataFrame:
    """Slots still reserved, for longer than ``seconds`` before ``now``."""
    return states.where((F.col("state") == "reserved") & (F.col("reserved_at") < now - F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)"))))


def occurrence_rank(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """How many earlier rows have the same value."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
