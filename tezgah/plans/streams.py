"""Queries that run as streams over all files that are there."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tezgah.session import shared_dir
from tezgah.streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/slot_events.parquet"
    return events.event_stream(spark, path if os.path.isdir(path) else f"{d}/slot_events*.parquet")


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.drain(events.windowed_counts(_stream(spark, d)))


def stream_slot_state(spark: SparkSession, d: str) -> DataFrame:
    s = events.stream_state(_stream(spark, d), f"{shared_dir(spark)}/state-{uuid.uuid4().hex[:12]}")
    return s.select("slot_id", F.col("event_type").alias("state"), F.col("created_at").alias("since"))


QUERIES |= {"stream_event_counts": stream_event_counts, "stream_slot_state": stream_slot_state}
SQL["stream_event_counts"] = "select date_trunc('day', created_at) as start, event_type, count(*) as n from (select distinct event_id, event_type, created_at from slot_events where created_at is not null) group by all"
SQL["stream_slot_state"] = "select slot_id, event_type as state, created_at as since from (select *, row_number() over (partition by slot_id order by created_at desc nulls last, event_id desc, event_type desc nulls last) as i from (select distinct slot_id, event_id, event_type, created_at from slot_events where slot_id is not null)) where i = 1"
