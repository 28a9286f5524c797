"""Event logs as streams: deduplicated counts, latest state per slot, idempotent upserts. The same results as the batch operators of ``operators.logs``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tezgah.operators import logs
from tezgah.session import shared_dir

EVENTS = "event_id bigint, slot_id string, event_type string, actor string, payload_json string, created_at timestamp"


def event_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Parquet files of the event log as a stream, at most ``files`` a batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "365 days") -> DataFrame:
    """Distinct events per window and type. Events later than ``late`` are dropped by the watermark, which also bounds the state."""
    e = events.where("created_at is not null").withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy(F.window("created_at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and gives its result as a table in the shared folder: for complete mode the last batch,
    for append mode all of them. Offsets and state lie in the shared folder too, so that a restart goes on where it stopped."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def stream_state(events: DataFrame, base: str) -> DataFrame:
    """Latest event per slot, kept as a table under ``base``: each batch is reduced to its latest rows and merged with the table of the batch before.
    A batch that is run again writes the same version again."""
    spark = events.sparkSession
    columns = ["slot_id", "created_at", "event_id", "event_type"]

    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/version-*")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def last() -> int:
        """The greatest version that is there, -1 without any."""
        return max((int(f.getPath().getName().rpartition("-")[2]) for f in fs.globStatus(fs_path) or []), default=-1)

    def merge(batch: DataFrame, n: int) -> None:
        new = logs.latest(batch.where("slot_id is not null").select(*columns), ["slot_id"], ["created_at", "event_id", "event_type"])
        if n:
            old = spark.read.schema(new.schema).parquet(f"{base}/version-{n - 1}")
            new = logs.latest(old.unionByName(new), ["slot_id"], ["created_at", "event_id", "event_type"])
        new.write.mode("overwrite").parquet(f"{base}/version-{n}")

    q = events.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    schema = "slot_id string, created_at timestamp, event_id bigint, event_type string"
    if last() < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/version-{last()}")
