"""The job event log as a stream: incremental state with the same result as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def log_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """New event files of a folder, as job log rows."""
    return jobs.bound(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def latest_state(log: DataFrame) -> DataFrame:
    """Running state per job: one row of state each, kept in the state store."""
    return jobs.latest(log)


def stage_counts(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and stage; windows are closed, and their state dropped, ``late`` after their end."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count("*").alias("n")).select("w.start", "stage", "n")


def run_once(stream: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what has arrived and stop; the checkpoint is the consumer's cursor."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_into(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what has arrived, store each batch's result table in place of the last one, and read it back.

    The table is written by the executors; a restarted query continues from the checkpoint.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
