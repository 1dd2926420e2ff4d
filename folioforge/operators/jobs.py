"""Job event log: stages, cursors, retention, history.  Rows: job_id, event_id, ts, stage, percent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMINAL = ("done", "failed", "cancelled")


def bound(events: DataFrame) -> DataFrame:
    """The events table as a job log: a job is a user, an event type is a stage."""
    kind = F.col("event_type")
    stage = (
        F.when(kind == "signup", "queued").when(kind == "view", "analyzing").when(kind == "click", "processing").when(kind == "purchase", "done").otherwise("failed")
    )
    return events.select(F.col("user_id").alias("job_id"), "event_id", "ts", stage.alias("stage"), percent(stage).alias("percent"))


def percent(stage: Column) -> Column:
    """Progress at a stage."""
    return F.when(stage == "queued", 0.0).when(stage == "analyzing", 28.0).when(stage == "processing", 58.0).otherwise(100.0)


def progress(done: Column, total: Column, base: float, weight: float) -> Column:
    """Percent of a running file, two decimals."""
    return F.round(base + weight * (0.28 + 0.58 * done / F.greatest(F.lit(1), total)), 2)


def after(log: DataFrame, cursor: int) -> DataFrame:
    """job_id, n_events, last_event, terminal: what a poll with a cursor returns for each job."""
    rows = log.where(F.col("event_id") > cursor)
    last = F.max_by("stage", "event_id")
    return rows.groupBy("job_id").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"), last.isin(*TERMINAL).alias("terminal"))


def retained(log: DataFrame, most: int = 1000) -> DataFrame:
    """The newest ``most`` events of each job."""
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("event_id")))
    return log.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def latest(log: DataFrame) -> DataFrame:
    """job_id, stage, percent, last_event: the state is the last event.  A partial aggregate, no sort."""
    newest = F.max(F.struct("event_id", "stage", "percent"))
    return log.groupBy("job_id").agg(newest.alias("n")).select("job_id", "n.stage", "n.percent", F.col("n.event_id").alias("last_event"))


def pruned(states: DataFrame, most: int = 20) -> DataFrame:
    """The jobs that stay when only ``most`` may: running ones first, then the most recent ended ones."""
    ended = F.col("stage").isin(*TERMINAL)
    return states.orderBy(ended, F.desc("last_event")).limit(most)


def first_inputs(inputs: DataFrame, key: Column, order: str) -> DataFrame:
    """key, first: inputs without repeats, by first appearance."""
    return inputs.groupBy(key.alias("key")).agg(F.min(order).alias("first"))
