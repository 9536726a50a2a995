"""The audit log as a stream: JSON lines in, the current state of each target out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.governance import ROLLBACK, SCHEMA, empty


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def latest_state(log: DataFrame) -> DataFrame:
    """(target, event_id, state): the last event of each target by (time, id); null where it removed the target.

    One aggregate of bounded state a target, for update mode; rollbacks carry the
    state they restore.
    """
    gone = (F.col("action") != ROLLBACK) & empty("after")
    event = F.struct(F.when(gone, F.lit(None).cast("string")).otherwise(F.col("after")).alias("state"))
    return log.groupBy("target").agg(F.max("event_id").alias("event_id"), F.max_by(event, F.struct("ts", "event_id"))["state"].alias("state"))


def actions_by_window(log: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of actions by time window; events later than ``late`` are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")
