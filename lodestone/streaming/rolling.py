"""Structured Streaming counterparts of the rolling counts and of run state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of users, closed once the watermark has passed their gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def deliveries(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each delivery once: repeats within the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_states(events: DataFrame) -> DataFrame:
    """The state of each run, emitted whenever a batch brings newer events for it: user_id, state, event_id."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, name = state.get if state.exists else (-1, "")
        for rows in batches:
            top = rows.loc[rows["event_id"].idxmax()]
            if top["event_id"] > last:
                last, name = int(top["event_id"]), str(top["event_type"])
        state.update((last, name))
        yield pd.DataFrame({"user_id": [key[0]], "state": [name], "event_id": [last]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, state string, event_id long", "event_id long, state string", "update", GroupStateTimeout.NoTimeout)
