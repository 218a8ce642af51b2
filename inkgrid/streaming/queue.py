"""Streams: forms inspected as their blocks arrive, task states kept current, log rates by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkgrid.config import Settings
from inkgrid.operators import tasks
from inkgrid.plans.inspection import inspect


def drain(pages: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Works off everything that waits, a micro-batch at a time, and stops; a restart goes on after the last finished batch."""
    return pages.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(process).start()


def inspect_stream(results: DataFrame, to_blocks: Callable[[DataFrame], DataFrame], fields: DataFrame, settings: Settings, out: str, checkpoint: str) -> StreamingQuery:
    """Reports for each batch of recogniser results. A batch's number names its folder, so a repeated batch overwrites itself."""

    def process(batch: DataFrame, number: int) -> None:
        made = inspect(to_blocks(batch), fields, settings)
        made.reports.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return drain(results, process, checkpoint)


def task_states(events: DataFrame, settings: Settings) -> DataFrame:
    """The task table over a stream of its events (complete or update mode): the batch query is the streaming query."""
    return tasks.current(events, settings)


def log_rates(logs: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by level and window of event time; what is later than `late` no longer counts."""
    rows = logs.withColumn("time", F.try_to_timestamp("ts")).withWatermark("time", late)
    return rows.groupBy(F.window("time", width).alias("w"), "level").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "level", "events")


def without_repeats(events: DataFrame, by: str, order: str, payload: str) -> DataFrame:
    """A stream of events without those whose payload (a string) is the one before of their stream; the state is that one payload.

    The events of a micro-batch are taken in their order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        known, last = (True, state.get[0]) if state.exists else (False, None)
        kept = []
        for value in rows[payload]:
            value = None if pd.isna(value) else value
            kept.append(not known or value != last)
            known, last = True, value
        state.update((last,))
        yield rows[kept]

    return events.groupBy(by).applyInPandasWithState(run, events.schema, "last string", "append", GroupStateTimeout.NoTimeout)


def write_once(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A stream written as Parquet so that every row is there once: a batch's folder is named by its number, and a batch that is
    done again after a failure replaces it. `written` reads what is there."""
    return drain(events, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), checkpoint)


def written(spark: SparkSession, out: str) -> DataFrame:
    """What write_once has written, without the batches' numbers; a batch that is still being written is not seen."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def claims(events: DataFrame, settings: Settings, now: float, count: int) -> DataFrame:
    """What a batch of the queue's log lets a worker claim now, stale runs put back first."""
    return tasks.claim(tasks.recover_stale(tasks.current(events, settings), now), now, settings, count)
