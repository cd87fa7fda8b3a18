"""Structured Streaming forms: late duplicates dropped within a watermark, windowed bars, running state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once; what comes later than the watermark is gone, and so is the memory of older keys."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_bars(events: DataFrame, window: str = "1 day", ts: str = "ts", by: str = "user_id", value: str = "value") -> DataFrame:
    """First, highest, lowest, last and summed value of each key and window, emitted when the watermark has passed it."""
    order = F.struct(ts, "event_id")
    return events.groupBy(F.window(ts, window).alias("w"), by).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("n")
    ).select(F.col("w.start").alias("start"), by, "open", "high", "low", "close", "n")


STATE = "n long, total double, peak double"


def running_totals(events: DataFrame, by: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """The count, sum and peak of the sum of each key so far, a row for each key and micro-batch: an account kept as state.

    Within a batch a key's rows come in pieces in any order; the sum's peak is taken over the sums at the end of batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, peak = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        peak = max(peak, total)
        state.update((n, total, peak))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total], "peak": [peak]})

    kind = events.schema[by].dataType.simpleString()
    return events.select(by, value, ts).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n long, total double, peak double", STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now, into Parquet; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)
