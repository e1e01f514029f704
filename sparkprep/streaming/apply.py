"""Structured Streaming uses of the fitted state.

* :func:`transform_stream` applies a ``PlanModel`` (fitted on a batch table)
  to a streaming DataFrame: the model is pure projections plus broadcast
  joins with static code tables, all stateless in streaming terms.
* :func:`dedup_stream` removes duplicates within a watermark
  (``dropDuplicatesWithinWatermark``); the event-time column is cast from
  ``timestamp_ntz`` to ``timestamp`` first, which watermarks require.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.plans.cleaner import PlanModel


def transform_stream(stream: DataFrame, model: PlanModel) -> DataFrame:
    return model.transform(stream)


def dedup_stream(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str = "10 minutes") -> DataFrame:
    s = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Drive a streaming query over all available input into Parquet files
    under ``folder`` (shared; also its checkpoint) and read them back."""
    q = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
