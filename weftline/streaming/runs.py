"""The same operators on streams: table streams, running counts, windows, runner.

Streams read tables that grow by files. Batch and stream agree row for row on
what is there, which the tests check with ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def table_stream(spark: SparkSession, path: str, event_time: str | None = None, watermark: str = "1 day", files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream; an event-time column becomes a timestamp with a watermark."""
    from ..scratch import is_file

    schema = spark.read.parquet(path).schema
    if is_file(spark, path):
        path = f"{path[:-1]}[{path[-1]}]"
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if event_time:
        df = df.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, watermark)
    return df


class RunningCount(StatefulProcessor):
    """Count so far of each key, with every row; ``order`` settles the order inside a batch."""

    def __init__(self, key: str, order: list[str]):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        whole = pd.concat(list(rows)).sort_values(self.order)
        whole["n"] = range(n + 1, n + 1 + len(whole))
        self.count.update((n + len(whole),))
        yield whole[[self.key, self.order[-1], "n"]]

    def close(self) -> None:
        pass


def running_count(stream: DataFrame, key: str, order: list[str], schema: str) -> DataFrame:
    """Rows with their key's count so far; state is one number a key."""
    return stream.select(key, *order).groupBy(key).transformWithStateInPandas(RunningCount(key, order), outputStructType=schema, outputMode="Append", timeMode="None")


def windowed(stream: DataFrame, at: str, width: str, keys: list[str], slide: str | None = None, **aggregates) -> DataFrame:
    """Tumbling or sliding windows of event time (an extension to arrival order)."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.groupBy(w, *keys).agg(*(c.alias(k) for k, c in aggregates.items()))


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], **aggregates) -> DataFrame:
    return stream.groupBy(F.session_window(at, gap), *keys).agg(*(c.alias(k) for k, c in aggregates.items()))


def deduplicated(stream: DataFrame, columns: list[str]) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(columns)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is there to the end; return the result. Complete results are replaced batch by batch."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(path)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
