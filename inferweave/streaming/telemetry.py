"""The same telemetry over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None) -> DataFrame:
    """Files of events as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def rate_stream(events: DataFrame, ts: str = "ts", width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts per window; late events are taken up to the watermark."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "n")


def session_stream(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a quiet gap."""
    s = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def distinct_questions(events: DataFrame, key: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first of equal questions within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def latest_to_end(stream: DataFrame, folder: str, checkpoint: str, key: list[str]) -> DataFrame:
    """Runs a stream of updates over what is there and returns the last row of each key, windows that are still open included.

    Each batch overwrites a folder of its own, so that a batch that is run again counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [F.max_by(c, "_batch").alias(c) for c in stream.columns if c not in key]
    return stream.sparkSession.read.parquet(f"{folder}/batch=*").groupBy(*key).agg(*rest).select(*stream.columns)


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote to folder."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder)


def on_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls handle(batch, number) for all that is there, each batch once or, after a failure, again with its number."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ewma_stream(events: DataFrame, key: str, ts: str = "ts", window_seconds: float = 10.0) -> DataFrame:
    """key, at, ewma after each batch: the decayed rate q * exp(-dt / w) + 1 / w, kept per key over batches.

    A key's state is two numbers. Events of a batch are taken in order of time; earlier ones than the last don't decay.
    """
    import math

    def update(keys, batches, state):
        import pandas as pd

        rate, last = state.get if state.exists else (0.0, None)
        times = sorted(t for pdf in batches for t in pdf["at"])
        for t in times:
            rate = (rate * math.exp(-max(0.0, t - last) / window_seconds) if last is not None else 0.0) + 1 / window_seconds
            last = t if last is None else max(last, t)
        state.update((rate, last))
        yield pd.DataFrame({"key": [str(keys[0])], "at": [last], "ewma": [round(rate, 9)]})

    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at")
    return events.select(F.col(key).alias("key"), seconds).groupBy("key").applyInPandasWithState(update, "key string, at double, ewma double", "rate double, last double", "append", "NoTimeout")
