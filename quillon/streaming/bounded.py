"""Structured Streaming forms of capped, deduplicated and windowed streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream over Parquet files; schema is read from the same files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path + "*")


def capped(stream: DataFrame, key: str, ident: str, k: int) -> DataFrame:
    """key, ident: at most k rows of each key, the earliest seen; the state is one counter for each key."""
    key_type, id_type = (stream.schema[c].dataType.simpleString() for c in (key, ident))

    def accept(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        out = []
        for f in frames:
            took = f.head(max(0, k - seen))
            seen += len(took)
            out.append(took[[key, ident]])
        state.update((seen,))
        yield from out

    return stream.select(key, ident).groupBy(key).applyInPandasWithState(accept, f"{key} {key_type}, {ident} {id_type}", "seen int", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """window start, key, n, total over event-time windows; rows later than the watermark are dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def distinct_within(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys weren't seen before within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all that is available, exactly once, into Parquet under folder (shared storage), and read it."""
    spark = stream.sparkSession
    base = f"{folder}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    writer.format("parquet").start(f"{base}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
