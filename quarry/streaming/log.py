"""The event log as a stream: append, resume, per-key state, windows with late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.sources.sinks import overwrite_partitions


def read(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """New files of a folder of Parquet events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a folder; the checkpoint makes a restart go on where it was, nothing twice."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_log(events: DataFrame, path: str, checkpoint: str, key: str, at: str, buckets: int = 64) -> StreamingQuery:
    """The newest row of each key, in folders by a hash of the key; a batch rewrites the folders that it touches.

    A batch that runs again after a failure finds its own rows there and changes nothing, whatever its number is.
    """
    spark = events.sparkSession
    kept = StructType([*events.schema.fields, StructField("bucket", IntegerType())])

    def batch(rows: DataFrame, number: int) -> None:  # noqa: ARG001
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` rows at most
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            before = spark.read.schema(kept).parquet(path).where(F.col("bucket").isin(touched))
        else:
            before = rows.limit(0)
        rest = [c for c in events.columns if c != key]
        newest = before.unionByName(rows).groupBy("bucket", key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*", "bucket")
        overwrite_partitions(newest, path, "bucket")
        rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, width: str, late: str, key: str, value: str) -> DataFrame:
    """Counts and sums by window and key; rows later than `late` behind are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def once(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once within the watermark: work that was done is not taken up again."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def breakers(events: DataFrame, key: str, at: str, failures: int = 3, hours: int = 4) -> DataFrame:
    """key, at, state: a row for each event with the breaker's state after it.

    events need key, at and outcome (ok, failed or blocked). Rows of a batch are taken in order of time.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, until = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(at)
        out = []
        for when, outcome in zip(rows[at], rows["outcome"], strict=True):
            now = int(when.timestamp())
            if outcome == "ok":
                streak, until = 0, 0
            else:
                streak += 1
                if outcome == "blocked" or streak >= failures:
                    until = now + hours * 3600
            out.append((name[0], when, "open" if until > now else "closed", streak))
        state.update((streak, until))
        yield pd.DataFrame(out, columns=[key, at, "state", "streak"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, state string, streak long", "streak long, until long", "append", GroupStateTimeout.NoTimeout)


def token_buckets(events: DataFrame, key: str, at: str, rate: float, burst: float) -> DataFrame:
    """key, at, allowed: one token an event, refilled by the second up to `burst`."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        out = []
        for when in pd.concat(list(batches)).sort_values(at)[at]:
            now = when.timestamp()
            tokens = min(burst, tokens + (now - last) * rate) if last is not None else tokens
            last = now
            out.append((name[0], when, tokens >= 1))
            tokens -= tokens >= 1
        state.update((float(tokens), last))
        yield pd.DataFrame(out, columns=[key, at, "allowed"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
