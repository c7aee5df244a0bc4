"""Writers: append, keyed upsert and purge by partition, content-addressed objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Only the partitions that `rows` has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def purge(spark: SparkSession, path: str, by: str, value: str) -> bool:
    """Drop one partition; true if it was there. Other tables, receipts among them, are left alone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def put_objects(files: DataFrame, path: str) -> None:
    """files(content) by digest, each content once, also over several calls, in folders by the digest's first two digits."""
    spark = files.sparkSession
    named = files.select(F.sha2("content", 256).alias("sha256"), "content")
    once = named.groupBy("sha256").agg(F.first("content").alias("content"))
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        once = once.join(spark.read.schema("sha256 string, content binary, prefix string").parquet(path).select("sha256"), "sha256", "left_anti")
    once.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def checked_version(expected: int, found: int) -> None:
    """An optimistic update is refused if someone else wrote meanwhile."""
    if expected != found:
        raise ValueError(f"version {expected} was expected, version {found} is stored")


def merged_maps(old: str, new: str) -> Column:
    """Both maps in one, the new value where both have a key."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(F.col(new).isNull(), F.col(old)).when(F.col(old).isNull(), F.col(new)).otherwise(F.map_concat(kept, F.col(new)))
