"""Shared plumbing: written intermediate tables, text helpers, Arrow row mapping."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.cluster import checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, below spark.checkpoint.dir.

    Where that setting is missing, a local session gets a temporary folder; a cluster raises.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{checkpoint_dir(spark)}/quarry-{app}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        delete_path(spark, root)
    except Exception:  # the JVM may have ended before the interpreter
        return


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are over; it acts on collected references."""
    gc.collect()
    spark._jvm.System.gc()


class Stored:
    """A DataFrame written to the shared folder and read back, so that its lineage ends there."""

    def __init__(self, df: DataFrame, name: str = "frame"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        free_shuffles(self.spark)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def stored(df: DataFrame, name: str = "frame") -> DataFrame:
    return Stored(df, name).df


class Bucketed:
    """A DataFrame written to the shared folder in buckets of a key, so that joins by that key do not move it again.

    It is an external table: its files lie in the shared folder, whatever the warehouse setting is.
    """

    def __init__(self, df: DataFrame, key: str):
        self.spark, self.name = df.sparkSession, f"quarry_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, key).format("parquet").option("compression", "zstd").option("path", self.path).saveAsTable(self.name)
        free_shuffles(self.spark)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def whole_text(col: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; the quick built-in serves wherever every character is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def carried(df: DataFrame, keep: Iterable[str], produced: Iterable[str]) -> list[Column]:
    """Columns passed through: those asked for, without any whose name the operator produces itself."""
    own = {x.lower() for x in produced}
    return [F.col(f"`{c}`") for c in keep if c.lower() not in own]


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as a plane of low and a plane of high halves: the second compresses to almost nothing."""
    halves = numbers.astype("<u4").view("<u2").reshape(-1, 2)
    return halves[:, 0].tobytes() + halves[:, 1].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, "<u2").reshape(2, -1).astype(np.int32)
    return planes[0] | planes[1] << 16


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Arrow batches are cut by bytes: ten thousand long texts at once would not fit an executor's overhead."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def map_stream(df: DataFrame, schema: str, make: Callable[[], Callable[[Iterator[tuple]], Iterable[tuple]]], flush_rows: int = 2048, flush_bytes: int = 8 << 20, weigh: Iterable[int] = ()) -> DataFrame:
    """The rows of a partition, in their order, through a generator in Arrow batches. `make` runs once a task.

    A batch leaves when it holds `flush_rows` rows or, counting bytes, text or lists in output columns `weigh`, `flush_bytes`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    target, weighed = to_arrow_schema(_parse_datatype_string(schema)), tuple(weigh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, target, strict=True)], schema=target)

        given = (row for b in batches for at in range(0, b.num_rows, 256) for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True))
        for out in make()(given):
            rows.append(out)
            held += sum(len(out[k]) for k in weighed if out[k] is not None)
            if len(rows) >= flush_rows or held >= flush_bytes:
                yield batch()
                rows.clear()
                held = 0
        if rows:
            yield batch()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[tuple], Iterable[tuple]]], flush_rows: int = 2048, flush_bytes: int = 8 << 20, weigh: int | None = None) -> DataFrame:
    """Flat-map rows: `make` runs once a task and returns the function of a row."""

    def stream() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        f = make()
        return lambda rows: (out for row in rows for out in f(row))

    return map_stream(df, schema, stream, flush_rows, flush_bytes, () if weigh is None else (weigh,))
