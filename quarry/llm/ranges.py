"""Running totals over a table in sorted order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.frames import stored


def with_running_start(df: DataFrame, order: list[str], value: str, start: str = "start") -> DataFrame:
    """`df` with column `start`: the sum of `value` over all rows before. Equal rows follow one another.

    Rows are dealt by ranges of `order` and, within equal ones, by their place in the input, so that rows which repeat
    without end are still many ranges. The driver adds up one sum a range, as many as there are shuffle partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = stored(tied.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted(ranged.groupBy("_range").agg(F.sum(value)).collect())
    firsts, total = [], 0
    for number, s in sums:
        firsts.append((number, total))
        total += s
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(spark.createDataFrame(firsts, "_range int, _first long")), "_range")
    return out.withColumn(start, F.col("_first") + F.sum(value).over(w) - F.col(value)).drop("_range", "_first", "_tie")
