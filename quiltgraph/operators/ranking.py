"""Exact numbering and prefix sums without a window over the whole table.

Rows are numbered within ordered buckets, and the buckets' counts are summed
in two levels, so no task sees more than a bucket, or GROUP bucket counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = 4096
#: Rows of a shuffle for each task; and the fewest for which another task is worth its start.
TASK_ROWS, LEAST_ROWS = 1 << 19, 1 << 15


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df shuffled by keys, for as many tasks as its rows (their number, or a bound) ask for.

    By default Spark fills a task up to a number of compressed bytes, and rows
    of ids compress so well that a task would hold more the larger the table
    is.  Without rows it is left to Spark.
    """
    if rows is None:
        return df.repartition(*keys)
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS))
    return df.repartition(max(1, few, -(-rows // TASK_ROWS)), *keys)


def dealer(rows: int | None) -> Callable[..., DataFrame]:
    """What deals tables by keys for as many tasks as rows ask for, see dealt; without rows it leaves them alone."""
    return (lambda df, *keys: df) if rows is None else lambda df, *keys: dealt(df, rows, *keys)


def prefix_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over rows with smaller key.  key: distinct, integer, not negative."""
    rows = df.withColumn("_g", F.floor(F.col(key) / GROUP))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("_g").agg(F.sum(value).alias("_t")).withColumn("_h", F.floor(F.col("_g") / GROUP))
    upper = totals.groupBy("_h").agg(F.sum("_t").alias("_u"))
    upper = upper.select("_h", (F.sum("_u").over(before().orderBy("_h")) - F.col("_u")).alias("_hs"))
    starts = totals.withColumn("_s", F.sum("_t").over(before("_h").orderBy("_g")) - F.col("_t")).join(upper, "_h").select("_g", (F.col("_s") + F.col("_hs")).alias("_start"))
    inner = F.sum(value).over(before("_g").orderBy(key)) - F.col(value)
    return rows.withColumn("_i", inner).join(starts, "_g").withColumn(out, (F.col("_i") + F.col("_start")).cast("bigint")).drop("_g", "_i", "_start")


def number_rows(df: DataFrame, bucket: Column, order: list, out: str = "n") -> DataFrame:
    """Adds out: each row's 0-based place in the order (bucket, *order).  bucket: integer, not negative."""
    rows = df.withColumn("_bucket", bucket.cast("bigint"))
    starts = prefix_sum(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_count")), "_bucket", "_count", "_first").drop("_count")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(starts, "_bucket").withColumn(out, F.col("_place") + F.col("_first")).drop("_bucket", "_place", "_first")


def hash_text(column: str, seed: object) -> Column:
    """The text by which seeded shuffles order: the same in any engine."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"_{seed}")).cast("binary"))


def shuffled(df: DataFrame, column: str, seed: object, out: str = "n") -> DataFrame:
    """Adds out: each row's 0-based place in the order of the seeded hash of column."""
    rows = df.withColumn("_h", hash_text(column, seed))
    return number_rows(rows, F.conv(F.substring("_h", 1, 6), 16, 10), ["_h", column], out).drop("_h")


def number_by_id(df: DataFrame, column: str, out: str = "n", each: int = 65536) -> DataFrame:
    """Adds out: each row's 0-based place in the order of a non-negative integer column."""
    return number_rows(df, F.floor(F.col(column) / each), [column], out)


def number_within(df: DataFrame, key: str, bucket: Column, order: list, out: str = "n") -> DataFrame:
    """Adds out: each row's 0-based place among the rows of its key, in the order (bucket, *order).

    bucket: an integer; one task sees the rows of a bucket of a key, and one the bucket counts of a key.
    """
    rows = df.withColumn("_b", bucket.cast("bigint"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c")).select(key, "_b", (F.sum("_c").over(before) - F.col("_c")).alias("_s"))
    place = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    return rows.withColumn("_p", place).join(starts, [key, "_b"]).withColumn(out, F.col("_p") + F.col("_s")).drop("_b", "_p", "_s")
