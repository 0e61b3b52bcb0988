"""A total order over a table without a task that sees all of it.

Rows go to range partitions by their key, and each remembers its partition's number. The dealt
table is cut by a checkpoint, so every later use sees the same partitions; only the ends or the
totals of the partitions, a row each, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows and `part`: every key of a part precedes every key of the next part."""
    by_range = rows.repartitionByRange(c.partitions(rows.sparkSession), *order)
    return c.checkpointed(by_range.withColumn("part", F.spark_partition_id()))


def before(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """rows and `prev`, a struct of the preceding row's values; the first row gets the last one's."""
    parts = dealt(rows, *order)
    packed = F.struct(*values)
    last = parts.groupBy("part").agg(F.max(F.struct(*order, packed.alias("it")))["it"].alias("it"))
    along = Window.orderBy("part")
    ends = last.select("part", F.coalesce(F.lag("it").over(along), F.last("it").over(along.rowsBetween(0, Window.unboundedFollowing))).alias("end"))
    inside = Window.partitionBy("part").orderBy(*order)
    return (
        parts.withColumn("prev", F.lag(packed).over(inside))
        .join(ends, "part")
        .withColumn("prev", F.coalesce("prev", "end"))
        .drop("part", "end")
    )


def running(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """rows and, for each named sum, its total over all rows before this one."""
    parts = dealt(rows.withColumns({f"_{k}": v for k, v in sums.items()}), *order)
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    starts = totals.select("part", *[F.coalesce(F.sum(f"_{k}").over(along), F.lit(0)).alias(f"_{k}_start") for k in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumns({k: F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
        .join(starts, "part")
        .withColumns({k: F.col(k) + F.col(f"_{k}_start") for k in sums})
        .drop("part", *[f"_{k}" for k in sums], *[f"_{k}_start" for k in sums])
    )
