"""Raw lines as a stream: parsed, de-duplicated within a watermark, merged into a snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contracts import open_envelopes
from ..operators.merge import merge_latest
from ..sources.snapshots import SnapshotTable


def lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return open_envelopes(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def distinct_events(rows: DataFrame, key: str, stamp: str, delay: str) -> DataFrame:
    """Each key once; what comes again within the delay is dropped, and state older than it forgotten."""
    timed = rows.withColumn(stamp, F.col(stamp).cast("timestamp"))
    return timed.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, stamp: str, width: str, delay: str, *keys: str) -> DataFrame:
    timed = rows.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay)
    return timed.groupBy(F.window(stamp, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def merge_into(rows: DataFrame, table: SnapshotTable, key: str, order: list[str], checkpoint: str, keep: int = 3) -> StreamingQuery:
    """Each micro-batch is merged latest-wins and published. Replaying a batch changes nothing, so delivery may repeat.

    The last `keep` snapshots stay for readers that have begun on one.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.publish(merge_latest(table.read(), batch, key, *order), f"batch{number}")
        table.retain(keep)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
