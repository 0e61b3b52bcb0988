"""Sharding by global byte-size prefix sums, in DataFrame functions only.

Documents are ordered by doc_id. Each range partition adds up its bytes, a running sum over those
totals gives every partition the bytes before it, and a running sum inside gives every document
its place in the whole. The line of all bytes is cut at equal targets: a document belongs to the
shard in which its middle byte falls, so shards are contiguous and differ by no more than one
document from the target on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c
from .ordering import running

SHARDS = 8


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _line(rows: DataFrame) -> tuple[DataFrame, int]:
    """The distinct (doc_id, row) in order, with times, bytes_before and rows_before; and the bytes of all."""
    rest = [x for x in rows.columns if x not in ("doc_id", "row", "size")]
    keys = rows.groupBy("doc_id", "row").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("times"), *[F.first(x).alias(x) for x in rest])
    keys = c.checkpointed(keys.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))}))
    whole = keys.agg(F.sum(F.col("size") * F.col("times"))).first()[0] or 1
    placed = running(keys, ["none", "id", "row"], bytes_before=F.col("size") * F.col("times"), rows_before=F.col("times"))
    return placed.drop("none", "id"), whole


def _cut(placed: DataFrame, time: Column, whole: int, shards: int) -> DataFrame:
    """shard and line (place in the whole) of the copy number `time`, from 0, of each key."""
    middle = f"((2 * (bytes_before + _time * size) + size) * {shards}) div {2 * whole}"
    return placed.withColumn("_time", time.cast("long")).withColumns(
        {"shard": F.least(F.expr(middle), F.lit(shards - 1)).cast("int"), "line": F.col("rows_before") + F.col("_time")}
    )


def places(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows(doc_id, row, size, ..) -> one row for each, and shard, slot.

    `row` tells apart rows of one doc_id; rows equal in both are placed as one entry of the order
    and then apart, so that however often a row repeats it is one key.
    """
    placed, whole = _line(rows)
    each = placed.withColumn("time", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    each = _cut(each, F.col("time"), whole, shards)
    heads = each.groupBy("shard").agg(F.min("line").alias("head"))
    return each.join(F.broadcast(heads), "shard").withColumn("slot", F.col("line") - F.col("head"))  # a row a shard


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (place in the shard, gapless from 0).

    The order is doc_id, null last, then a hash of the text; equal rows stand side by side. Null
    texts weigh one byte. A document longer than a shard's target leaves shards empty. An empty
    table gives an empty result. Columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    inner, names = c.with_internal(docs, doc_id="doc_id", text="text")
    inner = inner.withColumn("row", c.row_key("doc_id", "text"))
    placed, whole = _line(inner.select("doc_id", "row", size_of(F.col("text")).alias("size")))
    placed = c.checkpointed(placed.drop("doc_id"))
    firsts = placed.withColumn("time", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    heads = _cut(firsts, F.col("time"), whole, shards).groupBy("shard").agg(F.min("line").alias("head"))
    inner = inner.drop("doc_id", "text").withColumn("time", F.row_number().over(Window.partitionBy("row").orderBy("row")) - 1)
    cut = _cut(inner.join(placed, "row"), F.col("time"), whole, shards).join(F.broadcast(heads), "shard")
    return c.restore(cut.withColumn("slot", F.col("line") - F.col("head")), names, "shard", "slot")
