"""Type-2 history: merge a snapshot into the versions so far.

| case      | when                                          | outcome                                  |
|-----------|-----------------------------------------------|------------------------------------------|
| new       | no current version                            | insert, open                             |
| changed   | other hash, snapshot newer                    | close the current one there, insert      |
| late      | other hash, snapshot not newer or undated     | current one stays                        |
| unchanged | same hash                                     | current one stays                        |
| gone      | not in the snapshot                           | current one stays open                   |

Versions already closed pass through. Merging the same snapshot again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import OPEN_END, attribute_hash

ACTIONS = ("new", "changed", "late", "unchanged", "gone")


def action(snapshot_hash: Column, current_hash: Column, snapshot_from: Column, current_from: Column) -> Column:
    """One of ACTIONS. An undated snapshot or version counts as late, so that no current row can vanish."""
    newer = F.coalesce(snapshot_from > current_from, F.lit(False))
    return (
        F.when(current_hash.isNull(), "new")
        .when(snapshot_hash.isNull(), "gone")
        .when(snapshot_hash == current_hash, "unchanged")
        .when(newer, "changed")
        .otherwise("late")
    )


def merge(
    previous: DataFrame | None,
    snapshot: DataFrame,
    run_id: str,
    key: str,
    tracked: list[str],
    valid_from: str,
    carried: tuple[str, ...] = (),
    observation: Observation | None = None,
) -> DataFrame:
    """All versions after the snapshot: key, carried, tracked, valid_from, valid_to, is_current, attr_hash, _run_id.

    One full outer join classifies each key, and each joined row unfolds to the one or two versions
    that follow from it, so the join runs once. `observation`, if given, gets inserted_new, changed
    and late_ignored from the same pass. The snapshot must hold each key once.
    """
    body = [key, *carried, *tracked]
    kind = snapshot.schema[valid_from].dataType.simpleString()
    open_end = F.lit(OPEN_END).cast(kind)
    fresh = snapshot.select(*body, F.col(valid_from).alias("valid_from")).withColumn("attr_hash", attribute_hash(*tracked))
    fresh = fresh.withColumns({"valid_to": open_end, "is_current": F.lit(True), "_run_id": F.lit(run_id)})
    columns = [*body, "valid_from", "valid_to", "is_current", "attr_hash", "_run_id"]
    fresh = fresh.select(*columns)
    if previous is None:
        previous = fresh.limit(0)
    current = previous.where("is_current").select(F.col(key), F.struct(*columns).alias("c"))
    joined = fresh.select(F.col(key), F.struct(*columns).alias("s")).join(current, key, "full_outer")
    what = action(F.col("s.attr_hash"), F.col("c.attr_hash"), F.col("s.valid_from"), F.col("c.valid_from"))
    joined = joined.withColumn("what", what)
    if observation is not None:
        joined = joined.observe(
            observation,
            *[F.count_if(F.col("what") == w).alias(n) for w, n in (("new", "inserted_new"), ("changed", "changed"), ("late", "late_ignored"))],
        )
    closed = F.struct(
        *[
            F.col("s.valid_from").alias(x) if x == "valid_to" else F.lit(False).alias(x) if x == "is_current" else F.col(f"c.{x}").alias(x)
            for x in columns
        ]
    )
    versions = (
        F.when(F.col("what") == "new", F.array("s"))
        .when(F.col("what") == "changed", F.array(closed, F.col("s")))
        .otherwise(F.array("c"))
    )
    after = joined.select(F.explode(versions).alias("v")).select("v.*")
    return previous.where("NOT is_current").select(*columns).unionByName(after)


def as_of(versions: DataFrame, moments: DataFrame, moment: str = "asof_ts") -> DataFrame:
    """The versions valid at each moment: valid_from <= moment < valid_to, any moments. See plans.marts for a grid."""
    valid = (F.col("valid_from") <= F.col(moment)) & (F.col(moment) < F.col("valid_to"))
    return moments.join(versions, valid)
