"""Small driver-side files (state, reports, pointers) and raw JSON lines, through Spark's own file systems.

Paths go to Hadoop's FileSystem, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import open_envelopes


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return default
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Whole or not at all: written beside, then renamed over the old file."""
    jvm = spark.sparkContext._jvm
    fs, where = _at(spark, path)
    fs.mkdirs(where.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{jvm.java.util.UUID.randomUUID()}.tmp")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(json.dumps(value, indent=2, default=str, sort_keys=True).encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(beside, where, options)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as gzip JSON lines, in folders by repo and ingest_date; appended, never overwritten."""
    named = rows.withColumn("repo_dir", F.replace("repo", F.lit("/"), F.lit("__")))
    line = F.to_json(F.struct(*[x for x in rows.columns if x != "ingest_date"]))
    named.select(line.alias("value"), F.col("repo_dir").alias("repo"), "ingest_date").write.mode("append").partitionBy(
        "repo", "ingest_date"
    ).option("compression", "gzip").text(path)


def read_bronze(spark: SparkSession, path: str, since: str | None = None) -> DataFrame | None:
    """Envelopes and ingest_date of all raw lines, of the days from `since` on; None if there are none yet.

    The day is a partition of the path, so earlier days are not opened.
    """
    if not any(x.startswith("repo=") for x in children(spark, path)):
        return None
    lines = spark.read.option("basePath", path).text(f"{path}/repo=*/ingest_date=*").select("value", "ingest_date")
    if since:
        lines = lines.where(F.col("ingest_date") >= F.lit(since).cast("date"))
    return open_envelopes(lines)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or in local mode a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
