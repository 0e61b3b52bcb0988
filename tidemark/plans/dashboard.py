"""The dashboard's queries over the gold views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def repos(spark: SparkSession) -> DataFrame:
    return spark.table("gold_dim_repo").select("repo").orderBy("repo")


def opened(spark: SparkSession, since: str, chosen: list[str] | None = None) -> DataFrame:
    """Issues created since a day in the chosen repositories (all if None), with repo and service."""
    facts = spark.table("gold_fact_issue").where(F.col("created_at") >= F.lit(since).cast("date"))
    joined = facts.join(spark.table("gold_dim_repo"), "repo_key").join(spark.table("gold_dim_service"), "service_key")
    return joined if chosen is None else joined.where(F.col("repo").isin(*chosen))


def kpi(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.median("hours_to_first_response").alias("ttfr"),
        F.avg(F.col("first_response_sla_breached").cast("double")).alias("breach"),
        F.sum((~F.col("is_closed")).cast("int")).alias("open_n"),
        F.median("hours_to_close").alias("ttc"),
    )


def volume(rows: DataFrame, n: int = 15) -> DataFrame:
    counted = rows.where("service_slug <> 'unknown'").groupBy("service_slug").agg(F.count(F.lit(1)).alias("issues"))
    return counted.orderBy(F.desc("issues"), "service_slug").limit(n)


def weekly_median(rows: DataFrame) -> DataFrame:
    week = F.date_trunc("week", "created_at").alias("week_start")
    return rows.groupBy(week).agg(F.median("hours_to_first_response").alias("hours")).orderBy("week_start")


def top_services(asof: DataFrame, n: int = 6) -> DataFrame:
    peaks = asof.groupBy("service_slug").agg(F.max("open_issues_asof").alias("peak"))
    return peaks.orderBy(F.desc("peak"), "service_slug").limit(n)


def backlog_chart(asof: DataFrame, n: int = 6) -> DataFrame:
    """A row a week, a column for each of the n largest services."""
    names = [r.service_slug for r in top_services(asof, n).collect()]
    return asof.groupBy("asof_ts").pivot("service_slug", names).agg(F.first("open_issues_asof")).orderBy("asof_ts")


def backlog(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.orderBy(F.desc("open_awaiting_first_response"), "service_slug", "repo").limit(n)
