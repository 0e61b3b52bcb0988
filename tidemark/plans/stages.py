"""The stages of a run: silver, checks, gold, scores, load."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, ml, quality, scd2, star
from ..operators.merge import merge_latest
from ..sources import files
from ..sources.snapshots import SnapshotTable
from . import marts

Config = dict[str, Any]
ENTITIES = (
    ("issues", contracts.ISSUES, contracts.issues, "issue_id"),
    ("issue_comments", contracts.COMMENTS, contracts.comments, "comment_id"),
)


def table(spark: SparkSession, config: Config, name: str) -> SnapshotTable:
    """By layer and name, as silver.issues."""
    return SnapshotTable(spark, f"{config['storage_root']}/{name.replace('.', '/')}")


def silver(spark: SparkSession, config: Config, run_id: str, full_refresh: bool = False) -> dict[str, Any]:
    """Raw lines of the last day processed and later, typed, merged latest-wins with what is there.

    Each entity has its own cursor, so one that lags isn't skipped past; duplicates within the batch
    go in a full refresh too.
    """
    report: dict[str, Any] = {"run_id": run_id, "tables": {}}
    for entity, contract, build, key in ENTITIES:
        cursor_path = f"{config['state_root']}/silver/{entity}.json"
        cursor = None if full_refresh else (files.read_json(spark, cursor_path) or {}).get("last_ingest_date")
        lines = files.read_bronze(spark, f"{config['storage_root']}/bronze/{entity}", cursor)
        found = _survey(lines, contract) if lines is not None else None
        if not found:
            report["tables"][entity] = {"new_bronze_rows": 0, "skipped": True}
            continue
        target = table(spark, config, f"silver.{entity}")
        merged = merge_latest(None if full_refresh else target.read(), build(lines), key, "updated_at", "_ingested_at", "_run_id")
        rows = target.publish(merged, run_id)
        files.write_json(spark, cursor_path, {"last_ingest_date": found["last"], "run_id": run_id})
        report["tables"][entity] = {"new_bronze_rows": found["n"], "silver_rows": rows, "schema_drift_new_fields": found["drift"]}
    return report


def _survey(lines: DataFrame, contract: contracts.Contract) -> dict[str, Any] | None:
    """Rows, last day and unknown keys of a batch, all from one reading; None of an empty batch."""
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    unknown = F.filter(keys, lambda k: ~k.isin(contract.known))
    # Each line counts once under null, for itself, and once under each key it has too many.
    each = lines.select("ingest_date", F.explode(F.concat(F.array(F.lit(None).cast("string")), unknown)).alias("key"))
    counted = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ingest_date").cast("string").alias("last")).collect()
    whole = next((r for r in counted if r.key is None), None)
    return whole and {"n": whole.n, "last": whole.last, "drift": {r.key: r.n for r in counted if r.key is not None}}


def gold(spark: SparkSession, config: Config, run_id: str, snapshot_at: str | None = None, full_refresh: bool = False) -> dict[str, Any]:
    """The star schema from silver. snapshot_at (a UTC timestamp) fixes the ages; now if None."""
    issues = star.enrich(table(spark, config, "silver.issues").read(), config["service_map"])
    comments = table(spark, config, "silver.issue_comments").read()
    if comments is None:
        # A run may have issues only.
        lines = spark.range(0).selectExpr("'' AS _run_id", "'' AS _ingested_at", "'' AS repo", "'' AS payload")
        comments = contracts.comments(lines)
    at = F.lit(snapshot_at).cast("timestamp") if snapshot_at else F.current_timestamp()
    days = issues.agg(
        F.min("created_at").cast("date").cast("string").alias("first"),
        F.greatest(F.max("created_at"), F.max("updated_at"), F.max(at)).cast("date").cast("string").alias("last"),
    ).first()
    counts = {
        name: table(spark, config, f"gold.{name}").publish(rows, run_id, files_count=n)
        for name, rows, n in (
            ("dim_date", star.dim_date(spark, days["first"], days["last"]), 1),
            ("dim_repo", star.dim_repo(issues), 1),
            ("dim_service", star.dim_service(issues), 1),
            ("bridge_issue_label", star.bridge_labels(issues), None),
        )
    }
    history = table(spark, config, "gold.dim_issue_scd2")
    seen = Observation(f"scd2-{run_id}")
    versions = scd2.merge(
        None if full_refresh else history.read(), issues, run_id, "issue_id", star.TRACKED, "updated_at", ("issue_key",), seen
    )
    counts["dim_issue_scd2"] = history.publish(versions, run_id)
    sla = config["sla"]
    responders = sla.get("responder_associations") or list(contracts.MAINTAINERS)
    facts = star.fact_issue(issues, comments, responders, float(sla["first_response_hours"]), at)
    counts["fact_issue"] = table(spark, config, "gold.fact_issue").publish(facts.sortWithinPartitions("created_date_key"), run_id)
    return {"run_id": run_id, "rows": counts, "scd2": dict(seen.get)}


def check(spark: SparkSession, config: Config, layer: str, now: str | None = None) -> list[quality.CheckResult]:
    """The layer's checks; the report and the metrics are written before a failure stops the run."""

    def resolve(name: str) -> DataFrame:
        rows = table(spark, config, name).read()
        if rows is None:
            raise quality.DataQualityError(f"{name} has not been published")
        return rows

    results = quality.run(config["checks"], resolve, layer, F.lit(now).cast("timestamp") if now else None)
    report = [vars(r) for r in results]
    files.write_json(spark, f"{config['state_root']}/dq/{layer}.json", report)
    quality.publish(quality.metrics(results), lambda points: _append(spark, config, points))
    quality.gate(results, config["quality"]["fail_on"])
    return results


def _append(spark: SparkSession, config: Config, points: list[dict[str, Any]]) -> None:
    schema = "name string, value double, table string, check string"
    rows = [(p["name"], p["value"], p.get("table"), p.get("check")) for p in points]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{config['state_root']}/dq/metrics")


def scores(spark: SparkSession, config: Config, run_id: str) -> dict[str, Any]:
    issues = star.enrich(table(spark, config, "silver.issues").read(), config["service_map"])
    rows = ml.features(issues, table(spark, config, "gold.fact_issue").read()).cache()
    try:
        report: dict[str, Any] = {"run_id": run_id}
        found = ml.topics(rows, config["topics"])
        if found is None:
            return report | {"skipped": f"fewer than {ml.FEWEST} issues, or no frequent term"}
        report["topics"] = table(spark, config, "gold.issue_topics").publish(found, run_id)
        risk = ml.escalation(rows, config["sla"]["slow_resolution_days"])
        if risk is None:
            return report | {"escalation": "skipped: too few labels, or of one class only"}
        report["escalation"] = risk[1]
        report["scored"] = table(spark, config, "gold.escalation_scores").publish(risk[0], run_id)
        return report
    finally:
        rows.unpersist()


def load(spark: SparkSession, config: Config) -> dict[str, int]:
    """The published gold tables and the marts, in the session's catalog and as views of the session; rows of each.

    In the database `warehouse` each gold table is an external table over its snapshot, moved to the new one by
    its location, and each mart a view. They outlast the session where the catalog does. All snapshots must be
    there before anything moves, and a failure moves back what had moved.
    """
    gold = {name: table(spark, config, f"gold.{name}") for name in marts.GOLD}
    missing = [name for name, t in gold.items() if t.current() is None]
    if missing:
        raise ValueError(f"not published: {', '.join(missing)}")
    database = config["warehouse"]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{config['storage_root']}/warehouse'")
    moved: list[tuple[str, str]] = []
    try:
        for name, t in gold.items():
            moved += _place(spark, f"{database}.gold_{name}", f"{t.path}/v={t.current()}")
        for name in marts.MARTS:
            spark.sql(f"CREATE OR REPLACE VIEW {database}.mart_{name} AS {marts.mart_sql(name, database)}")
        counts = {x: spark.table(f"{database}.{x}").count() for x in [*(f"gold_{n}" for n in gold), *(f"mart_{n}" for n in marts.MARTS)]}
    except Exception:
        for full, old in moved:
            _place(spark, full, old)
        raise
    marts.register(spark, {name: t.read() for name, t in gold.items()})
    return counts


def _place(spark: SparkSession, full: str, path: str) -> list[tuple[str, str]]:
    """An external table over this folder; if there was one over another, its name and that folder."""
    old = None
    if spark.catalog.tableExists(full):
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {full}").collect()}
        old = described["Location"]
        if spark.table(full).schema == spark.read.parquet(path).schema:
            spark.sql(f"ALTER TABLE {full} SET LOCATION '{path}'")
            spark.catalog.refreshTable(full)
            return [(full, old)]
        spark.sql(f"DROP TABLE {full}")
    spark.sql(f"CREATE TABLE {full} USING parquet LOCATION '{path}'")
    return [(full, old)] if old else []
