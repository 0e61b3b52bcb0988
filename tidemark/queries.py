"""One query for each operator, over the driver's tables, with independent SQL for DuckDB.

The tables stand in for the engine's: orders are issues (their customer's nation the repository, the
priority the service), lineitems are comments (the supplier the author, the return flag the author's
association), events are versions of users. NULLs and drift are put in by rule on both sides, as the
tables hold none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import attribute_hash, hours_between, surrogate
from .functions.rules import classify, first_capture, first_keyword, normalize_slug
from .operators import contracts, merge, ml, quality, scd2, star
from .plans import dashboard, marts
from .sources import rest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SNAPSHOT = "2002-01-01 00:00:00"
RESPONDERS = ["A", "R"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- stand-ins
def cases(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = t(spark, sf, "orders"), t(spark, sf, "customer")
    nation = F.broadcast(t(spark, sf, "nation"))  # 25 rows by definition
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    closed = F.col("o_orderstatus") == "F"
    return rows.select(
        F.col("o_orderkey").alias("issue_id"),
        F.concat_ws("#", F.lit("case"), "o_orderkey").alias("issue_key"),
        F.concat_ws("/", F.lit("org"), "n_name").alias("repo"),
        F.col("o_custkey").cast("string").alias("author_login"),
        F.when(closed, "closed").otherwise("open").alias("state"),
        F.when(F.col("o_orderpriority").startswith("3"), "unknown").otherwise(normalize_slug(F.col("o_orderpriority"))).alias("service_slug"),
        F.col("o_orderpriority").startswith("1").alias("is_bug"),
        F.col("o_orderpriority").startswith("5").alias("is_feature_request"),
        F.array("o_orderpriority", "o_orderstatus").alias("labels"),
        F.col("o_orderdate").alias("created_at"),
        F.when(closed, F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 900).cast("int"))).alias("closed_at"),
        (F.col("o_orderkey") % 7).alias("comment_count"),
        (F.col("o_orderkey") % 5).alias("reaction_count"),
        (F.col("o_orderkey") % 3).alias("assignee_count"),
        F.floor("o_totalprice").alias("body_len"),
        (F.col("o_orderkey") % 2 == 0).alias("has_code_block"),
        F.lit("NONE").alias("author_association"),
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.where(F.col("l_shipdate") >= F.col("o_orderdate")).select(
        F.concat_ws("#", F.lit("case"), "l_orderkey").alias("issue_key"),
        F.col("l_suppkey").cast("string").alias("author_login"),
        F.when(F.col("l_linenumber") == 7, "Bot").when(F.col("l_linenumber") != 6, "User").alias("author_type"),
        F.col("l_returnflag").alias("author_association"),
        F.col("l_shipdate").alias("created_at"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return star.fact_issue(cases(spark, sf), replies(spark, sf), RESPONDERS, 24.0, F.lit(SNAPSHOT).cast("timestamp_ntz"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Users' event types as history: each event is a version until the user's next."""
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t(spark, sf, "events").withColumn("next", following)
    return rows.select(
        F.col("user_id").alias("issue_id"),
        F.col("event_type").alias("service_slug"),
        F.when(F.col("event_id") % 4 == 0, "closed").otherwise("open").alias("state"),
        F.col("ts").alias("valid_from"),
        F.coalesce("next", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).alias("valid_to"),
        F.col("next").isNull().alias("is_current"),
    )


def gold(spark: SparkSession, sf: str) -> None:
    rows = cases(spark, sf)
    labels = rows.select("issue_id", F.explode(F.array(F.when(F.col("issue_id") % 6 == 0, "closed-as-duplicate").otherwise("other"), F.lit("x"))).alias("label"))
    marts.register(
        spark,
        {
            "dim_date": star.dim_date(spark, "1994-01-01", "2024-12-31"),
            "dim_repo": star.dim_repo(rows),
            "dim_service": star.dim_service(rows),
            "bridge_issue_label": labels.distinct(),
            "fact_issue": facts(spark, sf),
            "dim_issue_scd2": versions(spark, sf),
        },
        views=False,
    )


CASES = """cases AS (
  SELECT o_orderkey AS issue_id, 'case#' || o_orderkey AS issue_key, 'org/' || n_name AS repo, CAST(o_custkey AS VARCHAR) AS author_login,
    CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS state,
    CASE WHEN o_orderpriority LIKE '3%' THEN 'unknown' ELSE trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') END AS service_slug,
    o_orderpriority LIKE '1%' AS is_bug, o_orderpriority LIKE '5%' AS is_feature_request,
    o_orderpriority, o_orderstatus, o_totalprice, o_orderdate AS created_at,
    CASE o_orderstatus WHEN 'F' THEN o_orderdate + to_hours(CAST(o_orderkey % 900 AS INTEGER)) END AS closed_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
RESPONSE = """response AS (
  SELECT i.issue_key, min(l_shipdate) AS first_response_at
  FROM lineitem JOIN cases i ON l_orderkey = i.issue_id
  WHERE l_shipdate >= i.created_at AND l_returnflag IN ('A', 'R') AND l_linenumber <> 7 AND CAST(l_suppkey AS VARCHAR) <> i.author_login
  GROUP BY 1
)"""
FACTS = f"""WITH {CASES}, {RESPONSE}, fact AS (
  SELECT i.*, r.first_response_at,
    CAST(strftime(i.created_at, '%Y%m%d') AS INTEGER) AS created_date_key, CAST(strftime(closed_at, '%Y%m%d') AS INTEGER) AS closed_date_key,
    state = 'closed' AS is_closed,
    round((epoch(r.first_response_at) - epoch(i.created_at)) / 3600, 2) AS hours_to_first_response,
    CASE WHEN state = 'closed' THEN round((epoch(closed_at) - epoch(created_at)) / 3600, 2) END AS hours_to_close,
    CASE WHEN state <> 'closed' THEN round((epoch(TIMESTAMP '{SNAPSHOT}') - epoch(created_at)) / 3600, 2) END AS open_age_hours,
    (epoch(coalesce(r.first_response_at, TIMESTAMP '{SNAPSHOT}')) - epoch(i.created_at)) / 3600 > 24 AS first_response_sla_breached
  FROM cases i LEFT JOIN response r USING (issue_key)
)"""
VERSIONS = """versions AS (
  SELECT user_id AS issue_id, event_type AS service_slug, CASE event_id % 4 WHEN 0 THEN 'closed' ELSE 'open' END AS state, ts AS valid_from,
    coalesce(lead(ts) OVER w, TIMESTAMP '9999-12-31 00:00:00') AS valid_to, lead(ts) OVER w IS NULL AS is_current
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""


# ---------------------------------------------------------------- merge and history
@query("""SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, l_shipdate AS ts FROM (
  SELECT *, count(*) FILTER (TRUE) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC ROWS UNBOUNDED PRECEDING) AS n FROM lineitem
) WHERE n = 1""")
def latest_wins(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    best = merge.latest(rows, "l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return best.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"))


@query("""SELECT coalesce(n.k, p.k) AS k, CASE WHEN n.k IS NULL OR n.ts < p.ts THEN p.status ELSE n.status END AS status,
  CASE WHEN n.k IS NULL OR n.ts < p.ts THEN NULL ELSE n.priority END AS priority, greatest(n.ts, p.ts) AS ts
FROM (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderdate AS ts FROM orders WHERE o_orderkey % 3 <> 0) p
FULL JOIN (SELECT o_orderkey AS k, lower(o_orderstatus) AS status, o_orderpriority AS priority, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER) - 2) AS ts
  FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 2) n ON n.k = p.k""")
def union_evolve(spark, sf):
    orders = t(spark, sf, "orders")
    key = F.col("o_orderkey")
    old = orders.where(key % 3 != 0).select(key.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"))
    shifted = F.col("o_orderdate") + F.make_dt_interval(days=(key % 5).cast("int") - 2)
    new = orders.where((key % 2 == 0) & (key % 5 != 2)).select(
        key.alias("k"), F.lower("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), shifted.alias("ts")
    )
    return merge.merge_latest(old, new, "k", "ts")


def _snapshots(spark, sf):
    """Two snapshots of orders: the second with changed, late, unchanged, gone and new keys."""
    orders, key = t(spark, sf, "orders"), F.col("o_orderkey")
    first = orders.where(key % 10 != 0).select(
        key.alias("issue_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("milestone"), F.col("o_orderdate").alias("updated_at")
    )
    moved = F.when(key % 4 == 0, F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1))).when(key % 4 == 1, F.col("o_orderdate")).when(
        key % 4 == 2, F.lit(None).cast("timestamp_ntz")
    ).otherwise(F.col("o_orderdate") - F.make_dt_interval(days=F.lit(1)))
    second = orders.where(key % 7 != 0).select(
        key.alias("issue_id"),
        F.when(key % 3 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("state"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("milestone"),
        moved.alias("updated_at"),
    )
    return first, second


SNAPSHOTS = """old AS (SELECT o_orderkey AS k, o_orderstatus AS state, o_orderpriority AS milestone, o_orderdate AS ts FROM orders WHERE o_orderkey % 10 <> 0),
snap AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS state,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS milestone,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + INTERVAL 1 DAY WHEN 1 THEN o_orderdate WHEN 2 THEN NULL ELSE o_orderdate - INTERVAL 1 DAY END AS ts
  FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT coalesce(o.k, s.k) AS k, o.k IS NULL AS is_new, s.k IS NULL AS is_gone,
  o.state IS DISTINCT FROM s.state OR o.milestone IS DISTINCT FROM s.milestone AS differs, coalesce(s.ts > o.ts, FALSE) AS newer,
  o.state AS o_state, o.milestone AS o_milestone, o.ts AS o_ts, s.state AS s_state, s.milestone AS s_milestone, s.ts AS s_ts
  FROM old o FULL JOIN snap s ON o.k = s.k)"""


@query(f"""WITH {SNAPSHOTS} SELECT CASE WHEN is_new THEN 'new' WHEN is_gone THEN 'gone' WHEN NOT differs THEN 'unchanged' WHEN newer THEN 'changed' ELSE 'late' END AS what,
  count(*) AS n FROM j GROUP BY 1""")
def scd2_classify(spark, sf):
    hashed = [
        s.select("issue_id", F.struct(attribute_hash("state", "milestone").alias("h"), F.col("updated_at").alias("ts")).alias(n))
        for s, n in zip(_snapshots(spark, sf), ("c", "s"), strict=True)
    ]
    joined = hashed[0].join(hashed[1], "issue_id", "full_outer")
    return joined.groupBy(scd2.action(F.col("s.h"), F.col("c.h"), F.col("s.ts"), F.col("c.ts")).alias("what")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SNAPSHOTS}, later AS (SELECT *, NOT is_new AND NOT is_gone AND differs AND newer AS changed FROM j)
SELECT k AS issue_id, o_state AS state, o_milestone AS milestone, o_ts AS valid_from, CASE WHEN changed THEN s_ts ELSE TIMESTAMP '9999-12-31 00:00:00' END AS valid_to,
  NOT changed AS is_current, 'r1' AS _run_id, sha256(o_state || '||' || coalesce(o_milestone, '∅')) AS attr_hash FROM later WHERE NOT is_new
UNION ALL SELECT k, s_state, s_milestone, s_ts, TIMESTAMP '9999-12-31 00:00:00', TRUE, 'r2', sha256(s_state || '||' || coalesce(s_milestone, '∅'))
  FROM later WHERE is_new OR changed""")
def scd2_merge(spark, sf):
    first, second = _snapshots(spark, sf)
    history = scd2.merge(None, first, "r1", "issue_id", ["state", "milestone"], "updated_at")
    return scd2.merge(history, second, "r2", "issue_id", ["state", "milestone"], "updated_at")


# ---------------------------------------------------------------- json, drift, partitions
@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_scan(spark, sf):
    return t(spark, sf, "events").select("event_id", F.from_json("props", "k string")["k"].alias("k"))


def _envelopes(spark, sf):
    orders, key = t(spark, sf, "orders"), F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.struct(
        F.when(key % 50 != 0, key).alias("id"),
        key.alias("number"),
        F.concat_ws(" ", F.lit("Order"), "o_orderpriority").alias("title"),
        F.upper("o_orderstatus").alias("state"),
        F.struct(F.col("o_custkey").cast("string").alias("login"), F.lit("User").alias("type")).alias("user"),
        F.array(F.struct(F.when(key % 3 == 0, "P0 Bug").otherwise("Feature").alias("name"))).alias("labels"),
        F.when(key % 20 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"),
        F.when(key % 5 == 0, key).alias("brand_new_field"),
        F.when(key % 2 == 0, "n").alias("node_id"),
        stamp.alias("created_at"),
        F.when(key % 13 == 0, "not a date").otherwise(stamp).alias("updated_at"),
    )
    text = F.when(key % 17 == 0, F.lit("{broken")).otherwise(F.to_json(payload))
    return orders.select(F.lit("r1").alias("_run_id"), stamp.alias("_ingested_at"), F.lit("org/a").alias("repo"), text.alias("payload"))


@query("""SELECT o_orderkey AS issue_id, 'org/a#' || o_orderkey AS issue_key, 'Order ' || o_orderpriority AS title, lower(o_orderstatus) AS state,
  CAST(o_custkey AS VARCHAR) AS author_login, CASE WHEN o_orderkey % 3 = 0 THEN 'p0 bug' ELSE 'feature' END AS labels_str,
  CAST(0 AS INTEGER) AS assignee_count, CAST(0 AS BIGINT) AS comment_count, o_orderkey % 3 = 0 AS is_bug, o_orderkey % 3 <> 0 AS is_feature_request,
  CAST(o_orderdate AS DATE) AS created_on, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS updated_on
FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 50 <> 0 AND o_orderkey % 20 <> 0""")
def json_contract(spark, sf):
    return contracts.issues(_envelopes(spark, sf)).select(
        "issue_id", "issue_key", "title", "state", "author_login", F.array_join(F.array_sort("labels"), ",").alias("labels_str"),
        "assignee_count", "comment_count", "is_bug", "is_feature_request",
        F.col("created_at").cast("date").alias("created_on"), F.col("updated_at").cast("date").alias("updated_on"),
    )


@query("SELECT 'brand_new_field' AS key, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 17 <> 0")
def schema_drift(spark, sf):
    return contracts.drift(_envelopes(spark, sf), contracts.ISSUES)


@query("""SELECT l_orderkey * 8 + l_linenumber AS comment_id, CASE WHEN l_orderkey % 9 = 0 THEN 'org/a#' ELSE 'org/a#' || l_orderkey END AS issue_key,
  CAST(l_suppkey AS VARCHAR) AS author_login, CASE WHEN l_linenumber <> 6 THEN 'User' END AS author_type,
  CASE l_returnflag WHEN 'A' THEN 'OWNER' WHEN 'R' THEN 'MEMBER' ELSE 'NONE' END AS author_association, l_returnflag IN ('A', 'R') AS is_maintainer,
  CAST(CASE WHEN l_linenumber = 5 THEN 0 ELSE length(l_shipdate::VARCHAR) END AS INTEGER) AS body_len, CAST(l_shipdate AS DATE) AS created_on
FROM lineitem WHERE l_orderkey % 17 <> 0""")
def comments_contract(spark, sf):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.struct(
        (key * 8 + line).alias("id"),
        F.concat(F.lit("https://x/repos/org/a/"), F.when(key % 9 == 0, "pulls/").otherwise("issues/"), key.cast("string")).alias("issue_url"),
        F.when(line != 5, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("body"),
        F.struct(F.col("l_suppkey").cast("string").alias("login"), F.when(line != 6, "User").alias("type")).alias("user"),
        F.when(F.col("l_returnflag") == "A", "OWNER").when(F.col("l_returnflag") == "R", "MEMBER").otherwise("NONE").alias("author_association"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )
    text = F.when(key % 17 == 0, F.lit("[1, 2")).otherwise(F.to_json(payload))
    rows = t(spark, sf, "lineitem").select(F.lit("r1").alias("_run_id"), stamp.alias("_ingested_at"), F.lit("org/a").alias("repo"), text.alias("payload"))
    return contracts.comments(rows).select(
        "comment_id", "issue_key", "author_login", "author_type", "author_association", "is_maintainer", "body_len", F.col("created_at").cast("date").alias("created_on")
    )


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01' GROUP BY 1")
def partition_prune(spark, sf):
    """Raw lines written to folders by day (here the month's first), and those from June 1999 on read again."""
    from .sources import files

    month = F.trunc("o_orderdate", "month")
    raw = t(spark, sf, "orders").select(
        F.lit("r1").alias("_run_id"),
        month.cast("string").alias("_ingested_at"),
        F.lit("rest").alias("_source"),
        F.concat(F.lit("org/"), "o_orderstatus").alias("repo"),
        F.parse_json(F.to_json(F.struct(F.col("o_orderkey").alias("id")))).alias("payload"),
        month.cast("string").alias("ingest_date"),
    )
    path = files.scratch(spark, "bronze")
    files.write_lines(raw, path)
    recent = files.read_bronze(spark, path, "1999-06-01")
    return recent.groupBy(F.substring(F.col("ingest_date").cast("string"), 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- whole stages, run twice
def _stages(spark, sf, gold: bool):
    """Orders land on one day, and every third again on the next: even keys a day newer, odd ones a day older (late).

    Returns the settings of a storage of its own, after both runs of silver and, if wanted, of gold.
    """
    from .plans import config, stages
    from .sources import files

    root = files.scratch(spark, "stages")
    settings = config.load() | {"storage_root": root, "state_root": f"{root}/_state"}
    orders, key = t(spark, sf, "orders"), F.col("o_orderkey")
    for run, day, some, shift in (("r1", "2024-01-01", F.lit(True), F.lit(0)), ("r2", "2024-01-02", key % 3 == 0, F.when(key % 2 == 0, 1).otherwise(-1))):
        stamp = F.date_format(F.col("o_orderdate") + F.make_dt_interval(days=shift), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        payload = F.struct(
            key.alias("id"),
            key.alias("number"),
            F.concat(F.lit("Order of "), "o_orderpriority").alias("title"),
            (F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open") if run == "r1" else F.lit("closed")).alias("state"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
            stamp.alias("updated_at"),
            F.lit(run).alias("brand_new_field"),
        )
        raw = orders.where(some).select(
            F.lit(run).alias("_run_id"),
            F.lit(f"{day}T00:00:00Z").alias("_ingested_at"),
            F.lit("rest").alias("_source"),
            F.concat(F.lit("org/"), "o_orderstatus").alias("repo"),
            F.parse_json(F.to_json(payload)).alias("payload"),
            F.lit(day).alias("ingest_date"),
        )
        files.write_lines(raw, f"{root}/bronze/issues")
        stages.silver(spark, settings, run)
        if gold:
            stages.gold(spark, settings, run, "2002-01-01 00:00:00")
    return settings


LANDED = """landed AS (SELECT o_orderkey AS k, 'org/' || o_orderstatus AS repo, 'Order of ' || o_orderpriority AS title, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS first_state, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS newer FROM orders)"""


@query(f"""WITH {LANDED} SELECT k AS issue_id, repo || '#' || k AS issue_key, title, CASE WHEN newer THEN 'closed' ELSE first_state END AS state,
  CAST(ts AS DATE) AS created_on, CAST(CASE WHEN newer THEN ts + INTERVAL 1 DAY ELSE ts END AS DATE) AS updated_on, CASE WHEN newer THEN 'r2' ELSE 'r1' END AS _run_id FROM landed""")
def stage_silver(spark, sf):
    from .plans import stages

    rows = stages.table(spark, _stages(spark, sf, gold=False), "silver.issues").read()
    return rows.select("issue_id", "issue_key", "title", "state", F.col("created_at").cast("date").alias("created_on"), F.col("updated_at").cast("date").alias("updated_on"), "_run_id")


@query(f"""WITH {LANDED}, moved AS (SELECT *, newer AND first_state = 'open' AS changed FROM landed)
SELECT k AS issue_id, first_state AS state, CAST(ts AS DATE) AS from_day, CASE WHEN changed THEN CAST(ts + INTERVAL 1 DAY AS DATE) ELSE DATE '9999-12-31' END AS to_day, NOT changed AS is_current, 'r1' AS _run_id FROM moved
UNION ALL SELECT k, 'closed', CAST(ts + INTERVAL 1 DAY AS DATE), DATE '9999-12-31', TRUE, 'r2' FROM moved WHERE changed""")
def stage_gold_history(spark, sf):
    from .plans import stages

    rows = stages.table(spark, _stages(spark, sf, gold=True), "gold.dim_issue_scd2").read()
    day = {x: F.col(f"valid_{x}").cast("date").alias(f"{x}_day") for x in ("from", "to")}
    return rows.select("issue_id", "state", day["from"], day["to"], "is_current", "_run_id")


@query(f"""WITH {LANDED} SELECT 'unknown' AS service_slug, repo, count(*) AS open_issues, count(*) AS open_awaiting_first_response,
  round(avg(round((epoch(TIMESTAMP '2002-01-01') - epoch(ts)) / 3600, 2)) / 24, 1) AS avg_open_age_days, round(max(round((epoch(TIMESTAMP '2002-01-01') - epoch(ts)) / 3600, 2)) / 24, 1) AS oldest_open_days
FROM landed WHERE NOT newer AND first_state = 'open' GROUP BY repo""")
def warehouse_load(spark, sf):
    """Both runs of the stages, then the gold tables and marts as tables of the catalog, and one mart read from there."""
    import uuid

    from .plans import stages

    settings = _stages(spark, sf, gold=True) | {"warehouse": f"tidemark_{uuid.uuid4().hex}"}
    stages.load(spark, settings)
    return spark.table(f"{settings['warehouse']}.mart_backlog_by_service")


def _event_stream(spark, sf):
    """All events as a stream of two batches, out of order, and a folder for the rest."""
    from .sources import files

    root, events = files.scratch(spark, "stream"), t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    events.repartition(4, "event_id").write.parquet(f"{root}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in"), root


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def stream_latest(spark, sf):
    """The events as a stream, merged into a snapshot table by user."""
    from .sources.snapshots import SnapshotTable
    from .streaming import files as streams

    rows, root = _event_stream(spark, sf)
    table = SnapshotTable(spark, f"{root}/latest")
    streams.merge_into(rows, table, "user_id", ["ts", "event_id"], f"{root}/checkpoint").awaitTermination()
    return table.read().select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf):
    """Each user and type once, of a stream that is deduplicated within a watermark wider than the table."""
    from .streaming import files as streams

    rows, root = _event_stream(spark, sf)
    rows = rows.withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    sink = streams.distinct_events(rows, "key", "ts", "3650 days").writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    sink.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 1000")
def null_filter(spark, sf):
    rows = t(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return rows.where(F.col("status").isNotNull() & ~F.when(F.col("o_totalprice") < 1000, 1).isNotNull()).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE list_contains(['1-URGENT', '2-HIGH'], o_orderpriority) AND (o_orderstatus = 'F' OR o_orderstatus = 'O')")
def in_filter(spark, sf):
    rows = t(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P"))
    return rows.select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 61 DAY")
def incremental_lookback(spark, sf):
    rows = t(spark, sf, "orders")
    cursor = rows.agg(F.max("o_orderdate").cast("string")).first()[0]
    return rest.lookback(rows, "o_orderdate", cursor, 61 * 24 * 60).select("o_orderkey", "o_orderdate")


# ---------------------------------------------------------------- rules
KEYWORDS = {"colour": r"\b(red|blue)\b", "shape": r"(?:ring|widget)", "size": r"small"}


@query("""SELECT p_partkey, CASE WHEN list_has_any(string_split(lower(p_name), ' '), ['red', 'blue']) THEN 'colour'
  WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'widget') THEN 'shape' WHEN contains(lower(p_name), 'small') THEN 'size' ELSE 'unknown' END AS slug FROM part""")
def keyword_map(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.coalesce(first_keyword(F.lower("p_name"), KEYWORDS), F.lit("unknown")).alias("slug"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'lambda' WHEN o_orderkey % 3 = 0 THEN 's3' WHEN contains(lower(o_orderpriority), 'urgent') THEN 'sqs' ELSE 'unknown' END AS slug FROM orders""")
def label_first_hit(spark, sf):
    key = F.col("o_orderkey")
    labels = F.filter(
        F.array(F.when(key % 3 == 0, "client-s3"), F.lit("other"), F.when(key % 4 == 0, "service/lambda"), F.when(key % 8 == 0, "service/late")), lambda x: x.isNotNull()
    )
    rows = t(spark, sf, "orders").select("o_orderkey", labels.alias("labels"), F.col("o_orderpriority").alias("title"))
    rules = {"label_patterns": ["^service/([a-z0-9-]+)$", "^client-([a-z0-9-]+)$"], "keyword_patterns": {"sqs": r"\burgent\b"}}
    return rows.select("o_orderkey", classify(rules).alias("slug"))


@query("""SELECT url, CASE WHEN s = 'http-example' THEN 'example' ELSE s END AS slug FROM (
  SELECT url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM pages)""")
def slug_normalize(spark, sf):
    return t(spark, sf, "pages").select("url", normalize_slug(F.col("url"), {"aliases": {"http-example": "example"}}).alias("slug"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels_str FROM lineitem GROUP BY 1")
def labels_str(spark, sf):
    sets = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("labels"))
    return sets.select("l_orderkey", F.array_join(F.array_sort("labels"), ",").alias("labels_str"))


@query("SELECT DISTINCT o_orderkey AS issue_id, unnest([o_orderpriority, o_orderstatus]) AS label FROM orders")
def bridge_explode(spark, sf):
    return star.bridge_labels(cases(spark, sf))


# ---------------------------------------------------------------- dimensions and fact
@query("""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS calendar_date, CAST(date_part('year', d) AS INTEGER) AS year,
  CAST(date_part('quarter', d) AS INTEGER) AS quarter, CAST(date_part('month', d) AS INTEGER) AS month, strftime(d, '%Y-%m') AS year_month,
  CAST(date_part('week', d) AS INTEGER) AS iso_week, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2026-01-10', INTERVAL 1 DAY)) AS d)""")
def dim_date(spark, sf):
    return star.dim_date(spark, "2023-12-25", "2026-01-10")


@query(f"WITH {CASES} SELECT DISTINCT repo, split_part(repo, '/', 1) AS owner, split_part(repo, '/', 2) AS repo_name FROM cases")
def dim_natural(spark, sf):
    return star.dim_repo(cases(spark, sf)).select("repo", "owner", "repo_name")


@query(f"""WITH {CASES} SELECT s AS service_slug, upper(replace(s, '-', ' ')) AS service_name, s = 'unknown' AS is_zero
FROM (SELECT service_slug AS s FROM cases WHERE service_slug <> 'unknown' UNION SELECT 'unknown')""")
def dim_service_unknown(spark, sf):
    rows = star.dim_service(cases(spark, sf).where("service_slug <> 'unknown'"))
    return rows.select("service_slug", "service_name", (F.col("service_key") == 0).alias("is_zero"))


@query("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY ALL")
def distinct_rows(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query(f"WITH {CASES}, {RESPONSE} SELECT * FROM response")
def first_response(spark, sf):
    return star.first_response(cases(spark, sf), replies(spark, sf), RESPONDERS)


@query(f"""{FACTS} SELECT issue_id, issue_key, created_date_key, closed_date_key, created_at, first_response_at, closed_at, is_closed, is_bug,
  hours_to_first_response, hours_to_close, open_age_hours, first_response_sla_breached FROM fact""")
def fact_build(spark, sf):
    return facts(spark, sf).select(
        "issue_id", "issue_key", "created_date_key", "closed_date_key", "created_at", "first_response_at", "closed_at", "is_closed", "is_bug",
        "hours_to_first_response", "hours_to_close", "open_age_hours", "first_response_sla_breached",
    )


# ---------------------------------------------------------------- marts
@query(f"""{FACTS} SELECT strftime(created_at, '%Y-%m') AS year_month, service_slug, count(*) AS issues_opened,
  count(*) FILTER (is_closed) AS issues_closed_to_date,
  quantile_cont(hours_to_first_response, 0.5) AS median_hours_to_first_response, quantile_cont(hours_to_first_response, 0.9) AS p90_hours_to_first_response,
  quantile_cont(hours_to_close, 0.5) AS median_hours_to_close,
  count(*) FILTER (first_response_sla_breached) / count(*) AS first_response_sla_breach_rate, count(*) FILTER (is_bug) / count(*) AS bug_share
FROM fact GROUP BY 1, 2""")
def mart_health_monthly(spark, sf):
    gold(spark, sf)
    return marts.mart(spark, "service_health_monthly")


@query(f"""{FACTS} SELECT service_slug, repo, count(*) AS open_issues, count(*) - count(first_response_at) AS open_awaiting_first_response,
  round(avg(open_age_hours) / 24, 1) AS avg_open_age_days, round(max(open_age_hours) / 24, 1) AS oldest_open_days
FROM fact WHERE state = 'open' GROUP BY 1, 2""")
def mart_backlog(spark, sf):
    gold(spark, sf)
    return marts.mart(spark, "backlog_by_service")


@query(f"""{FACTS} SELECT strftime(closed_at, '%Y-%m') AS year_month, service_slug, count(*) AS closed_issues, count(*) FILTER (issue_id % 6 = 0) AS duplicate_issues,
  avg(CAST(issue_id % 6 = 0 AS INTEGER)) AS repeat_issue_rate FROM fact WHERE is_closed GROUP BY 1, 2""")
def mart_repeat_rate(spark, sf):
    gold(spark, sf)
    return marts.mart(spark, "repeat_issue_rate")


ASOF = f"""WITH {VERSIONS}, marks AS (
  SELECT CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS asof_ts FROM (SELECT unnest(generate_series(
    (SELECT date_trunc('day', min(valid_from)) FROM versions), (SELECT date_trunc('day', max(valid_from)) FROM versions), INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) = 0
), weekly AS (
  SELECT asof_ts, service_slug, count(*) AS open_issues_asof FROM marks JOIN versions ON valid_from <= asof_ts AND asof_ts < valid_to WHERE state = 'open' GROUP BY 1, 2
)"""


def _asof(spark, sf):
    gold(spark, sf)
    return marts.mart(spark, "open_backlog_asof_weekly").withColumn("asof_ts", F.col("asof_ts").cast("timestamp_ntz"))


@query(f"{ASOF} SELECT * FROM weekly")
def mart_asof_weekly(spark, sf):
    return _asof(spark, sf)


@query("SELECT n_nationkey, lo, hi FROM nation, (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)")
def cross_bounds(spark, sf):
    bounds = t(spark, sf, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return t(spark, sf, "nation").select("n_nationkey").crossJoin(bounds)  # one row


# ---------------------------------------------------------------- aggregates
@query("""SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_quantity > 25) AS n_large,
  CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_full FROM lineitem GROUP BY 1""")
def cond_count(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_linestatus").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
        F.sum((F.col("l_quantity") > 25).cast("long")).alias("n_large"),
        F.sum(F.when(F.col("l_discount") == 0, 1).otherwise(0)).alias("n_full"),
    )


@query("SELECT l_returnflag, count(*) FILTER (l_quantity > 25) / count(*) AS share FROM lineitem GROUP BY 1")
def cond_ratio(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("share"))


@query("SELECT event_type, arg_min(value, value) AS lo, arg_max(value, value) AS hi, round(sum(value) / count(*), 6) AS mean, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def min_max_avg(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


# Exact for any number of values; the name is that of the reference's approx_percentile.
@query(f"""{FACTS} SELECT strftime(created_at, '%Y-%m') AS year_month, count(*) AS issues_opened,
  quantile_disc(hours_to_first_response, 0.5) AS median_hours_to_first_response, quantile_disc(hours_to_close, 0.5) AS median_hours_to_close FROM fact GROUP BY 1""")
def approx_pct(spark, sf):
    gold(spark, sf)
    return marts.monthly_medians(spark)


# ---------------------------------------------------------------- dashboard
def _opened(spark, sf):
    gold(spark, sf)
    return dashboard.opened(spark, "1997-03-01")


OPENED = f"""{FACTS}, opened AS (SELECT * FROM fact WHERE created_at >= DATE '1997-03-01')"""


@query(f"""{OPENED} SELECT count(*) AS n, quantile_cont(hours_to_first_response, 0.5) AS ttfr, count(*) FILTER (first_response_sla_breached) / count(*) AS breach,
  count(*) FILTER (state = 'open') AS open_n, quantile_cont(hours_to_close, 0.5) AS ttc FROM opened""")
def dash_kpi(spark, sf):
    return dashboard.kpi(_opened(spark, sf))


@query(f"{OPENED} SELECT service_slug, count(*) AS issues FROM opened WHERE service_slug <> 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def dash_volume_topk(spark, sf):
    return dashboard.volume(_opened(spark, sf), 3)


@query(f"""{FACTS} SELECT service_slug, repo, count(*) AS open_issues, count(*) - count(first_response_at) AS open_awaiting_first_response
FROM fact WHERE state = 'open' GROUP BY 1, 2 ORDER BY 4 DESC, 1, 2 LIMIT 20""")
def dash_backlog_topk(spark, sf):
    gold(spark, sf)
    rows = marts.mart(spark, "backlog_by_service")
    return dashboard.backlog(rows).select("service_slug", "repo", "open_issues", "open_awaiting_first_response")


@query(f"{OPENED} SELECT CAST(date_trunc('week', created_at) AS TIMESTAMP) AS week_start, quantile_cont(hours_to_first_response, 0.5) AS hours FROM opened GROUP BY 1 ORDER BY 1")
def dash_weekly_median(spark, sf):
    return dashboard.weekly_median(_opened(spark, sf)).withColumn("week_start", F.col("week_start").cast("timestamp_ntz"))


@query(f"{ASOF} SELECT service_slug, max(open_issues_asof) AS peak FROM weekly GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def dash_top_services(spark, sf):
    return dashboard.top_services(_asof(spark, sf), 3)


@query(f"""{ASOF} SELECT asof_ts, max(open_issues_asof) FILTER (service_slug = 'click') AS click, max(open_issues_asof) FILTER (service_slug = 'view') AS "view" FROM weekly GROUP BY 1""")
def dash_pivot(spark, sf):
    rows = _asof(spark, sf)
    return rows.groupBy("asof_ts").pivot("service_slug", ["click", "view"]).agg(F.first("open_issues_asof", ignorenulls=True))


# ---------------------------------------------------------------- data quality
def _checked(spark, rows, specs, tables=None, now="2024-02-01 00:00:00"):
    at = F.lit(now).cast("timestamp_ntz")
    results = quality.evaluate(rows, specs, "t", lambda n: tables[n], at)
    return spark.createDataFrame([(r.check, r.severity, r.passed, r.value) for r in results], "check string, severity string, passed boolean, value double")


def _dq(check: str, passed: str, value: str, severity: str = "error") -> str:
    return f"SELECT '{check}' AS \"check\", '{severity}' AS severity, {passed} AS passed, CAST({value} AS DOUBLE) AS value"


@query(_dq("row_count_min", "count(*) >= 1", "count(*)") + " FROM orders")
def dq_row_count(spark, sf):
    return _checked(spark, t(spark, sf, "orders"), [{"check": "row_count_min", "min": 1}])


@query(_dq("not_null:o_orderkey,status", "count(*) FILTER (o_orderstatus = 'P') = 0", "count(*) FILTER (o_orderstatus = 'P')", "warn") + " FROM orders")
def dq_not_null(spark, sf):
    rows = t(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return _checked(spark, rows, [{"check": "not_null", "columns": ["o_orderkey", "status"], "severity": "warn"}])


@query(
    _dq("unique:l_orderkey,l_linenumber", "n = 0", "n") + " FROM (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))"
    + " UNION ALL " + _dq("unique:l_orderkey", "n = 0", "n") + " FROM (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1))"
)
def dq_unique(spark, sf):
    return _checked(spark, t(spark, sf, "lineitem"), [{"check": "unique", "columns": ["l_orderkey", "l_linenumber"]}, {"check": "unique", "columns": ["l_orderkey"]}])


@query(_dq("accepted_values:status", "FALSE", "count(*) FILTER (o_orderstatus <> 'F')") + " FROM orders")
def dq_accepted(spark, sf):
    rows = t(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return _checked(spark, rows, [{"check": "accepted_values", "column": "status", "values": ["F"]}])


@query(_dq("priced", "FALSE", "count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice >= 100000)") + " FROM orders")
def dq_expression(spark, sf):
    rows = t(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return _checked(spark, rows, [{"check": "expression", "name": "priced", "expr": "price < 100000"}])


@query(_dq("freshness:ts", "h <= 24", "h", "warn") + " FROM (SELECT (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3.6e9 AS h FROM events)")
def dq_freshness(spark, sf):
    return _checked(spark, t(spark, sf, "events"), [{"check": "freshness", "column": "ts", "max_age_hours": 24, "severity": "warn"}])


@query(_dq("max_null_fraction:status", "f <= 0.2", "f") + " FROM (SELECT avg(CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END) AS f FROM orders)")
def dq_null_fraction(spark, sf):
    rows = t(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return _checked(spark, rows, [{"check": "max_null_fraction", "column": "status", "max_fraction": 0.2}])


@query(_dq("open_share", "f <= 0.6", "f") + " FROM (SELECT avg(CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END) AS f FROM orders)")
def dq_fraction_equal(spark, sf):
    rows = t(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return _checked(spark, rows, [{"check": "max_fraction_equal", "column": "status", "value": "O", "max_fraction": 0.6, "name": "open_share"}])


@query(
    _dq("foreign_key:doc_id", "n = 0", "n") + " FROM (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
    + " UNION ALL " + _dq("nulls", "n = 0", "n") + " FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 10 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels))"
)
def dq_foreign_key(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("maybe"))
    ref = {"ref_table": "labels", "ref_column": "doc_id", "check": "foreign_key"}
    return _checked(spark, rows, [ref | {"column": "doc_id"}, ref | {"column": "maybe", "name": "nulls"}], {"labels": t(spark, sf, "labels")})


@query(f"WITH {VERSIONS}, broken AS (SELECT * REPLACE (is_current AND issue_id % 9 <> 0 AS is_current) FROM versions) "
       + _dq("scd2_one_current:issue_id", "n = 0", "n") + " FROM (SELECT count(*) AS n FROM (SELECT 1 FROM broken GROUP BY issue_id HAVING count(*) FILTER (is_current) <> 1))")
def dq_one_current(spark, sf):
    rows = versions(spark, sf).withColumn("is_current", F.col("is_current") & (F.col("issue_id") % 9 != 0))
    return _checked(spark, rows, [{"check": "scd2_one_current", "key": "issue_id"}])


@query(f"""WITH {VERSIONS}, broken AS (SELECT * REPLACE (CASE WHEN state = 'closed' AND year(valid_to) < 9999 THEN valid_to + INTERVAL 1 HOUR ELSE valid_to END AS valid_to) FROM versions),
  following AS (SELECT valid_to, lead(valid_from) OVER (PARTITION BY issue_id ORDER BY valid_from, valid_to) AS f FROM broken) """
       + _dq("scd2_no_overlap:issue_id", "n = 0", "n") + " FROM (SELECT count(*) AS n FROM following WHERE f < valid_to)")
def dq_no_overlap(spark, sf):
    longer = F.when((F.col("state") == "closed") & ~F.col("is_current"), F.col("valid_to") + F.make_dt_interval(hours=F.lit(1))).otherwise(F.col("valid_to"))
    return _checked(spark, versions(spark, sf).withColumn("valid_to", longer), [{"check": "scd2_no_overlap", "key": "issue_id"}])


@query("""SELECT * FROM (VALUES ('error', TRUE), ('warn', TRUE), ('never', FALSE), ('warnings only, error', FALSE), ('warnings only, warn', TRUE), ('unknown type', TRUE)) v(what, raised)
UNION ALL SELECT 'silver tables: ' || (SELECT count(*) FROM orders), FALSE""")
def dq_gate(spark, sf):
    """What stops a run, and which tables a prefix chooses."""
    specs = [{"check": "accepted_values", "column": "o_orderstatus", "values": ["F"], "severity": x} for x in ("error", "warn")]
    counted = {"check": "row_count_min", "min": 1}
    asked = []

    def resolve(name):
        asked.append(name)
        return t(spark, sf, "orders")

    results = quality.run({"silver.orders": [*specs, counted], "gold.orders": [counted]}, resolve, "silver")
    assert asked == ["silver.orders"]

    def raises(error, f, *args):
        try:
            f(*args)
        except error:
            return True
        return False

    found = [(x, raises(quality.DataQualityError, quality.gate, results, x)) for x in ("error", "warn", "never")]
    found += [(f"warnings only, {x}", raises(quality.DataQualityError, quality.gate, results[1:], x)) for x in ("error", "warn")]
    found.append(("unknown type", raises(ValueError, quality.evaluate, t(spark, sf, "orders"), [{"check": "none such"}], "t", resolve)))
    found.append((f"silver tables: {int(results[2].value)}", False))
    return spark.createDataFrame(found, "what string, raised boolean")


@query(f"""WITH {VERSIONS}, broken AS (SELECT * REPLACE (CASE WHEN state = 'closed' AND year(valid_to) < 9999 THEN valid_to - INTERVAL 1 MINUTE ELSE valid_to END AS valid_to) FROM versions),
  following AS (SELECT valid_to, lead(valid_from) OVER (PARTITION BY issue_id ORDER BY valid_from, valid_to) AS f FROM broken) """
       + _dq("scd2_no_gap:issue_id", "n = 0", "n", "warn") + " FROM (SELECT count(*) AS n FROM following WHERE f > valid_to)")
def dq_no_gap(spark, sf):
    shorter = F.when((F.col("state") == "closed") & ~F.col("is_current"), F.col("valid_to") - F.make_dt_interval(mins=F.lit(1))).otherwise(F.col("valid_to"))
    return _checked(spark, versions(spark, sf).withColumn("valid_to", shorter), [{"check": "scd2_no_gap", "key": "issue_id", "severity": "warn"}])


@query("""SELECT 'ErrorChecksFailed' AS name, CAST(NULL AS VARCHAR) AS "check", CAST(1 AS DOUBLE) AS value
UNION ALL SELECT 'CheckFailed', 'row_count_min', 0 UNION ALL SELECT 'CheckValue', 'row_count_min', count(*) FROM orders
UNION ALL SELECT 'CheckFailed', 'accepted_values:o_orderstatus', 1 UNION ALL SELECT 'CheckValue', 'accepted_values:o_orderstatus', count(*) FILTER (o_orderstatus <> 'F') FROM orders
UNION ALL SELECT 'CheckFailed', 'unique:o_orderkey', 0 UNION ALL SELECT 'CheckValue', 'unique:o_orderkey', 0""")
def dq_metrics(spark, sf):
    specs = [{"check": "row_count_min", "min": 1}, {"check": "accepted_values", "column": "o_orderstatus", "values": ["F"]}, {"check": "unique", "columns": ["o_orderkey"]}]
    points = quality.metrics(quality.evaluate(t(spark, sf, "orders"), specs, "orders", lambda n: None))
    return spark.createDataFrame([(p["name"], p.get("check"), p["value"]) for p in points], "name string, check string, value double")


# ---------------------------------------------------------------- model inputs
@query("""SELECT o_orderkey AS issue_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(0.8 * count(*) OVER ()) AS is_train FROM orders""")
def time_split(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("issue_id"), F.col("o_orderdate").alias("created_at"))
    return ml.time_split(rows).select("issue_id", "is_train")


@query(f"""{FACTS} SELECT issue_id, CASE WHEN is_closed THEN CAST(hours_to_close > 336 AS DOUBLE) WHEN open_age_hours > 336 THEN 1.0 END AS label FROM fact""")
def ml_label(spark, sf):
    return facts(spark, sf).select("issue_id", ml.label(14).alias("label"))


@query("""SELECT doc_id AS issue_id, round(ln(1 + CASE WHEN doc_id % 10 <> 0 THEN length(text) ELSE 0 END), 6) AS log_body_len, length(substr(text, 1, doc_id % 50)) AS title_len,
  CAST(doc_id % 3 = 0 AS INTEGER) AS code_block FROM documents""")
def ml_features(spark, sf):
    key = F.col("doc_id")
    rows = t(spark, sf, "documents").select(
        key.alias("issue_id"),
        F.when(key % 10 != 0, F.length("text")).alias("body_len"),
        F.substring("text", F.lit(1), (key % 50).cast("int")).alias("title"),
        F.when(key % 3 == 0, F.lit(True)).when(key % 3 == 1, F.lit(False)).alias("has_code_block"),
    )
    rows = rows.withColumns(ml.numeric()).withColumn("log_body_len", F.round("log_body_len", 6))
    return rows.select("issue_id", "log_body_len", F.col("title_len").cast("long").alias("title_len"), "code_block")


@query(f"""{FACTS}, labelled AS (SELECT issue_id, floor(o_totalprice) AS risk, CASE WHEN is_closed THEN CAST(hours_to_close > 336 AS DOUBLE) WHEN open_age_hours > 336 THEN 1.0 END AS label FROM fact)
SELECT avg(label) AS precision_top FROM (SELECT label FROM labelled WHERE label IS NOT NULL ORDER BY risk DESC, issue_id LIMIT 100)""")
def ml_precision_topk(spark, sf):
    rows = facts(spark, sf).withColumn("label", ml.label(14)).where("label is not null").withColumn("risk", F.col("body_len") / 1e6)
    return ml.precision_top(rows, "risk", 100)


@query(f"""{FACTS} SELECT issue_id, repo, service_slug, is_closed, hours_to_close, open_age_hours, round(ln(1 + floor(o_totalprice)), 6) AS log_body_len,
  length('Order of ' || o_orderpriority) AS title_len, CAST(issue_id % 2 = 0 AS INTEGER) AS code_block FROM fact WHERE issue_id % 5 <> 0""")
def ml_feature_join(spark, sf):
    """The features of the issues that have a fact."""
    issues = cases(spark, sf).withColumn("title", F.concat(F.lit("Order of "), F.get("labels", F.lit(0))))
    rows = ml.features(issues, facts(spark, sf).where("issue_id % 5 <> 0")).withColumn("log_body_len", F.round("log_body_len", 6))
    return rows.select("issue_id", "repo", "service_slug", "is_closed", "hours_to_close", "open_age_hours", "log_body_len", F.col("title_len").cast("long").alias("title_len"), "code_block")


@query(r"""WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z][a-z0-9_-]{2,}') AS l FROM part),
t AS (SELECT p_partkey, unnest(list_concat(l, list_transform(generate_series(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM w)
SELECT term, count(DISTINCT p_partkey) AS n FROM t GROUP BY 1""")
def ml_terms(spark, sf):
    """How many part names hold each word and each pair of words."""
    return ml.document_frequency(t(spark, sf, "part").select(F.col("p_name").alias("title")))


@query("SELECT * FROM (VALUES (59, FALSE, FALSE), (60, TRUE, FALSE), (199, TRUE, FALSE), (200, TRUE, TRUE)) v(n, topics, risks)")
def ml_gates(spark, sf):
    """From how many issues on topics and risks are made."""
    found = []
    for n in (59, 60, 199, 200):
        own = F.col("id")
        rows = spark.range(0, n, 1, 1).select(
            own.alias("issue_id"), F.lit("o/a").alias("repo"), F.when(own % 2 == 0, "alpha beta gamma").otherwise("delta omega sigma").alias("title"),
            F.lit("s3").alias("service_slug"), F.lit("NONE").alias("author_association"), F.timestamp_seconds(own).alias("created_at"),
            F.lit(True).alias("is_closed"), F.when(own % 2 == 0, 1.0).otherwise(1000.0).alias("hours_to_close"), F.lit(None).cast("double").alias("open_age_hours"),
            own.alias("body_len"), F.lit(False).alias("has_code_block"),
        ).withColumns(ml.numeric())
        found.append((n, ml.topics(rows, 2) is not None, ml.escalation(rows, 14) is not None))
    return spark.createDataFrame(found, "n int, topics boolean, risks boolean")


@query()
def ml_topics(spark, sf):
    """Topics of the documents' whole texts."""
    rows = t(spark, sf, "documents").select(F.col("doc_id").alias("issue_id"), F.col("text").alias("title"))
    return ml.topics(rows, 4)


@query()
def ml_escalation(spark, sf):
    """Slow resolution: orders with an odd price take long, as far as their text and numbers tell."""
    rows = cases(spark, sf).withColumn("title", F.concat_ws(" ", "service_slug", "repo")).select(
        "issue_id", "repo", "title", "service_slug", "author_association", "created_at"
    )
    return ml.escalation(rows.join(facts(spark, sf).drop("created_at", "author_association"), "issue_id").withColumns(ml.numeric()), 14)[0]


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def snapshot_roundtrip(spark, sf):
    """Published to a snapshot table in a shared folder, and read back."""
    from .sources import files
    from .sources.snapshots import SnapshotTable

    table = SnapshotTable(spark, files.scratch(spark, "snapshot_roundtrip"))
    table.publish(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "r1")
    return table.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- scalar functions
@query("""SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, c_name || '#' || c_nationkey AS joined, CAST(length(c_name) AS INTEGER) AS len,
  strpos(c_mktsegment, 'BUILD') > 0 AS has, suffix(c_name, '7') AS ends, string_split(c_name, '#')[2] AS part FROM customer""")
def scalar_string(spark, sf):
    return t(spark, sf, "customer").select(
        "c_custkey", F.lower("c_name").alias("lo"), F.upper("c_mktsegment").alias("up"), F.concat_ws("#", "c_name", "c_nationkey").alias("joined"),
        F.length("c_name").alias("len"), F.contains("c_mktsegment", F.lit("BUILD")).alias("has"), F.endswith("c_name", F.lit("7")).alias("ends"),
        F.get(F.split("c_name", "#"), F.lit(1)).alias("part"),
    )


@query("""SELECT page_id, coalesce(regexp_extract(url, 'page=([0-9]+)', 1), '') AS page, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_matches(url, 'p1') AS hit FROM pages""")
def scalar_regex(spark, sf):
    return t(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "page=([0-9]+)", 1).alias("page"), F.regexp_replace("url", "[0-9]+", "#").alias("masked"), F.col("url").rlike("p1").alias("hit")
    )


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN o_orderpriority ELSE o_orderstatus END AS x, o_orderstatus = 'P' AS missing FROM orders""")
def scalar_null(spark, sf):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t(spark, sf, "orders").select("o_orderkey", F.coalesce(status, "o_orderpriority").alias("x"), status.isNull().alias("missing"))


@query("""SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, strftime(o_orderdate, '%Y-%m') AS year_month, CAST(isodow(o_orderdate) % 7 + 1 AS INTEGER) AS dow,
  CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(o_orderdate AS DATE) AS day, o_orderdate + INTERVAL 1 DAY AS tomorrow,
  CAST(epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate) AS DOUBLE) / 3600 AS hours FROM orders""")
def scalar_date(spark, sf):
    from .functions.columns import date_key

    day = F.col("o_orderdate")
    return t(spark, sf, "orders").select(
        "o_orderkey", date_key(day).alias("date_key"), F.date_format(day, "yyyy-MM").alias("year_month"), F.dayofweek(day).alias("dow"), F.weekofyear(day).alias("week"),
        F.quarter(day).alias("quarter"), day.cast("date").alias("day"), (day + F.make_dt_interval(days=F.lit(1))).alias("tomorrow"),
        hours_between(day, F.lit(SNAPSHOT).cast("timestamp_ntz")).alias("hours"),
    )


@query("SELECT p_partkey, round(ln(p_retailprice + 1), 6) AS log, abs(p_size - 25) AS off, round(p_retailprice / 24, 4) AS days, CAST(p_size AS DOUBLE) / 8 AS eighth FROM part")
def scalar_math(spark, sf):
    return t(spark, sf, "part").select(
        "p_partkey", F.round(F.log1p("p_retailprice"), 6).alias("log"), F.abs(F.col("p_size") - 25).alias("off"), F.round(F.col("p_retailprice") / 24, 4).alias("days"), (F.col("p_size") / 8).alias("eighth")
    )


# The key of 'tidemark' is XXH64 with seed 42 without its sign bit, taken from another library. Fixed value.
@query("""SELECT o_orderkey, sha256(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '∅') || '||' || o_orderpriority || '||' || o_custkey) AS attr_hash,
  (SELECT count(DISTINCT o_orderkey) FROM orders) AS n_keys, TRUE AS positive, 1214682197006892788 AS known FROM orders""")
def scalar_hash(spark, sf):
    rows = t(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    keys = rows.agg(F.countDistinct(surrogate("o_orderkey")).alias("n_keys"), (F.min(surrogate("o_orderkey")) >= 0).alias("positive"))  # one row
    hashed = rows.select("o_orderkey", attribute_hash("status", "o_orderpriority", "o_custkey").alias("attr_hash"))
    return hashed.crossJoin(keys).withColumn("known", surrogate(F.lit("tidemark")))


@query("""SELECT o_orderkey, array_to_string(list_sort(l), ',') AS sorted, CAST(len(l) AS INTEGER) AS n, list_contains(l, 'F') AS has_f, l[2] AS second,
  array_to_string([lower(x) FOR x IN l IF x <> 'P'], '+') AS kept FROM (SELECT o_orderkey, [o_orderpriority, o_orderstatus] AS l FROM orders)""")
def scalar_array(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("l"))
    return rows.select(
        "o_orderkey", F.array_join(F.array_sort("l"), ",").alias("sorted"), F.size("l").alias("n"), F.exists("l", lambda x: x == "F").alias("has_f"), F.try_element_at("l", F.lit(2)).alias("second"),
        F.array_join(F.transform(F.filter("l", lambda x: x != "P"), lambda x: F.lower(x)), "+").alias("kept"),
    )


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS state, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS known FROM orders")
def scalar_map(spark, sf):
    names = F.create_map(F.lit("F"), F.lit("closed"), F.lit("O"), F.lit("open"))
    found = F.try_element_at(names, F.col("o_orderstatus"))
    return t(spark, sf, "orders").select("o_orderkey", found.alias("state"), F.coalesce(found, "o_orderstatus").alias("known"))


@query("SELECT event_id, array_to_string(json_keys(props), ',') AS keys, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.none') AS VARCHAR) AS absent FROM events")
def scalar_json(spark, sf):
    parsed = F.from_json("props", "k long, none string")
    return t(spark, sf, "events").select("event_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"), parsed["k"].alias("k"), parsed["none"].alias("absent"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS band, CASE WHEN l_tax = 0 THEN 0 ELSE 1 END AS taxed FROM lineitem")
def scalar_cond(spark, sf):
    q = F.col("l_quantity")
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.when(q > 40, "high").when(q > 20, "mid").otherwise("low").alias("band"), F.expr("if(l_tax = 0, 0, 1)").alias("taxed")
    )
