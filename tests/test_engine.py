"""History, silver, checks, ingest, snapshots, rules and streams, on small inputs."""

import datetime
import json
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.functions.columns import utc_timestamp
from tidemark.functions.rules import classify, normalize_slug
from tidemark.operators import contracts, merge, quality, scd2, star
from tidemark.plans import cli, config, marts, stages
from tidemark.sources import files, rest
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming import files as streams

TS = "2024-01-0{}T00:00:00Z"


# ---------------------------------------------------------------- history
SNAP = "issue_id long, issue_key string, state string, labels_str string, service_slug string, milestone string, assignee_count int, updated_at string"


def snap(spark, *rows):
    full = [(i, f"k{i}", state, "", "s3", milestone, 0, day) for i, state, milestone, day in rows]
    return spark.createDataFrame(full, SNAP).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def merged(spark, previous, snapshot, run):
    seen = Observation(run)
    out = scd2.merge(previous, snapshot, run, "issue_id", star.TRACKED, "updated_at", ("issue_key",), seen)
    rows = out.collect()
    return spark.createDataFrame(rows, out.schema), {k: v for k, v in seen.get.items()}


def test_history_cases_and_idempotence(spark):
    first = snap(spark, (1, "open", None, "2024-01-01"), (2, "open", None, "2024-01-05"), (3, "open", None, "2024-01-01"), (4, "open", None, "2024-01-01"))
    one, stats = merged(spark, None, first, "r1")
    assert stats == {"inserted_new": 4, "changed": 0, "late_ignored": 0}
    # 1 changed, 2 late, 3 undated, 4 gone, 5 new
    second = snap(spark, (1, "closed", None, "2024-01-03"), (2, "closed", None, "2024-01-02"), (3, "closed", "m", None), (5, "open", None, "2024-01-04"))
    two, stats = merged(spark, one, second, "r2")
    assert stats == {"inserted_new": 1, "changed": 1, "late_ignored": 2}
    rows = {(r.issue_id, r.state): r for r in two.collect()}
    assert set(rows) == {(1, "open"), (1, "closed"), (2, "open"), (3, "open"), (4, "open"), (5, "open")}
    closed = rows[1, "open"]
    assert (str(closed.valid_to), closed.is_current, closed._run_id) == ("2024-01-03 00:00:00", False, "r1")
    assert rows[1, "closed"]._run_id == "r2" and all(rows[k].is_current for k in rows if k != (1, "open"))
    three, stats = merged(spark, two, second, "r3")
    assert stats["inserted_new"] == stats["changed"] == 0 and sorted(three.collect(), key=str) == sorted(two.collect(), key=str)
    results = quality.evaluate(two, [{"check": c, "key": "issue_id"} for c in ("scd2_one_current", "scd2_no_overlap", "scd2_no_gap")], "t", lambda n: None)
    assert all(r.passed for r in results)
    assert {r.issue_id for r in scd2.as_of(two, spark.sql("SELECT timestamp '2024-01-03' AS asof_ts")).where("state = 'closed'").collect()} == {1}


# ---------------------------------------------------------------- silver and rules
def envelope(payload, run="r1", at=TS.format(9), repo="o/a"):
    return (run, at, "s", repo, payload if isinstance(payload, str) else json.dumps(payload))


def issue(i, **more):
    base = {"id": i, "number": i, "title": "t", "state": "OPEN", "user": {"login": "u"}, "labels": [{"name": "Bug"}], "created_at": TS.format(1), "updated_at": TS.format(2), "closed_at": None}
    return base | more


def test_contract_drift_and_latest(spark):
    rows = [
        envelope(issue(1, updated_at=TS.format(5), title="new")),
        envelope(issue(1, title="old", brand_new_field=1), "r2"),
        envelope(issue(2, pull_request={"url": "x"})),
        envelope("{broken"),
        envelope("[]"),
        envelope(issue(3, body="a ``` b", assignees=[{"login": "x"}], updated_at="2024-01-02T00:00:00.5Z", labels=[])),
    ]
    lines = spark.createDataFrame(rows, contracts.ENVELOPE)
    assert {r.key: r.n for r in contracts.drift(lines, contracts.ISSUES).collect()} == {"brand_new_field": 1}
    out = {r.issue_id: r for r in merge.latest(contracts.issues(lines), "issue_id", "updated_at", "_ingested_at", "_run_id").collect()}
    assert set(out) == {1, 3} and out[1].title == "new" and out[1].state == "open" and out[1].is_bug
    assert (out[1].assignee_count, out[3].assignee_count, out[3].has_code_block, out[3].updated_at) == (0, 1, True, None)
    assert out[3].is_bug is False


def test_rules(spark):
    rules = config.load()["service_map"]
    cases = [
        (["p2", "client-sqs"], "Glue crawler", "sqs"),
        (["aws-cdk-lib/aws-apigatewayv2-integrations"], "", "apigateway"),
        (["billing-service"], None, "billing"),
        ([], "Aurora failover is slow", "rds"),
        ([], "Typo in the manual", "unknown"),
        (None, None, "unknown"),
        (["service/events", "client-s3"], "a bucket", "eventbridge"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, labels array<string>, title string")
    got = {r.i: r.s for r in df.select("i", normalize_slug(classify(rules), rules).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c for *_, c in cases]


def test_timestamps_that_do_not_parse_are_null(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("x",), (None,)], "t string").select(utc_timestamp("t").alias("t"))
    assert [r.t is None for r in df.collect()] == [False, True, True]


# ---------------------------------------------------------------- checks
def test_checks(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (None, None, 3.0)], "k long, s string, x double")
    specs = [
        {"check": "row_count_min", "min": 4},
        {"check": "not_null", "columns": ["k", "s"]},
        {"check": "unique", "columns": ["k"]},
        {"check": "accepted_values", "column": "s", "values": ["a", "b"]},
        {"check": "expression", "name": "e", "expr": "x > 2"},
        {"check": "max_null_fraction", "column": "x", "max_fraction": 0.5, "severity": "warn"},
        {"check": "max_fraction_equal", "column": "s", "value": "a", "max_fraction": 0.3},
    ]
    results = quality.evaluate(df, specs, "t", lambda n: None)
    assert [(r.value, r.passed) for r in results] == [(3, False), (1, False), (1, False), (1, False), (1, False), (pytest.approx(1 / 3), True), (pytest.approx(1 / 3), False)]
    with pytest.raises(quality.DataQualityError, match="unique:k"):
        quality.gate(results)
    quality.gate(results, "never")
    empty = quality.evaluate(df.limit(0), [specs[0], specs[5], {"check": "freshness", "column": "x", "max_age_hours": 1}, specs[2]], "t", lambda n: None)
    assert [r.passed for r in empty] == [False, True, False, True]
    with pytest.raises(ValueError):
        quality.evaluate(df, [{"check": "nonsense"}], "t", lambda n: None)
    batches = []
    quality.publish([{"name": str(i)} for i in range(45)], batches.append)
    assert [len(b) for b in batches] == [20, 20, 5]


# ---------------------------------------------------------------- snapshots and state
def test_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t")
    assert table.read() is None
    assert table.publish(spark.range(5), "r1") == 5 and table.publish(spark.range(7), "r2", files_count=1) == 7
    first = [v for v in table.versions() if v != table.current()][0]
    assert table.read().count() == 7
    with pytest.raises(Exception):
        table.publish(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "r3")
    assert table.read().count() == 7
    table.rollback(first)
    assert table.read().count() == 5 and table.current() == first
    table.retain(1)
    assert table.versions() == [first] and table.read().count() == 5
    files.write_json(spark, f"{tmp_path}/s/x.json", {"a": 1})
    files.write_json(spark, f"{tmp_path}/s/x.json", {"a": 2})
    assert files.read_json(spark, f"{tmp_path}/s/x.json") == {"a": 2} and files.read_json(spark, f"{tmp_path}/none", 3) == 3


# ---------------------------------------------------------------- the REST source
class Service:
    """Issues of one repository, served by updated_at in pages."""

    def __init__(self, n, per_page=25, quota=10**9):
        self.items = [issue(1000 + i, updated_at=f"2025-02-{1 + i // 1440:02d}T{i // 60 % 24:02d}:{i % 60:02d}:00Z") for i in range(n)]
        self.quota, self.calls = quota, 0

    def __call__(self, url):
        from urllib.parse import parse_qs, urlparse

        if "comments" in url:
            said = {"id": 1, "issue_url": "http://x/issues/1000", "body": "b", "user": {"login": "z"}, "author_association": "OWNER"}
            return rest.Response(200, {}, json.dumps([said | {"created_at": TS.format(3), "updated_at": TS.format(3)}]))
        self.calls += 1
        if self.calls > self.quota:
            return rest.Response(403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "99"})
        q = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        found = sorted((x for x in self.items if x["updated_at"] >= q["since"]), key=lambda x: x["updated_at"])
        at, size = int(q.get("page", 0)) * int(q["per_page"]), int(q["per_page"])
        more = {"Link": f'<{url.split("&page=")[0]}&page={int(q.get("page", 0)) + 1}>; rel="next"'} if at + size < len(found) else {}
        return rest.Response(200, more, json.dumps(found[at : at + size]))


def read_all(service, since="2025-01-01T00:00:00Z", cursor=None, cap=100, per_page=25):
    extract = rest.Extract("o/a", "issues", since, cursor)
    return list(rest.pages(extract, service, "http://x", per_page, cap, sleep=lambda s: None)), extract


def test_pages_cap_rate_limit_and_retries():
    items, e = read_all(Service(60))
    assert (len(items), e.stopped, e.cursor, e.pages) == (60, "complete", "2025-02-01T00:59:00Z", 3)
    items, e = read_all(Service(100), cap=2)
    assert (len(items), e.stopped) == (50, "page_cap")
    items, e = read_all(Service(60, quota=1))
    assert (len(items), e.stopped) == (25, "rate_limited(reset=99)")
    # A lookback of more than the cap's pages must still get past itself.
    items, e = read_all(Service(100), "2025-02-01T00:00:00Z", "2025-02-01T01:00:00Z", cap=2)
    assert e.cursor > "2025-02-01T01:00:00Z"
    answers = iter([OSError(), rest.Response(500, {}), rest.Response(200, {}, '[{"id": 1}]')])

    def flaky(url):
        answer = next(answers)
        if isinstance(answer, OSError):
            raise answer
        return answer

    slept = []
    assert rest.fetch(flaky, "u", sleep=slept.append) == ([{"id": 1}], None) and slept == [1, 2]
    with pytest.raises(rest.HttpError):
        rest.fetch(lambda u: rest.Response(404, {}), "u")


def transport(url):
    return Service(70)(url)


def test_run_end_to_end(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_STORAGE_ROOT", str(tmp_path))
    monkeypatch.setenv("TIDEMARK_REPOS", "o/a,o/b")
    out = cli.main(["all", "--run-id", "r1", "--snapshot-at", "2025-03-01 00:00:00"], spark, transport)["stages"]
    assert Counter(x["records"] for x in out["ingest"]["result"]) == {70: 2, 1: 2}
    # Both repositories serve the same ids here, so silver keeps one of each.
    assert out["silver"]["result"]["tables"]["issues"]["silver_rows"] == 70
    assert out["gold"]["result"]["scd2"] == {"inserted_new": 70, "changed": 0, "late_ignored": 0}
    assert out["load"]["result"]["gold_fact_issue"] == 70 and out["load"]["result"]["mart_service_health_monthly"] == 1
    again = cli.main(["all", "--run-id", "r2", "--snapshot-at", "2025-03-01 00:00:00"], spark, transport)["stages"]
    assert all(x["records"] <= 61 for x in again["ingest"]["result"])
    assert again["gold"]["result"]["scd2"] == {"inserted_new": 0, "changed": 0, "late_ignored": 0}
    assert again["load"]["result"]["gold_fact_issue"] == 70
    assert spark.table("tidemark.gold_fact_issue").count() == 70
    assert sorted(map(str, spark.table("tidemark.mart_open_backlog_asof_weekly").collect())) == sorted(map(str, spark.table("mart_open_backlog_asof_weekly").collect()))
    settings = config.load()
    bad = stages.table(spark, settings, "silver.issues")
    bad.publish(bad.read().unionByName(bad.read()), "bad")
    with pytest.raises(quality.DataQualityError, match="unique:issue_id"):
        stages.check(spark, settings, "silver")
    assert any(not r["passed"] for r in files.read_json(spark, f"{settings['state_root']}/dq/silver.json"))


# ---------------------------------------------------------------- streams
def test_stream_merges_latest(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-02 00:00:00"), (2, "c", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k long, v string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    table = SnapshotTable(spark, f"{tmp_path}/t")
    streams.merge_into(source, table, "k", ["ts"], f"{tmp_path}/cp").awaitTermination(60)
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "b"), (2, "c")}
    query = streams.distinct_events(source, "k", "ts", "1 hour").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 2


def test_only_days_asked_for_are_opened(spark, sf_dir):
    from tidemark import queries

    plan = queries.QUERIES["partition_prune"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan and "1999-06-01" in plan


def many(url):
    """260 issues of both repositories: odd ones stay open, and the oldest of them for long."""
    service = Service(260)
    for i, x in enumerate(service.items):
        x |= {"title": f"{'timeout in upload' if i % 2 else 'question about docs'} number{i % 7}"}
        x |= {"state": "open" if i % 2 else "closed", "closed_at": None if i % 2 else TS.format(4)}
    return service(url)


def test_scores_of_a_run_that_has_published(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_STORAGE_ROOT", str(tmp_path))
    monkeypatch.setenv("TIDEMARK_REPOS", "o/a")
    monkeypatch.setenv("TIDEMARK_MAX_PAGES", "50")
    out = cli.main(["all", "--run-id", "r1", "--snapshot-at", "2025-03-01 00:00:00"], spark, many)["stages"]
    scored = out["ml"]["result"]
    assert (scored["topics"], scored["scored"]) == (260, 260) and scored["escalation"]["auc"] > 0.9
    risks = stages.table(spark, config.load(), "gold.escalation_scores").read()
    assert risks.where("escalation_risk BETWEEN 0 AND 1").count() == 260


def test_a_failed_load_moves_back(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_STORAGE_ROOT", str(tmp_path))
    settings = config.load() | {"warehouse": "tidemark_moved"}
    with pytest.raises(ValueError, match="dim_date"):
        stages.load(spark, settings)
    for run, n in (("a", 3), ("b", 5)):
        for name in marts.GOLD:
            stages.table(spark, settings, f"gold.{name}").publish(spark.range(n), run)
        with monkeypatch.context() as m:
            m.setattr(marts, "MARTS", {"x": "SELECT count(*) AS n FROM gold_fact_issue"} if run == "a" else {"x": "SELECT none FROM gold_fact_issue"})
            if run == "a":
                assert stages.load(spark, settings)["mart_x"] == 1
            else:
                with pytest.raises(Exception, match="none"):
                    stages.load(spark, settings)
    assert spark.table("tidemark_moved.gold_fact_issue").count() == 3 and spark.table("tidemark_moved.mart_x").first().n == 3


def test_retain_goes_by_time_not_by_name(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t")
    for run in ("z", "m", "a", "k"):
        table.publish(spark.range(1), run)
    order = {v[0]: v for v in table.versions()}
    table.rollback(order["m"])
    assert set(table.retain(3)) == {order["z"]} and table.current() == order["m"]
    assert set(table.retain(2)) == {order["a"]} and set(table.versions()) == {order["k"], order["m"]}


def test_link_header():
    header = '<http://x/a?b=1,2&c=;>; title="rel=next"; rel="prev first", <http://x/n>; rel=next'
    assert rest.link_of(header, "next") == "http://x/n" and rest.link_of(header, "first") == "http://x/a?b=1,2&c=;"
    assert rest.link_of(header, "last") is None and rest.link_of("", "next") is None


def test_first_response_exclusions(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    issues = spark.createDataFrame([("a", "u"), ("b", None)], "issue_key string, author_login string")
    comments = spark.createDataFrame(
        [
            ("a", "u", "User", "OWNER", day(1)),
            ("a", "x[bot]", "User", "OWNER", day(2)),
            ("a", "y", "Bot", "OWNER", day(3)),
            ("a", "z", None, "NONE", day(4)),
            ("a", "z", None, "MEMBER", day(6)),
            ("a", "w", "User", "OWNER", day(7)),
            ("b", "z", "User", "OWNER", day(1)),
        ],
        "issue_key string, author_login string, author_type string, author_association string, created_at timestamp",
    )
    got = star.first_response(issues, comments, ["OWNER", "MEMBER"]).collect()
    assert [(r.issue_key, r.first_response_at) for r in got] == [("a", day(6))]
