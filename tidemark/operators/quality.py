"""Declarative data-quality checks, fused: as few passes as the checks' shapes allow.

All checks that look at one row at a time (row_count_min, not_null, accepted_values, expression,
freshness, max_null_fraction, max_fraction_equal) on a table are one aggregate. Those that group by
the same key share that grouping. Foreign keys and version overlaps have a pass each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Spec = dict[str, Any]
Resolve = Callable[[str], DataFrame]


class DataQualityError(Exception):
    """A run was stopped by failed checks."""


@dataclass(frozen=True)
class CheckResult:
    table: str
    check: str
    severity: str
    passed: bool
    value: float | None
    detail: str


def name_of(spec: Spec) -> str:
    if "name" in spec:
        return spec["name"]
    columns = spec.get("columns") or [x for x in (spec.get("column"), spec.get("key")) if x]
    return f"{spec['check']}:{','.join(columns)}" if columns else spec["check"]


def _bad_rows(condition: Column) -> Column:
    return F.count_if(condition)


def _row_level(spec: Spec, now: Column) -> Column | None:
    """The one number of a check that sees a row at a time; None for other checks."""
    kind, column = spec["check"], F.col(spec["column"]) if "column" in spec else None
    if kind == "row_count_min":
        return F.count(F.lit(1))
    if kind == "not_null":
        missing = F.lit(False)
        for name in spec["columns"]:
            missing = missing | F.col(name).isNull()
        return _bad_rows(missing)
    if kind == "accepted_values":
        return _bad_rows(column.isNull() | ~column.isin(*spec["values"]))
    if kind == "expression":
        # NOT of null is null: what can't be decided passes, as with a CHECK constraint.
        return _bad_rows(~F.expr(spec["expr"]))
    if kind == "freshness":
        age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(column).cast("timestamp"))
        return age / F.lit(3.6e9)
    if kind == "max_null_fraction":
        return F.avg(column.isNull().cast("double"))
    if kind == "max_fraction_equal":
        return F.avg(F.coalesce(column == F.lit(spec["value"]), F.lit(False)).cast("double"))
    return None


def _grouped(spec: Spec) -> tuple[tuple[str, ...], Column] | None:
    """Key of a check that groups, and whether a group is at fault."""
    if spec["check"] == "unique":
        return tuple(spec["columns"]), F.count(F.lit(1)) > 1
    if spec["check"] == "scd2_one_current":
        return (spec["key"],), F.coalesce(F.sum(F.col("is_current").cast("int")), F.lit(0)) != 1
    return None


def _alone(df: DataFrame, spec: Spec, resolve: Resolve) -> DataFrame:
    """The offending rows of a check that needs a pass of its own."""
    if spec["check"] == "foreign_key":
        keys = resolve(spec["ref_table"]).select(F.col(spec["ref_column"]).alias("_ref")).distinct()
        return df.join(keys, F.col(spec["column"]) == F.col("_ref"), "left_anti")
    if spec["check"] in ("scd2_no_overlap", "scd2_no_gap"):
        following = F.lead("valid_from").over(Window.partitionBy(spec["key"]).orderBy("valid_from", "valid_to"))
        wrong = F.col("valid_to") > F.col("_next") if spec["check"] == "scd2_no_overlap" else F.col("valid_to") < F.col("_next")
        return df.withColumn("_next", following).where(wrong)
    raise ValueError(f"unknown check: {spec['check']}")


def _verdict(spec: Spec, value: float | None) -> tuple[bool, str]:
    kind = spec["check"]
    if kind == "row_count_min":
        return value >= spec["min"], f"{value} rows, at least {spec['min']}"
    if kind == "freshness":
        return value is not None and value <= spec["max_age_hours"], f"age {value} h, at most {spec['max_age_hours']}"
    if kind in ("max_null_fraction", "max_fraction_equal"):
        return (value or 0.0) <= spec["max_fraction"], f"fraction {value or 0.0}, at most {spec['max_fraction']}"
    return value == 0, f"{value} {'keys' if _grouped(spec) else 'rows'} at fault"


def measure(df: DataFrame, specs: list[Spec], resolve: Resolve, now: Column) -> list[float | None]:
    """The number of each check, in the order of specs."""
    values: list[float | None] = [None] * len(specs)
    rows, groups, alone = {}, defaultdict(dict), []
    for i, spec in enumerate(specs):
        if (number := _row_level(spec, now)) is not None:
            rows[i] = number
        elif (grouped := _grouped(spec)) is not None:
            groups[grouped[0]][i] = grouped[1]
        else:
            alone.append((i, _alone(df, spec, resolve)))
    if rows:
        found = df.agg(*[x.alias(f"v{i}") for i, x in rows.items()]).first()
        for i in rows:
            values[i] = found[f"v{i}"]
    for key, faults in groups.items():
        per_key = df.groupBy(*key).agg(*[x.alias(f"v{i}") for i, x in faults.items()])
        found = per_key.agg(*[F.count_if(F.col(f"v{i}")).alias(f"v{i}") for i in faults]).first()
        for i in faults:
            values[i] = found[f"v{i}"]
    for i, offending in alone:
        values[i] = offending.count()
    return values


def evaluate(df: DataFrame, specs: list[Spec], table: str, resolve: Resolve, now: Column | None = None) -> list[CheckResult]:
    specs = [dict(s) for s in specs]
    values = measure(df, specs, resolve, F.current_timestamp() if now is None else now)
    out = []
    for spec, value in zip(specs, values, strict=True):
        if spec["check"] in ("max_null_fraction", "max_fraction_equal"):
            value = value or 0.0
        passed, detail = _verdict(spec, value)
        out.append(CheckResult(table, name_of(spec), spec.get("severity", "error"), bool(passed), value if value is None else float(value), detail))
    return out


def run(checks: dict[str, list[Spec]], resolve: Resolve, prefix: str = "", now: Column | None = None) -> list[CheckResult]:
    """All checks of the tables whose names start with the prefix; each table is read by one call of resolve."""
    known: dict[str, DataFrame] = {}

    def once(name: str) -> DataFrame:
        if name not in known:
            known[name] = resolve(name)
        return known[name]

    return [r for table, specs in checks.items() if table.startswith(prefix) for r in evaluate(once(table), specs, table, once, now)]


def gate(results: list[CheckResult], fail_on: str = "error") -> None:
    """Raise if a check failed that should stop the run: fail_on error, warn (any) or never."""
    stopping = {"error": ("error",), "warn": ("error", "warn"), "never": ()}[fail_on]
    failed = [f"{r.table} {r.check} ({r.detail})" for r in results if not r.passed and r.severity in stopping]
    if failed:
        raise DataQualityError("failed checks: " + "; ".join(failed))


def metrics(results: list[CheckResult]) -> list[dict[str, Any]]:
    """Data points to publish: for each check whether it failed and its value, and how many errors there are."""
    points = []
    for r in results:
        where = {"table": r.table, "check": r.check}
        points.append({"name": "CheckFailed", "value": float(not r.passed), **where})
        if r.value is not None:
            points.append({"name": "CheckValue", "value": r.value, **where})
    points.append({"name": "ErrorChecksFailed", "value": float(sum(not r.passed and r.severity == "error" for r in results))})
    return points


def publish(points: list[dict[str, Any]], put: Callable[[list[dict[str, Any]]], None], batch: int = 20) -> None:
    """Hand the points to a sink, `batch` at a time."""
    for i in range(0, len(points), batch):
        put(points[i : i + batch])
