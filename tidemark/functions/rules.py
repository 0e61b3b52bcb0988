"""Rules from configuration, compiled to native expressions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_capture(labels: Column | str, pattern: str) -> Column:
    """Group 1 of the first label that the pattern captures something of; null if none."""
    captured = F.transform(labels, lambda label: F.regexp_extract(label, pattern, 1))
    return F.get(F.filter(captured, lambda x: x != ""), F.lit(0))


def first_keyword(text: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern found in the text; null if none."""
    hits = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in patterns.items()]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def classify(rules: dict[str, Any], labels: str = "labels", title: str = "title", unknown: str = "unknown") -> Column:
    """By label patterns in order, then by keywords of the lower-cased title in order, else unknown."""
    by_label = [first_capture(labels, p) for p in rules.get("label_patterns", [])]
    by_title = first_keyword(F.lower(F.coalesce(title, F.lit(""))), rules.get("keyword_patterns", {}))
    return F.coalesce(*by_label, by_title, F.lit(unknown))


def normalize_slug(slug: Column, rules: dict[str, Any] | None = None) -> Column:
    """Lower case, other characters to single dashes, none at the ends; two suffixes off; aliases."""
    rules = rules or {}
    dashed = F.regexp_replace(F.lower(slug), "[^a-z0-9]+", "-")
    suffix = rules.get("strip_suffix_pattern")
    steps = ["^-+|-+$"] + ([suffix, suffix] if suffix else [])
    plain = reduce(lambda column, pattern: F.regexp_replace(column, pattern, ""), steps, dashed)
    aliases = rules.get("aliases") or {}
    if not aliases:
        return plain
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(names, plain), plain)
