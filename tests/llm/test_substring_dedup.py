import hashlib
import re
from collections import Counter

import pytest

from tidemark.llm import _common as c
from tidemark.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df, window):
    return sorted(
        ((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in remove_repeats(df, window, 1 << 14).collect()),
        key=str,
    )


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert ours(docs, 35) == brute([tuple(r) for r in docs.collect()], 35)


@pytest.mark.parametrize("window", [1, 2, 3])
def test_edges(spark, window):
    rows = [
        (1, "a b c d e"),
        (2, None),
        (3, ""),
        (None, "a b c"),
        (4, "x y z\x0bq  r\x1fs"),
        (5, "a b c d e"),
        (5, "a b c d e"),
        (6, "l l l l l l"),
        (7, "éa ß日本 c d"),
        (8, "w " * 5000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ours(df, window) == brute(rows, window)


def test_intervals_are_maximal(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "z a b c d y e f")], SCHEMA)
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in remove_repeats(df, 2).collect()}
    assert got == {1: [(0, 6)], 2: [(1, 5), (6, 8)]}


def test_empty_and_other_columns(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b", 3, "q")], "doc_id long, text string, block int, TEXT string")
    assert remove_repeats(df, 2).first().kept_text == "a b"


def test_windows_that_share_a_hash_are_told_apart(spark, sf_dir):
    """First hashes of six bits: nearly all windows share one with others, and only the second hash tells."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in remove_repeats(docs, 35, 1 << 16, first_bits=6).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], 35)


def test_very_many_equal_rows_are_one_row_of_a_block(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(300))
    hot = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.lit(7).cast("long")).alias("doc_id"), F.lit(text).alias("text"))
    few = spark.createDataFrame([(i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(20)] + [(7, "w1 w2"), (30, None)], SCHEMA)
    largest = c.collapsed(hot.union(few), "doc_id", "text")
    assert largest.count() == 2 + 22 and largest.agg(F.sum("times")).first()[0] == 100_022
    got = remove_repeats(hot.union(few)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    want = {(None, 300, 300): 50_000, (7, 300, 300): 50_000, (7, 2, 0): 1, (30, 0, 0): 1} | {(i, 50, 0): 1 for i in range(20)}
    assert {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in got} == want
