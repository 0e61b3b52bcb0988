import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm import fingerprints as f
from tidemark.llm.queries import op3_fingerprints

SCHEMA = "doc_id long, text string"


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, path, tolerance):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = op3_fingerprints(spark, str(path)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", texts[(i + 1) % len(texts)]
        if len(by_id[d]) > 1:
            continue  # rows of one id have no order that the contract knows
        (r,) = by_id[d]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(shingles(t), shingles(edited))) <= tolerance(shingles(t) | shingles(edited))
        assert abs(r.near_next - jaccard(shingles(t), shingles(nxt))) <= tolerance(shingles(t) | shingles(nxt))
        if len(shingles(t)) < f.K:
            assert r.n_shingles == len(shingles(t))
        else:
            assert abs(r.n_shingles / len(shingles(t)) - 1) < 0.4


def test_against_exact_sets(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, tmp_path, lambda s: 1e-9 if len(s) < f.K else 0.2)


def test_edges(spark, tmp_path):
    rows = [(9, None), (8, ""), (7, "a b"), (-3, "é ß 日本 c d e f g"), (None, "x y z x y z x y z"), (5, "w " * 5000), (2, "a b c d e f")]
    check(spark, rows, tmp_path / "a", lambda s: 0.2)
    check(spark, rows[:1], tmp_path / "b", lambda s: 0.2)
    check(spark, [], tmp_path / "c", lambda s: 0.2)
    repeated = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s"), (0, "t u v w x y z")]
    check(spark, repeated, tmp_path / "d", lambda s: 0.2)
    got = op3_fingerprints(spark, str(tmp_path / "d")).collect()
    assert len({r.fingerprint for r in got if r.n_chars == 11}) == 1
    assert sorted(r.next_id for r in got) == [0, 1, 1, 1]


def test_merge_and_estimates(spark):
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1000, 6000))
    parts = spark.createDataFrame([("k", a), ("k", b), ("k", None), (None, a), ("e", "")], "key string, text string")
    sketches = f.with_sketch(parts, "text", "sketch")
    merged = {r["key"]: r["sketch"] for r in f.merge(sketches, "key", "sketch").collect()}
    both = spark.createDataFrame([(a, b)], "a string, b string")
    both = f.with_sketch(f.with_sketch(both, "a", "x"), "b", "y")
    x, y = F.col("x"), F.col("y")
    row = both.select("x", f.union_of(x, y).alias("u"), f.resemblance(x, y).alias("r"), f.containment(x, y).alias("c"), f.distinct_shingles(y).alias("n")).first()
    assert merged == {"k": row.u, None: row.x, "e": []}
    assert abs(row.r - 1996 / 5996) < 0.15 and abs(row.c - 1996 / 2996) < 0.25 and abs(row.n / 4996 - 1) < 0.3


def test_sketches_hold_128_hashes(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(300))),)], "text string")
    assert len(f.with_sketch(df, "text", "sketch").first().sketch) == 128
