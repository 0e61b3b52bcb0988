import zlib

from tidemark.llm import sharding as s
from tidemark.llm.queries import op10_sharding

SCHEMA = "doc_id long, text string"


def brute(rows, shards):
    """Sizes along the order; each document goes where its middle byte falls."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sizes = [len((t or "").encode()) + 1 for _, t in order]
    whole, at, out, slots = sum(sizes), 0, [], [0] * shards
    for (d, _), n in zip(order, sizes, strict=True):
        k = min(shards - 1, (2 * at + n) * shards // (2 * whole))
        out.append((d, k, slots[k]))
        slots[k] += 1
        at += n
    return out


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = s.shard(docs).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted(brute(rows, 8))
    query = op10_sharding(spark, sf_dir).collect()
    text = dict(rows)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in query) == sorted(
        (d, len(text[d].encode()) + 1, zlib.crc32(text[d].encode()), "bytes", k, n, None) for d, k, n in brute(rows, 8)
    )
    total, most = sum(r.size for r in query), max(r.size for r in query)
    for k in range(8):
        assert abs(sum(r.size for r in query if r.shard == k) - total / 8) <= most


def test_edges(spark):
    rows = [(5, None), (None, "é"), (6, None), (3, "x" * 9000), (3, "x" * 9000), (2, "y"), (-4, ""), (9, "日本")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = s.shard(df, 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((k, n) for _, k, n in brute(rows, 3))
    assert s.shard(df.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "abc")] * 100, SCHEMA)
    got = sorted((r.shard, r.slot) for r in s.shard(same, 4).collect())
    assert got == [(k, n) for k in range(4) for n in range(25)]
    wide = spark.createDataFrame([(1, "a", 7, "q", 9)], "doc_id long, text string, row int, TEXT string, slot int")
    assert s.shard(wide).first().asDict() == {"doc_id": 1, "text": "a", "row": 7, "TEXT": "q", "shard": 4, "slot": 0}
