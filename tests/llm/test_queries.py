import zlib

import duckdb
import pytest

from tidemark.llm import queries


def test_substring_dedup_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.OP5_SQL)
    names = [x[0] for x in want.description]
    got = queries.op5_substring_dedup(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_topics_read_whole_texts(spark, tmp_path):
    from tidemark import queries as engine

    docs = [(i, "Same start here. " + ("alpha beta gamma " if i % 2 else "delta epsilon zeta ") * 5) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    topics = {r.issue_id % 2: r.topic_terms for r in engine.ml_topics(spark, str(tmp_path)).collect()}
    assert "alpha" in topics[1] and "delta" in topics[0]


#: What SQL can say of the queries whose other columns hash or draw.
IN_SQL = {
    "op3_fingerprints": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), (SELECT coalesce(text, '') FROM documents ORDER BY doc_id DESC LIMIT 1)) AS following FROM documents)
      SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 3) || substring(following, 1, length(t) // 3)) AS edited_sha256 FROM d""",
    "op4_license_scan": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS l FROM documents),
      p AS (SELECT *, ' ' || array_to_string(l, ' ') || ' ' AS s FROM w),
      places AS (SELECT doc_id, unnest(list_filter(generate_series(1, len(l)), lambda i: array_to_string(l[i:i + 1], ' ') IN ('mit license', 'apache license') OR array_to_string(l[i:i + 2], ' ') = 'general public license')) - 1 AS place FROM w),
      found AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi FROM places GROUP BY 1)
      SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word FROM w LEFT JOIN found f ON f.doc_id = w.doc_id""",
    "op8_mixing": r"""WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents)
      SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d""",
    "op10_sharding": """WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents),
      r AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS whole FROM d),
      s AS (SELECT doc_id, size, CAST(least(7, ((2 * before + size) * 8) // (2 * whole)) AS INTEGER) AS shard FROM r)
      SELECT doc_id, size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
}


@pytest.mark.parametrize("name", sorted(IN_SQL))
def test_columns_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(IN_SQL[name])
    names = [x[0] for x in want.description]
    got = queries.queries()[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


def test_sharding_checksums(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.text_crc32 for r in queries.op10_sharding(spark, sf_dir).collect()} == {i: zlib.crc32((t or "").encode()) for i, t in texts.items()}
