from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute_pairs
from tests.llm.test_mixing import brute_targets, size
from tests.llm.test_simhash_dedup import brute_components, brute_print
from tests.llm.test_toxicity import brute_score
from tidemark.llm import queries, toxicity


def test_stages_chain(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(before)] == before and (k == 4 or out.columns == before)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        found = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert found.keys() <= ids and (k >= 3 or max(found.values()) == 1)
        ids = found.keys()
        counts.append(sum(found.values()))
    assert 200 > counts[0] > counts[1] > counts[2] > 100 and counts[3] == counts[4]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())


def brute_shards(sizes, shards=8):
    """By id, each where its middle byte falls; slots in that order."""
    whole, before, slots, out = sum(n for _, n in sizes), 0, Counter(), []
    for i, n in sorted(sizes):
        place = min(shards - 1, (2 * before + n) * shards // (2 * whole))
        out.append((i, place, slots[place]))
        slots[place] += 1
        before += n
    return sorted(out)


def test_each_stage_equals_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    score = brute_score(toxicity.fit(docs, labels))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        if name == "toxicity":
            rows = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
        elif name == "simhash_dedup":
            prints = {i: brute_print(text) for i, text, _ in rows}
            root, first = brute_components(set(prints.values())), {}
            for i, p in prints.items():
                first[root[p]] = min(first.get(root[p], i), i)
            rows = [r for r in rows if first[root[prints[r[0]]]] == r[0]]
        elif name == "decontamination":
            bad = {i for i, _ in brute_pairs([r[:2] for r in rows], items)}
            rows = [r for r in rows if r[0] not in bad]
        elif name == "mixing":
            sizes, copies = Counter(), Counter(r.doc_id for r in got)
            for _, text, source in rows:
                sizes[source] += size(text)
            target = brute_targets(sizes)
            for source, n in sizes.items():
                own = [(copies[i], size(text)) for i, text, s in rows if s == source]
                mean = target[source] / n
                assert all(x in (int(mean), int(mean + 1e-9), int(mean + 1e-9) + 1) for x, _ in own)
                assert abs(sum(x * m for x, m in own) - target[source]) <= max(m for _, m in own)
            text = {i: (t, s) for i, t, s in rows}
            rows = [(i, *text[i]) for i in copies.elements()]
        else:
            assert sorted((r.doc_id, r.shard, r.slot) for r in got) == brute_shards([(i, len((t or "").encode()) + 1) for i, t, _ in rows])
        assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted(rows), name


def test_stages_take_nulls_and_nothing(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, SCORE int"
    rows = [(1, None, None, None, None, 1), (None, "a b c", "en", "s", 5, None), (2, "", "en", None, 0, 2)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0, name
        out = stage(spark, spark.createDataFrame(rows, schema), sf_dir)
        assert out.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "SCORE"] and out.count() > 0, name


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_toxicity", "op6_lm_score"])
def test_queries_run(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0
