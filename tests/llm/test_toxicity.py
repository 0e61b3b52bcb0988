import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import _common as c
from tidemark.llm import toxicity as t

SCHEMA = "doc_id long, text string"


def planted(n=700, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    bad = ["vile", "scummy", "rotten"]
    docs, labels = [], []
    for i in range(n):
        sentences = [[rng.choice(words) for _ in range(rng.randrange(3, 12))] for _ in range(rng.randrange(1, 12))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            rng.choice(sentences).insert(1, rng.choice(bad))
        docs.append((i, ". ".join(" ".join(s).capitalize() for s in sentences) + "."))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_documents_are_told_apart_and_sentences_found(spark):
    docs, labels = planted()
    df = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.fit(df, known.where(~t.held_out(F.col("doc_id"))))
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r.doc_id: r for r in t.score(df, model).collect()}
    wrong = [i for i, y in labels if i in held and (got[i].score >= 0.3) != bool(y)]
    assert len(held) > 100 and len(wrong) <= 0.05 * len(held)
    for i, y in labels:
        if y and got[i].offending:
            text = docs[i][1]
            assert any(w in text[s.start : s.end] for s in got[i].offending for w in ("vile", "Vile", "scummy", "rotten"))
    assert {r.doc_id for r in t.remove(df, model).collect()} == {i for i in got if got[i].score < 0.3}


def test_score_is_a_leaky_noisy_or():
    texts = ["Bad one. Good two! bad bad", "", None, "... !", "é bad\nok"]
    data, at = c.arrow_bytes(pa.array([x and x.encode() for x in texts], pa.binary()))
    words, *_ = t.sentences(*c.arrow_bytes(pa.array([b"bad"])))
    model = t.Model(words, np.array([3.0]), -2.0, 0.1)
    total, p, (row, *_rest) = model.score(data, at)
    high, low = 1 / (1 + np.exp(-1.0)), 1 / (1 + np.exp(2.0))
    assert np.allclose(p, [high, low, high, high, low]) and row.tolist() == [0, 0, 0, 4, 4]
    clean = 0.9 * np.array([(1 - high) ** 2 * (1 - low), 1, 1, 1, (1 - high) * (1 - low)])
    assert np.allclose(total, 1 - clean)


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (1, None), (3, "w " * 20000)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.fit(df, none)
    assert model.leak == 0 and [r.score for r in t.score(df, model).collect()] == [0.0] * 5
    one = t.fit(df, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int"))
    assert one.leak == 1.0
    assert t.score(df.limit(0), model).collect() == [] and t.remove(df.limit(0), model).count() == 0
    wide = spark.createDataFrame([(1, "a", 5.0, "q")], "doc_id long, text string, score double, TEXT string")
    assert t.remove(wide, model).first().asDict() == {"doc_id": 1, "text": "a", "score": 5.0, "TEXT": "q"}
    known = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in t.score(df, t.fit(df, known)).collect())


def test_a_text_too_long_for_the_sample_is_passed_over(spark):
    docs, labels = planted()
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = t.fit(spark.createDataFrame(docs, SCHEMA), known)
    # Of all ids tried, one that the sample's order puts first.
    ids = spark.createDataFrame([(i,) for i in range(1000, 5000)], "doc_id long").orderBy(F.xxhash64("doc_id")).first()[0]
    held = spark.createDataFrame(labels + [(ids, 0)], "doc_id long, toxic int")
    long = spark.createDataFrame([*docs, (ids, "long text. " * 30_000)], SCHEMA)
    model = t.fit(long, held, most_bytes=sum(len(x) for _, x in docs) + 100)
    assert model.hashes.tolist() == plain.hashes.tolist() and np.allclose(model.weights, plain.weights, atol=0.05)
    assert t._fitting([5, 100, 3, 2, 1], 9) == [True, False, True, False, True]


def test_a_model_without_words_removes_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], SCHEMA)
    model = t.fit(df, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert model.leak == 1.0 and t.remove(df, model).count() == 3


def brute_score(model):
    """A text's score from the fitted weights, by a plain noisy-or over sentences."""
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = {}

    def hash_of(word):
        return int(c.hashed_words(*c.arrow_bytes(pa.array([word.encode()])), c.ALNUM, lower=True)[2][0])

    def brute(text):
        clean = 1 - model.leak
        for sentence in re.split(r"[.!?\n]", (text or "").translate(lower)):
            words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence))
            if words:
                for w in words - known.keys():
                    known[w] = weight.get(hash_of(w), 0.0)
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(known[w] for w in words))))
        return 1 - clean

    return brute


def test_query_equals_brute_force(spark, sf_dir):
    from tidemark.llm import queries

    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    brute = brute_score(t.fit(docs, labels.where(~t.held_out(F.col("doc_id")))))
    got = queries.op2_toxicity(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - brute(texts[r.doc_id])) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
