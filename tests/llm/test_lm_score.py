import math
import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import _common as c
from tidemark.llm import lm_score as m

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def brute(docs, target):
    """The two models over exact words; equal to ours as long as no two words share a slot."""
    uni, ctx, pair = ([Counter(), Counter()] for _ in range(3))
    for d, t in docs:
        for k in (0, 1) if d in target else (0,):
            w = ["<s>", *words(t)]
            uni[k].update(w[1:])
            ctx[k].update(w[:-1])
            pair[k].update(zip(w, w[1:], strict=False))
    n = [sum(u.values()) for u in uni]
    scale = [n[1] / n[0], 1.0]

    def loss(k, a, b):
        p = (uni[k][b] * scale[k] + m.UNIFORM / m.UNIGRAMS) / (n[k] * scale[k] + m.UNIFORM)
        return -math.log2((pair[k][a, b] * scale[k] + m.BACKOFF * p) / (ctx[k][a] * scale[k] + m.BACKOFF))

    out = {}
    for d, t in docs:
        w = ["<s>", *words(t)]
        out[d] = [sum(loss(k, a, b) for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1) for k in (1, 0)] if len(w) > 1 else [None, None]
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh" if i % 2 else "efghijkl") + "x" for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "ax " * 3000)]
    target = {i for i in range(0, 60, 2)}
    df = spark.createDataFrame(docs, SCHEMA)
    models = m.fit(df, spark.createDataFrame([(i,) for i in [*target, *target]], "doc_id long"))
    want = brute(docs, target)
    for r in m.score(df, models).collect():
        assert r.n_words == len(words(dict(docs)[r.doc_id]))
        if not r.n_words:
            assert r.target_loss is None and r.background_loss is None and r.difference is None
        else:
            assert np.allclose([r.target_loss, r.background_loss], want[r.doc_id], rtol=1e-4)
            assert math.isclose(r.difference, r.target_loss - r.background_loss)


def test_held_out_documents_of_the_target_score_lower(spark):
    rng = random.Random(3)
    one, two = [f"t{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(one if i % 4 == 0 or rng.random() < 0.4 else two) for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(docs, SCHEMA)
    models = m.fit(df, spark.createDataFrame([(i,) for i in range(0, 300, 4)], "doc_id long"))
    score = {r.doc_id: r.difference for r in m.score(df, models).collect()}
    held = [score[i] for i in range(300, 400, 4)]
    assert max(held) < min(score[i] for i in range(300, 400) if i % 4)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", 1), (None, "a b", 2), (1, "a b", 3)], "doc_id long, text string, target int")
    ids = spark.createDataFrame([(None,)], "doc_id long")
    got = m.score(df, m.fit(df, ids)).collect()
    assert len(got) == 3 and len({r.difference for r in got}) == 1
    empty = df.limit(0)
    assert m.score(empty, m.fit(empty, ids)).collect() == []


def test_slots_start_each_row():
    data, at = c.arrow_bytes(__import__("pyarrow").array([b"a b", b"", b"a"]))
    *_, w, first = c.hashed_words(data, at, c.BLANKS)
    word, before, pair = m.slots(w, first)
    assert word[0] == word[2] and before[0] == before[2] != before[1] and pair[0] == pair[2]


def test_more_words_than_the_least_vocabulary_stay_exact(spark, monkeypatch):
    docs = [(i, " ".join(f"w{i * 997 + j}" for j in range(1000))) for i in range(280)]
    target = set(range(0, 280, 3))
    df = spark.createDataFrame(docs, SCHEMA)
    got = m.score(df, m.fit(df, spark.createDataFrame([(i,) for i in target], "doc_id long"))).collect()
    n = len({w for _, t in docs for w in words(t)})
    assert n > m.UNIGRAMS
    # The uniform distribution is over the words there are.
    monkeypatch.setattr(m, "UNIFORM", m.UNIFORM / m.UNIGRAMS * n)
    monkeypatch.setattr(m, "UNIGRAMS", n)
    want = brute(docs, target)
    assert len(got) == 280
    for r in got:
        assert np.allclose([r.target_loss, r.background_loss], want[r.doc_id], rtol=1e-9)


def test_other_documents_than_the_models(spark):
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(20))) for i in range(40)]
    df, few = (spark.createDataFrame(x, SCHEMA) for x in (docs, docs[:5]))
    models = m.fit(df, spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long"))
    whole = {r.doc_id: r for r in m.score(df, models).collect()}
    assert sorted(m.score(few, models, block_bytes=200, bucket_keys=8).collect()) == sorted(whole[i] for i in range(5))
