import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate as d

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def aligned(a, b):
    """Whether any alignment without gaps has a good region, by trying all regions of all alignments."""
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        eq = [a[i + shift] == b[i] for i in range(lo, hi)]
        best = max(((sum(1 if x else -2 for x in eq[i:j]), -i, j) for i in range(len(eq)) for j in range(i + 1, len(eq) + 1)), default=(0, 0, 0))
        part = eq[-best[1] : best[2]]
        if part and sum(part) >= min(d.MIN_WORDS, d.SHARE * len(b)) and sum(part) >= d.IDENTITY * len(part):
            return True
    return False


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, prose(rng.randrange(14, 40))) for i in range(12)]
    docs = []
    for k in range(60):
        body, at = prose(60), rng.randrange(60)
        if k % 2:
            part = list(items[k % 12][1])
            for j in range(5, len(part), 9):
                part[j] = "zz"
            body[at:at] = part
        docs.append((k, " ".join(body).replace(" w1", ", W1")))
    return docs, [(i, " ".join(t)) for i, t in items]


def test_against_all_alignments(spark, planted):
    docs, items = planted
    got = {(r.doc_id, r.item_id) for r in d.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(k, i) for k, t in docs for i, b in items if aligned(words(t), words(b))}
    assert got == want and len(want) >= 30
    clean = {r.doc_id for r in d.remove(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert clean == {k for k, _ in docs} - {k for k, _ in want}


def test_slices_change_nothing(spark, planted, monkeypatch):
    docs, items = (spark.createDataFrame(x, y) for x, y in zip(planted, (DOCS, ITEMS), strict=True))
    whole = sorted(d.overlaps(docs, items).collect())
    monkeypatch.setattr(d, "INDEX_BYTES", 20_000)
    assert len(list(d.slices(items))) > 2
    assert sorted(d.overlaps(docs, items).collect()) == whole
    assert d.remove(docs, items).count() == 60 - len({r.doc_id for r in whole})


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "just four words here"), (None, "Five words are enough évidence"), (1, item)], ITEMS)
    docs = spark.createDataFrame([(1, item.upper()), (2, None), (3, ""), (None, f"x, {item}! y"), (5, "so five words are enough évidence ok"), (6, "just four words here"), (7, "v " * 9000 + item), (1, item)], DOCS)
    got = [(r.doc_id, r.item_id, r.n_equal, r.doc_word) for r in d.overlaps(docs, items).collect()]
    want = [(1, 1, 13, 0)] * 4 + [(None, 1, 13, 1)] * 2 + [(5, None, 5, 1)] + [(7, 1, 13, 9000)] * 2
    assert sorted(got, key=str) == sorted(want, key=str)
    assert d.overlaps(docs.limit(0), items).collect() == [] and d.overlaps(docs, items.limit(0)).collect() == []
    assert d.remove(docs, items.limit(0)).count() == 8 and d.remove(docs.limit(0), items).count() == 0


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "q")], "doc_id long, text string, slice int, TEXT string")
    items = spark.createDataFrame([(1, "a b c d e", 5)], "item_id long, text string, slice int")
    assert d.remove(docs, items).first().asDict() == {"doc_id": 1, "text": "a b c", "slice": 5, "TEXT": "q"}


def test_region_is_the_largest_of_all_at_the_identity():
    rng = np.random.default_rng(4)
    for _ in range(400):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.7, 0.8, 0.9])
        regions = [(int(same[i:j].sum()), i - j, -i) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 5 * same[i:j].sum() >= 4 * (j - i)]
        equal, length, start = max(regions, default=(0, 0, 0))
        assert d.region(same) == (-start, -start - length)


def test_a_long_alignment_below_the_identity_keeps_its_good_region():
    item = [f"w{i}" for i in range(46)]
    text = [w if i % 17 < 12 else f"x{i}" for i, w in enumerate(item)]
    index = d.Index.of([1], [" ".join(item).encode()])
    data, at = d.c.arrow_bytes(d.pa.array([" ".join(text).encode()]))
    assert list(index.search(*d.c.hashed_words(data, at, d.c.ALNUM)[2:])) == [(0, 0, 24, 29, 0, 0)]


@pytest.mark.parametrize("n", range(5, 18))
def test_every_pattern_within_the_rule_is_found(n):
    item = [f"w{i}" for i in range(n)]
    index = d.Index.of([1], [" ".join(item).encode()])
    need = next(k for k in range(n + 1) if k >= min(d.MIN_WORDS, d.SHARE * n) and 5 * k >= 4 * min(n, 15))
    lost = range(1 + min(n, 15) - need)
    texts = [[f"x{i}" if i in p else w for i, w in enumerate(item)] for k in lost for p in combinations(range(min(n, 15)), k)]
    # The item's ends beyond the document's edges.
    texts += [item[i : n - k + i] for k in lost for i in range(k + 1)]
    data, at = d.c.arrow_bytes(d.pa.array([" ".join(t).encode() for t in texts]))
    assert {row for row, *_ in index.search(*d.c.hashed_words(data, at, d.c.ALNUM)[2:])} == set(range(len(texts)))


def brute_pairs(docs, items):
    """All pairs with a region that meets the rule, by trying every region of every alignment with enough equal words."""
    out = set()
    numbers = {}
    coded = [[(k, np.array([numbers.setdefault(w, len(numbers)) for w in words(t)])) for k, t in rows] for rows in (docs, items)]
    for i, b in coded[1]:
        need = min(d.MIN_WORDS, d.SHARE * len(b))
        for k, a in coded[0]:
            if len(b) < d.SHORTEST or not len(a):
                continue
            equal = a[:, None] == b[None, :]
            shift = np.arange(len(a))[:, None] - np.arange(len(b))[None, :] + len(b)
            counts = np.bincount(shift.ravel(), equal.ravel(), len(a) + len(b) + 1)
            for s in np.flatnonzero(counts >= need) - len(b):
                lo, hi = max(0, -s), min(len(b), len(a) - s)
                sums = np.concatenate([[0], np.cumsum(a[lo + s : hi + s] == b[lo:hi])])
                n, length = sums[None, :] - sums[:, None], np.arange(len(sums))[None, :] - np.arange(len(sums))[:, None]
                if ((length > 0) & (n >= need) & (n >= d.IDENTITY * length - 1e-9)).any():
                    out.add((k, i))
                    break
    return out


def test_query_equals_brute_force(spark, sf_dir):
    from tidemark.llm import queries

    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").select(k, "text").collect()] for n, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, sf_dir).collect()}
    assert got == brute_pairs(docs, items) and got


def hashed(*texts):
    from tidemark.llm import _common as c

    data, at = c.arrow_bytes(pa.array([t.encode() for t in texts], pa.binary()))
    return c.hashed_words(data, at, c.ALNUM)[2:]


def test_repetitive_texts_equal_all_alignments():
    rng = random.Random(8)
    for _ in range(150):
        few = "ab" if rng.random() < 0.5 else "abc"
        period = [rng.choice(few) for _ in range(rng.randrange(1, 4))]
        text = [rng.choice(few) if rng.random() < 0.15 else period[i % len(period)] for i in range(rng.randrange(8, 60))]
        item = [rng.choice(few) if rng.random() < 0.1 else period[i % len(period)] for i in range(rng.randrange(5, 30))]
        index = d.Index.of([0], [" ".join(item).encode()])
        found = list(index.search(*hashed(" ".join(text))))
        best = (0, 0)
        for shift in range(-len(item) + 1, len(text)):
            lo, hi = max(0, -shift), min(len(item), len(text) - shift)
            same = np.array([text[i + shift] == item[i] for i in range(lo, hi)])
            start, end = d.region(same)
            if end > start and same[start:end].sum() >= min(d.MIN_WORDS, d.SHARE * len(item)):
                best = max(best, (int(same[start:end].sum()), start - end))
        # Of alignments without a hit none can be the best: they have no run of equal words, and the best of these has.
        assert [(x[2], -x[3]) for x in found] == ([best] if best[0] else []), (text, item)


def test_equal_words_take_bounded_work():
    import time
    import tracemalloc

    index = d.Index.of([0], [b"la " * 800])
    words, first = hashed("la " * 8000)
    tracemalloc.start()
    began = time.perf_counter()
    assert list(index.search(words, first)) == [(0, 0, 800, 800, 0, 0)]
    seconds, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seconds < 1 and most < 200 << 20
