import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidemark.llm import queries, xxh64
from tidemark.llm import simhash_dedup as s
from tidemark.llm.components import label

SCHEMA = "doc_id long, text string"


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    near = {p: [q for q in prints if (p ^ q).bit_count() <= 2] for p in prints}
    root = {}
    for p in sorted(prints):
        if p not in root:
            todo = [p]
            while todo:
                q = todo.pop()
                if q not in root:
                    root[q] = p
                    todo += near[q]
    return root


def check(rows, got):
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(set(prints))
    least = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    want = sorted([(d, format(p, "016x"), least.get(root[p])) for (d, _), p in zip(rows, prints, strict=True)], key=str)
    assert sorted([(r.doc_id, format(r.fingerprint % (1 << 64), "016x"), r.component_id) for r in got], key=str) == want


@pytest.mark.parametrize("posting", [0, 32])
def test_against_brute_force(spark, sf_dir, posting):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], s.group(docs, posting=posting).collect())


def test_edges(spark):
    rows = [(3, None), (2, ""), (9, "a"), (8, "A b"), (7, "a B"), (None, "a b c d"), (None, "q"), (5, "a b c d"), (5, "a b c d"), (4, "é É ß " * 4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(rows, s.group(df).collect())
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in s.keep_one(df).collect())
    assert kept == [(False, 2), (False, 4), (False, 5), (False, 7), (False, 9), (True, 0)]
    assert s.group(df.limit(0)).collect() == [] and s.keep_one(df.limit(0)).collect() == []


@pytest.mark.parametrize("posting", [0, 3, 1000])
def test_links_keep_components(spark, posting):
    rng = random.Random(posting)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:15]:
        for _ in range(12):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = label(s.links(spark.createDataFrame([(v,) for v in signed], "f long"), posting)).collect()
    groups, want = {}, {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node % (1 << 64))
    for v, r in brute_components(values).items():
        want.setdefault(r, set()).add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


@pytest.mark.parametrize("order", ["rising", "shuffled"])
def test_components_of_a_long_chain(spark, order):
    n, rounds = 1000, []
    chain = list(range(n))
    if order == "shuffled":
        random.Random(5).shuffle(chain)
    df = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)) + [(7, 7)], "a long, b long")
    assert {r.root for r in label(df, rounds).collect()} == {0}
    # Nodes halve every two rounds, paths with every jump.
    assert len(rounds) <= 2 * 10 and sum(rounds) <= (12 if order == "rising" else 40)


def test_components_of_hubs(spark):
    """Stars whose hub is the largest, hubs in a row: each hub's leaves meet in the second round."""
    links, rounds = [], []
    for h in range(20):
        links += [(10_000 + h, 100 * h + leaf) for leaf in range(30)] + [(10_000 + h, 100 * (h + 1))] * (h < 19)
    assert {r.root for r in label(spark.createDataFrame(links, "a long, b long"), rounds).collect()} == {0}
    assert sum(rounds) <= 12


def test_hashes_equal_the_library():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    starts = rng.integers(0, 2500, 4000)
    ends = starts + rng.integers(0, 300, 4000)
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]
    assert xxh64.hashes(data, starts, ends, 42).tolist() == want
    assert xxh64.hashes(data[:0], starts[:0], ends[:0], 42).tolist() == []


def test_a_list_tells_which_positions_are_shared():
    for n in range(9):
        for shared in map(set, combinations(range(8), n)):
            told = set().union(*[x for x in s.LISTS if set(x) <= shared])
            assert (len(told) >= 6) == (n >= 6) and (n < 6 or told == shared)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = {d: brute_print(text) for d, text in rows}
    root = brute_components(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(least.get(root[p], d), d)
    got = queries.op7_simhash_dedup(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, format(p, "016x"), least[root[p]]) for d, p in prints.items())


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, "x"), (2, "a b c d", 2, "y")], "doc_id long, text string, fingerprint int, TEXT string")
    (row,) = s.keep_one(df).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a b c d", "fingerprint": 1, "TEXT": "x"}
