import random
import re
from collections import Counter, defaultdict

from tidemark.llm import mixing as m

SCHEMA = "doc_id long, text string, source string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            break
        share = left / sum(weight[s] for s in rest)
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in rest}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            capped.add(s)
            left -= target[s]
    return target


def check(rows, got):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = brute_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        mean = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(mean + 1e-9), int(mean + 1e-9) + 1, int(mean)) and r.copies <= 3
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= most[s] / 2 + 1e-6


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = m.copies(docs).collect()
    check([tuple(r) for r in docs.collect()], got)
    assert sorted(m.copies(docs.repartition(3)).collect()) == sorted(got)
    mixed = Counter(r.doc_id for r in m.mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_hot_source_and_levels(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 40), "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    check(rows, m.copies(spark.createDataFrame(rows, SCHEMA)).collect())


def test_small_sources_are_folded_in_their_own_groups(spark, monkeypatch):
    """Beside a source of 4,000 each of 30 small ones is one row after the first level, and done."""
    rows = [(i, "w " * (1 + i % 9), "hot" if i < 4000 else f"s{i % 30}") for i in range(5200)]
    folded, cut = [], m.c.checkpointed

    def counted(df):
        df = cut(df)
        if "settled" in df.columns:
            folded.append(df.count())
        return df

    monkeypatch.setattr(m.c, "checkpointed", counted)
    check(rows, m.copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(folded) == 2 and folded[0] <= 63 + 30 and folded[1] == 1


def test_expectations_hold(spark):
    rows = [(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(4500)]
    got = m.copies(spark.createDataFrame(rows, SCHEMA)).collect()
    sums, times = Counter(), Counter()
    for r in got:
        sums[r.source, r.size] += r.copies - r.target / r.source_size
        times[r.source, r.size] += 1
    # 300 documents of each source and size: four standard errors of a fair draw.
    assert len(sums) == 15 and all(abs(sums[k] / times[k]) < 4 * 0.5 / times[k] ** 0.5 for k in sums)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y", None), (3, "x y z", "b"), (3, "x y z", "b"), (4, "q", "é"), (5, "k " * 9000, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    check(rows, m.copies(df).collect())
    assert all(r.asDict().keys() == {"doc_id", "text", "source"} for r in m.mix(df).collect())
    assert m.copies(df.limit(0)).collect() == [] and m.mix(df.limit(0)).collect() == []
    check(rows[:2], m.copies(spark.createDataFrame(rows[:2], SCHEMA)).collect())
    wide = spark.createDataFrame([(1, "a b", "s", 7, "q")], "doc_id long, text string, source string, copies int, TEXT string")
    assert m.mix(wide).first().asDict() == {"doc_id": 1, "text": "a b", "source": "s", "copies": 7, "TEXT": "q"}
