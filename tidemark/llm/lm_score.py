"""LM scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background, share one vocabulary, one smoothing
and one mass: pairs back off to words and words to the uniform distribution over all distinct words
(UNIGRAMS at least), and the background's counts are scaled to the target's number of words, so that
both are smoothed alike. A document's score is the mean over its words of
-log target(word) + log background(word): the lower, the more it reads like the target.

Counts are kept for every distinct word, context and pair, by a hash of 63 bits, and never meet in
one place:

1. Documents are dealt into blocks of some megabytes by a hash of id and text.
2. Each block adds up its equal keys and sends each once, with both models' counts, to the hash
   range ("bucket") it belongs to. However often a pair occurs in a block, it is no hot key.
3. A bucket sums the counts and answers each block for the keys it sent, in their order.
4. A block finds its keys again and scores its documents.

Shuffled are the texts (once), 8 bytes and two counts a distinct key of a block, and the answers.
Memory of a task: one block, or one bucket of about 2 ** 20 keys. Nothing is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

UNIGRAMS = 1 << 18
#: Pseudo-counts of the distribution backed off to: words to uniform, pairs to words.
UNIFORM = 0.5 * UNIGRAMS
BACKOFF = 4.0
BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20

_LEFT = np.uint64(0xA24BAED4963EE407)
_START = np.uint64(0x9FB21C651E98DF25)
_CONTEXT = np.uint64(0xD6E8FEB86659FD93)
_ONE = np.uint64(1)


def slots(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each word (odd), of the word before it (or the start) as a context, and of the pair (both even)."""
    before = np.empty_like(words)
    if len(words):
        before[1:], before[0] = words[:-1], _START
        before[first[:-1][np.diff(first) > 0]] = _START
    with np.errstate(over="ignore"):
        pair = c.mix(words + before * _LEFT)
        before = c.mix(before ^ _CONTEXT)
    return words | _ONE, before & ~_ONE, pair & ~_ONE


def _keys(docs: pa.Table) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    data, at = c.arrow_bytes(docs["text"])
    *_, words, first = c.hashed_words(data, at, c.BLANKS, lower=True)
    return slots(words, first), first


def _placed(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them, from one sort."""
    order = np.argsort(every)
    found = every[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    own = np.empty(len(found), np.int64)
    own[order] = np.cumsum(new) - 1
    return found[new], own


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted ones, and the end."""
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]])


def _pack(counts: np.ndarray) -> bytes:
    """By byte planes, as many as the largest count needs."""
    width = (int(counts.max(initial=0)).bit_length() + 7) // 8
    return counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if data:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def _requests(docs: pa.Table, marked: pa.Table, bits: int) -> pa.Table:
    kinds, first = _keys(docs)
    n = np.diff(first)
    keys, own_place = _placed(np.concatenate(kinds))
    places, at = np.split(own_place, 3), []
    counted = docs["counted"].to_numpy().astype(bool)
    chosen = counted & pc.is_in(docs["doc_id"], value_set=marked["_doc"].combine_chunks()).to_numpy().astype(bool)
    for rows in (counted, chosen):
        own = np.repeat(rows, n)
        at.append(sum(np.bincount(x[own], minlength=len(keys)) for x in places))
    edges = _edges(keys, bits)
    spans = [slice(i, j) for i, j in zip(edges[:-1], edges[1:], strict=True)] if len(keys) else []
    block = docs["block"][0].as_py() if len(docs) else 0
    return pa.table(
        {
            "bucket": pa.array(range(len(spans)), pa.int64()),
            "block": pa.array([block] * len(spans), pa.int64()),
            "hashes": pa.array([c.pack(keys[x]) for x in spans], pa.binary()),
            "total": pa.array([_pack(at[0][x]) for x in spans], pa.binary()),
            "target": pa.array([_pack(at[1][x]) for x in spans], pa.binary()),
        }
    )


def _answers(table: pa.Table) -> pa.Table:
    sent = [c.unpack(x) for x in table["hashes"].to_pylist()]
    edges = np.cumsum([0, *map(len, sent)])
    keys, own = np.unique(np.concatenate(sent), return_inverse=True)
    word = (keys & _ONE).astype(bool)
    out, sums = {}, {}
    for name in ("total", "target"):
        counts = np.concatenate([_unpack(x, len(h)) for x, h in zip(table[name].to_pylist(), sent, strict=True)])
        # Sums of whole numbers are exact in doubles up to 2 ** 53.
        summed = np.bincount(own, counts, len(keys)).astype(np.int64)
        out[name] = pa.array([_pack(summed[own[i:j]]) for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        sums[name] = int(summed[word].sum())
        if name == "total":
            sums["distinct"] = int(np.count_nonzero(summed[word]))
    return pa.table(
        {"block": table["block"], "bucket": table["bucket"], **out}
        | {f"n_{k}": pa.array([sums[k]] * len(sent), pa.int64()) for k in ("total", "target", "distinct")}
    )


def _losses(docs: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    kinds, first = _keys(docs)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    keys, own = _placed(np.concatenate(kinds))
    word, before, pair = np.split(own, 3)
    sizes = np.diff(_edges(keys, bits))
    order = np.argsort(answers["bucket"].to_numpy())
    sums = {k: int(answers[f"n_{k}"].to_numpy().sum()) for k in ("total", "target", "distinct")}
    uniform = UNIFORM / UNIGRAMS * max(UNIGRAMS, sums["distinct"])
    means = []
    for name in ("total", "target"):
        mass = 1.0 if name == "target" or not sums["target"] else sums["target"] / sums["total"]
        packed = answers[name].to_pylist()
        counts = np.concatenate([np.empty(0), *[_unpack(packed[i], sizes[k]) for k, i in enumerate(order)]]) * mass
        p = (counts[word] + UNIFORM / UNIGRAMS) / (sums[name] * mass + uniform)
        p = (counts[pair] + BACKOFF * p) / (counts[before] + BACKOFF)
        means.append(np.bincount(owner, -np.log2(np.minimum(p, 1.0)), len(n)) / np.maximum(n, 1))
    background, target = means
    none = n == 0
    out = pa.table([docs["doc_id"], pa.array(n, pa.int64()), *(pa.array(x, mask=none) for x in (target, background, target - background))], _NAMES)
    return out.filter(docs["scored"])


_NAMES = ["doc_id", "n_words", "target_loss", "background_loss", "difference"]


@dataclass
class Models:
    """What the models are of. Their counts grow with the corpus and are summed where documents are scored."""

    docs: DataFrame
    target_ids: DataFrame


def fit(docs: DataFrame, target_ids: DataFrame) -> Models:
    """Background: all docs(doc_id, text). Target: those with an id in target_ids(doc_id)."""
    return Models(docs, target_ids)


def score(docs: DataFrame, models: Models, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (bits a word), difference of every row.

    Words are runs of anything but ASCII blanks, A-Z in lower case. Null, empty and blank texts
    have no word, losses null and difference null. Without any target document the target model is
    uniform. Rows that repeat score alike; an empty table gives an empty result; texts are taken
    whole, and other columns are ignored.
    """
    spark = docs.sparkSession
    c.short_batches(spark)
    both = docs is models.docs
    rows = c.pick(docs, "doc_id", "text").select("doc_id", "text", F.lit(both).alias("counted"), F.lit(True).alias("scored"))
    if not both:
        rows = rows.union(c.pick(models.docs, "doc_id", "text").select("doc_id", "text", F.lit(True), F.lit(False)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(c.partitions(spark), total // block_bytes + 1)
    bits = max(1, int(max(c.partitions(spark), total // 6 // bucket_keys + 1) - 1).bit_length())
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    dealt = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "counted", "scored", block)
    ids = c.pick(models.target_ids, "doc_id").where("doc_id is not null").distinct().select(F.col("doc_id").alias("_id"))
    # The ids grow with the corpus and are never broadcast, however few they are today.
    marked = rows.where("counted").select("doc_id", block).join(ids.hint("shuffle_merge"), F.col("doc_id") == F.col("_id"))
    marked = marked.select(F.col("block").alias("_block"), F.col("doc_id").alias("_doc"))
    requests = dealt.groupBy("block").cogroup(marked.groupBy("_block")).applyInArrow(
        lambda d, m: _requests(d, m, bits), "bucket long, block long, hashes binary, total binary, target binary"
    )
    answers = requests.groupBy("bucket").applyInArrow(
        _answers, "block long, bucket long, total binary, target binary, n_total long, n_target long, n_distinct long"
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            lambda d, a: _losses(d, a, bits),
            f"doc_id {kind}, n_words long, target_loss double, background_loss double, difference double",
        )
    )
