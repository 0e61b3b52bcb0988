"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

1. Documents are dealt into blocks of some megabytes by a hash of id and text. Rows that are equal in
   both are one row with a count, if so many share an id that they would make a block too large.
2. Each block hashes all its windows from one prefix sum (64 bits), adds up equal ones and sends
   them, packed, to the hash range ("bucket") they belong to. However often a window occurs in a
   block it is sent once, so a passage that a third of all rows share is no hot key.
3. A bucket finds the hashes that came from two blocks or twice from one, and answers each block
   with a bit for each of its own: whether it repeats.
4. At 64 bits some unlike windows of a very large corpus share a hash. So each block sends the windows
   it was answered again, with a second hash from other numbers for words and bytes, and the bucket
   answers those that repeat in both, 128 bits.
5. A block marks the words under these, merges the marks into maximal intervals and drops them.

Shuffled are the texts (once), 8 bytes a distinct window of a block less what sorting and
compression save, 16 bytes a distinct window found to repeat, and bits. Memory of a task: one block, or one
bucket of about 2 ** 19 hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

WINDOW = 35
BLOCK_BYTES = 8 << 20
BUCKET_HASHES = 1 << 19
#: Of each hash family the base of windows over words.
_WORD_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAEF17502108EF2D9))


def window_hashes(words: np.ndarray, first: np.ndarray, window: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of `window` words inside one row."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    base = _WORD_BASES[family]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * c.powers(base, len(words)), out=sums[1:], dtype=np.uint64)
        hashes = c.mix((sums[window:] - sums[:-window]) * c.powers(c.inverse(base), n))
    row_end = np.repeat(first[1:], np.diff(first))
    whole = np.flatnonzero(np.arange(n) + window <= row_end[:n])
    return hashes[whole], whole


@dataclass(frozen=True)
class Plan:
    """Words of a window; buckets are 2 ** bits; of first hashes the highest `kept` bits count."""

    window: int
    bits: int
    kept: int = 64

    def windows(self, docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window its first hash, its first word and how many equal rows have it."""
        data, at = c.arrow_bytes(docs["text"])
        _, _, words, first = c.hashed_words(data, at, c.BLANKS)
        hashes, where = window_hashes(words, first, self.window)
        hashes &= np.uint64((1 << 64) - (1 << (64 - self.kept)))
        times = docs["times"].to_numpy()
        return hashes, where, times[np.searchsorted(first, where, "right") - 1] if times.max(initial=1) > 1 else np.ones(len(where), np.int64)

    def seconds(self, docs: pa.Table) -> np.ndarray:
        data, at = c.arrow_bytes(docs["text"])
        _, _, words, first = c.hashed_words(data, at, c.BLANKS, family=1)
        return window_hashes(words, first, self.window, family=1)[0]

    def edges(self, hashes: np.ndarray) -> np.ndarray:
        """Where each bucket's hashes begin among sorted ones, and the end."""
        inner = np.searchsorted(hashes, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        return np.concatenate([[0], inner, [len(hashes)]])

    def sent(self, docs: pa.Table, hashes: np.ndarray, **more: np.ndarray) -> pa.Table:
        """Sorted hashes, and what goes with them, by bucket."""
        edges = self.edges(hashes)
        used = np.flatnonzero(np.diff(edges))
        block = docs["block"][0].as_py() if len(docs) else 0
        out = {"bucket": pa.array(used, pa.int64()), "block": pa.array(np.full(len(used), block), pa.int64())}
        for name, column in {"hashes": hashes, **more}.items():
            parts = [column[edges[i] : edges[i + 1]] for i in used]
            out[name] = pa.array([c.pack(x) if column.dtype == np.uint64 else _bits(x) for x in parts], pa.binary())
        return pa.table(out)

    def told(self, hashes: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Of sorted hashes that were sent, which ones the buckets' answers name."""
        out, edges = np.zeros(len(hashes), bool), self.edges(hashes)
        for bucket, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            lo, hi = edges[bucket], edges[bucket + 1]
            out[lo:hi] = _flags(bits, hi - lo)
        return out

    def suspects(self, docs: pa.Table, flags: np.ndarray | pa.Table) -> tuple[np.ndarray, ...]:
        """The windows whose first hash is flagged among the block's distinct ones: first word, both hashes and times,
        in order of the hashes; and the flags."""
        hashes, where, times = self.windows(docs)
        order = np.argsort(hashes)
        new = _new(hashes[order])
        distinct = hashes[order[new]]
        flags = self.told(distinct, flags) if isinstance(flags, pa.Table) else flags[: len(distinct)]
        some = order[flags[np.cumsum(new) - 1]] if len(order) else order
        first, second = hashes[some], self.seconds(docs)[some] if len(some) else hashes[some]
        order = np.lexsort((second, first))
        return where[some[order]], first[order], second[order], times[some[order]], flags


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes() if flags.any() else b""


def _flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool) if packed else np.zeros(n, bool)


def _requests(docs: pa.Table, plan: Plan) -> pa.Table:
    hashes, _, times = plan.windows(docs)
    if times.max(initial=1) > 1:
        hashes, own = np.unique(hashes, return_inverse=True)
        n = np.bincount(own, times, len(hashes))
    else:
        hashes, n = np.unique(hashes, return_counts=True)
    return plan.sent(docs, hashes, again=n > 1)


def _answers(table: pa.Table) -> pa.Table:
    """For each block a bit a hash that it sent, in its order: whether it repeats."""
    sent = [c.unpack(x) for x in table["hashes"].to_pylist()]
    again = [h[_flags(x, len(h))] for h, x in zip(sent, table["again"].to_pylist(), strict=True)]
    every = np.sort(np.concatenate([*sent, *again]))
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    bits = [_bits(np.isin(h, repeated, assume_unique=True)) for h in sent]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of a sorted list differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def _questions(docs: pa.Table, answers: pa.Table, plan: Plan) -> pa.Table:
    """The block's windows that seem to repeat, by both hashes; the flags they were told by go along, to come back."""
    _, first, second, times, flags = plan.suspects(docs, answers)
    head = np.flatnonzero(_new(first, second))
    again = np.add.reduceat(times, head) > 1 if len(head) else np.empty(0, bool)
    out = plan.sent(docs, first[head], second=second[head], again=again)
    return out.append_column("flags", pa.array([_bits(flags)] + [None] * (len(out) - 1) if len(out) else [], pa.binary()))


def _confirmed(table: pa.Table) -> pa.Table:
    """For each block a bit a pair of hashes that it sent, in its order: whether the pair repeats."""
    sent = [(c.unpack(a), c.unpack(b)) for a, b in zip(table["hashes"].to_pylist(), table["second"].to_pylist(), strict=True)]
    edges = np.cumsum([0, *(len(a) for a, _ in sent)])
    first, second = (np.concatenate([x[k] for x in sent]) for k in (0, 1))
    again = np.concatenate([_flags(x, len(a)) for x, (a, _) in zip(table["again"].to_pylist(), sent, strict=True)])
    order = np.lexsort((second, first))
    group = np.cumsum(_new(first[order], second[order])) - 1
    often = np.bincount(group) + np.bincount(group, again[order]) > 1
    good = np.empty(len(first), bool)
    good[order] = often[group]
    bits = [_bits(good[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary()), "flags": table["flags"]})


def _marks(docs: pa.Table, answers: pa.Table, plan: Plan, n_words: int) -> np.ndarray:
    """Of every word, and one more, by how many the windows over it grow there."""
    marks = np.zeros(n_words + 1, np.int64)
    flags = next((x for x in answers["flags"].to_pylist() if x is not None), None)
    if flags is not None:
        where, first, second, _, _ = plan.suspects(docs, _flags(flags, 8 * len(flags)))
        new = _new(first, second)
        good = plan.told(first[new], answers)[np.cumsum(new) - 1]
        marks += np.bincount(where[good], minlength=len(marks))
        marks -= np.bincount(where[good] + plan.window, minlength=len(marks))
    return marks


def _cut(docs: pa.Table, answers: pa.Table, plan: Plan) -> pa.Table:
    data, at = c.arrow_bytes(docs["text"])
    starts, ends, first = c.word_spans(data, at, c.BLANKS)
    marks = _marks(docs, answers, plan, len(starts))
    gone = np.cumsum(marks)[:-1] > 0
    kept, intervals, removed = [], [], []
    raw = data.tobytes()
    for i in range(len(at) - 1):
        lo, hi = first[i], first[i + 1]
        drop = gone[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
        intervals.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        removed.append(int(drop.sum()))
        if removed[-1]:
            keep = np.flatnonzero(~drop) + lo
            kept.append(b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode())
        else:
            kept.append(b" ".join(raw[at[i] : at[i + 1]].split()).decode())
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "times": docs["times"],
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(intervals, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(kept, pa.string()),
        }
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, first_bits: int = 64) -> DataFrame:
    """Each document without the words that lie in a window of `window` words found twice anywhere.

    Returns a row for each input row: doc_id, n_words, n_removed, removed (maximal intervals of
    word positions, end exclusive) and kept_text (the words that stay, joined by one space).

    A null text has no words; texts shorter than a window lose nothing; an empty table gives an
    empty result. Rows that repeat, with equal or null ids too, repeat each other's windows and
    lose them all; however many they are, they are one row of their block. Texts of any length are
    taken whole. Other columns are ignored. Of first hashes first_bits count: fewer than 64 only
    make the second ones work harder.
    """
    spark = docs.sparkSession
    c.short_batches(spark)
    rows = c.pick(docs, "doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(c.partitions(spark), total // block_bytes + 1)
    buckets = max(c.partitions(spark), total // 6 // BUCKET_HASHES + 1)
    plan = Plan(window, max(1, int(buckets - 1).bit_length()), first_bits)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    dealt = c.collapsed(rows, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"), "times", block)
    dealt = c.dealt(dealt, "block", total)
    sent = "bucket long, block long, hashes binary"
    requests = dealt.groupBy("block").applyInArrow(lambda t: _requests(t, plan), f"{sent}, again binary")
    answers = requests.groupBy("bucket").applyInArrow(_answers, "block long, bucket long, bits binary")
    questions = (
        dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _questions(d, a, plan), f"{sent}, second binary, again binary, flags binary")
    )
    confirmed = questions.groupBy("bucket").applyInArrow(_confirmed, "block long, bucket long, bits binary, flags binary")
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, times long, n_words long, n_removed long, removed array<struct<first: long, end: long>>, kept_text string"
    out = dealt.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(lambda d, a: _cut(d, a, plan), kinds)
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
