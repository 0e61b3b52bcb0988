"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words: the marked positions are hashed, the others ignored, so a
passage keeps most of its hashes when single words are replaced. The hashes of all test items form
a sorted index; each document hashes all its positions under the same masks and joins them to the
index; each hit fixes an alignment of document and item, along which words are compared and any
region that is long and similar enough counts.

Hits are taken once a run: where a hit follows another on its alignment, the first one tells it. Texts
that repeat few words would otherwise hit at every place of both sides. Alignments are at most as
many as both have words, and are judged from the one with the most equal words on.

The index is broadcast in slices of at most INDEX_BYTES; a larger benchmark takes more slices, each
a pass over the documents, and no document is shuffled. Work grows with documents times slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Marked positions; weight 6, spans 8, 10, 12 and 13. Of 15 words with any three replaced, one mask at least fits.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 9), (0, 1, 4, 6, 10, 11), (0, 3, 4, 8, 11, 12))
#: A region counts from so many equal words, or so large a share of a shorter item's,
MIN_WORDS = 12
SHARE = 0.8
#: and at this share of equal words inside it.
IDENTITY = 0.8
_LOSS = round(IDENTITY / (1 - IDENTITY))
#: Items under WHOLE words have seeds of their own at fixed places; under SHORTEST they prove nothing.
SHORTEST, WHOLE = 5, 15
INDEX_BYTES = 64 << 20
_BYTES_A_WORD = 56 * len(MASKS) + 8
#: Hits looked at together.
_HITS = 1 << 20
_ODD = np.random.default_rng(77).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(words: np.ndarray, first: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of the mask at every place where its span lies in one row."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.full(n, len(mask) * 1000 + mask[-1], np.uint64)
        for k, offset in enumerate(mask):
            out += words[offset : offset + n] * _ODD[k]
        out = c.mix(out)
    where = np.flatnonzero(np.arange(n) + mask[-1] < np.repeat(first[1:], np.diff(first))[:n])
    return out[where], where


def region(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the region with the most equal words among all at IDENTITY, the shortest of those.

    With a match 1 and a substitution -4, a region is at 80 % where the prefix sums don't fall from
    its start to its end; for each start the furthest such end has the most equal words.
    """
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -_LOSS))])
    most = np.maximum.accumulate(score[::-1])
    end = len(same) - np.searchsorted(most, score)
    at = np.concatenate([[0], np.cumsum(same)])
    equal = at[end] - at
    where = np.flatnonzero(same)
    best = []
    for start in np.flatnonzero(equal == equal.max()).tolist():
        # Without the unequal words at either end.
        own = where[at[start] : at[end[start]]]
        if len(own):
            best.append((int(own[-1]) + 1 - int(own[0]), int(own[0])))
    length, start = min(best, default=(0, 0))
    return start, start + length


def masks_of(length: int) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """(place in the item, mask) for an item under WHOLE words.

    The item is cut into pieces; a mask marks all pieces but as many as words may be replaced, so
    whichever words are, or lie beyond the document's edge, one mask holds none of them.
    """
    if not SHORTEST <= length < WHOLE:
        return ()
    lost = length - math.ceil(min(MIN_WORDS, SHARE * length))
    pieces = [x.tolist() for x in np.array_split(np.arange(length), length if lost == 1 else 5)]
    marked = [sum(x, []) for x in combinations(pieces, len(pieces) - lost)]
    return tuple((m[0], tuple(i - m[0] for i in m)) for m in marked)


def _preceding(hashes: np.ndarray, where: np.ndarray, none: int) -> np.ndarray:
    """The hash at the place just before each, `none` if that place has none."""
    out = np.full(len(hashes), none, np.uint64)
    follows = np.flatnonzero(where[1:] == where[:-1] + 1) + 1
    out[follows] = hashes[follows - 1]
    return out


def _expanded(lo: np.ndarray, times: np.ndarray) -> np.ndarray:
    """lo, lo + 1, .. of each, `times` of them."""
    return np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())


@dataclass
class Index:
    """A slice of the test items: their words, and their seeds in order of hash and of the hash before."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    masks: list[tuple[int, ...]]
    item: np.ndarray
    offset: np.ndarray
    #: Seeds alike in both hashes are a group: its hash, the hash before, and where its seeds begin (one more at the end).
    hashes: np.ndarray
    before: np.ndarray
    group: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[bytes | None]) -> Index:
        data, at = c.arrow_bytes(pa.array(texts, pa.binary()))
        _, _, words, first = c.hashed_words(data, at, c.ALNUM)
        lengths = np.diff(first)
        places = [(n, *x) for n in sorted(set(lengths.tolist())) for x in masks_of(n)]
        if (lengths >= WHOLE).any():
            places += [(None, None, m) for m in MASKS]
        parts = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for n, place, m in places:
            hashes, where = seeds(words, first, m)
            item = np.searchsorted(first, where, "right") - 1
            own = lengths[item] >= WHOLE if n is None else (lengths[item] == n) & (where - first[item] == place)
            hashes, where, item = hashes[own], where[own], item[own]
            parts.append((hashes, _preceding(hashes, where, 0), item, where - first[item]))
        masks = sorted({m for *_, m in places})
        hashes, before, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((before, hashes))
        hashes, before = hashes[order], before[order]
        new = np.flatnonzero((np.diff(hashes, prepend=hashes[:1]) != 0) | (np.diff(before, prepend=before[:1]) != 0))
        head = np.concatenate([[0], new]) if len(hashes) else new
        return Index(ids, words, first, masks, item[order].astype(np.int32), offset[order].astype(np.int32), hashes[head], before[head], np.append(head, len(hashes)))

    def alignments(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(row, item, shift of the item's start in the row) of every alignment with a hit, in order."""
        longest = int(np.diff(self.first).max(initial=0))
        span = longest + int(np.diff(first).max(initial=0)) + 1
        keys = np.empty(0, np.int64)
        for m in self.masks:
            hashes, where = seeds(words, first, m)
            before = _preceding(hashes, where, 1)
            lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
            hit = np.flatnonzero(hi > lo)
            seed, group = np.repeat(hit, (hi - lo)[hit]), _expanded(lo[hit], (hi - lo)[hit])
            starts = self.before[group] != before[seed]
            seed, group = seed[starts], group[starts]
            size = self.group[group + 1] - self.group[group]
            row = np.searchsorted(first, where[seed], "right") - 1
            for i, j in c.pieces(np.concatenate([[0], np.cumsum(size)]), _HITS):
                entry, times = _expanded(self.group[group[i:j]], size[i:j]), size[i:j]
                own = np.repeat(row[i:j], times)
                shift = np.repeat(where[seed[i:j]], times) - first[own] - self.offset[entry]
                keys = np.union1d(keys, (own * len(self.ids) + self.item[entry]) * span + shift + longest)
        pair, shift = np.divmod(keys, span)
        return np.stack([*np.divmod(pair, max(1, len(self.ids))), shift - longest])

    def search(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, equal words, region's length, its start in the row, in the item): the best of each pair.

        The best has the most equal words, then is the shortest, then starts the item the furthest left in the row.
        """
        rows, items, shifts = self.alignments(words, first)
        edges = np.flatnonzero((np.diff(rows, prepend=-1, append=-1) != 0) | (np.diff(items, prepend=-1, append=-1) != 0))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            row, item = int(rows[i]), int(items[i])
            found = _best(words[first[row] : first[row + 1]], self.words[self.first[item] : self.first[item + 1]], shifts[i:j].tolist())
            if found:
                yield row, item, *found


def _best(mine: np.ndarray, its: np.ndarray, shifts: list[int]) -> tuple[int, int, int, int] | None:
    need, open_ = min(MIN_WORDS, SHARE * len(its)), []
    for shift in shifts:
        lo, hi = max(0, -shift), min(len(its), len(mine) - shift)
        equal = int(np.count_nonzero(mine[lo + shift : hi + shift] == its[lo:hi]))
        if equal >= need:
            open_.append((-equal, shift, lo, hi))
    best = None
    for most, shift, lo, hi in sorted(open_):
        if best and (best[0], -best[1]) >= (-most, most):
            break  # no region of this alignment, or of one after it, can be better
        same = mine[lo + shift : hi + shift] == its[lo:hi]
        start, end = region(same)
        length, equal = end - start, int(same[start:end].sum())
        if length and equal >= need and (best is None or (equal, -length) > (best[0], -best[1])):
            best = (equal, length, lo + start + shift, lo + start)
    return best


def slices(benchmark: DataFrame) -> Iterator[Index]:
    """The test items, in indexes of at most about INDEX_BYTES."""
    rows = c.pick(benchmark, "item_id", "text").withColumn("text", F.lower("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size * _BYTES_A_WORD // 6 // INDEX_BYTES + 1
    rows = rows.withColumn("text", F.col("text").cast("binary")).withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for i in range(n):
        part = rows.where(F.col("slice") == i).orderBy("item_id", "text").toArrow()
        yield Index.of(part["item_id"].to_pylist(), part["text"].to_pylist())


def _words(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    data, at = c.arrow_bytes(batch.column(name))
    return c.hashed_words(data, at, c.ALNUM)[2:]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document row and test item that share a passage, and none for clean documents.

    Returns doc_id, item_id, n_equal, n_words (length of the shared region), doc_word, item_word
    (its starts, words from 0). Words are runs of ASCII letters, digits and non-ASCII characters,
    in lower case. Null and empty texts share nothing; items under five words are passed over;
    equal items and repeated documents each have their rows; an empty table on either side gives
    an empty result. Whole texts are searched, and other columns ignored.
    """
    spark = docs.sparkSession
    c.short_batches(spark)
    rows = c.pick(docs, "doc_id", "text").select("doc_id", F.lower("text").cast("binary").alias("text"))
    item_type = benchmark.schema["item_id"].dataType
    doc_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, n_equal long, n_words long, doc_word long, item_word long"

    def one(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            own = shared.value
            for batch in batches:
                found = list(own.search(*_words(batch, "text")))
                columns = list(zip(*found, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
                        pa.array([own.ids[i] for i in columns[1]]).cast(item_arrow),
                        *(pa.array(x, pa.int64()) for x in columns[2:]),
                    ],
                    names=["doc_id", "item_id", "n_equal", "n_words", "doc_word", "item_word"],
                )

        return rows.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(item_type)
    out = None
    for index in slices(benchmark):
        out = one(index) if out is None else out.union(one(index))
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no passage with any test item, all columns as they were."""
    spark = docs.sparkSession
    c.short_batches(spark)
    inner, names = c.with_internal(docs, __text="text")
    inner = inner.withColumn("__text", F.lower("__text").cast("binary"))
    for index in slices(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in shared.value.search(*_words(batch, "__text"))]] = False
                yield batch.filter(pa.array(clean))

        inner = inner.mapInArrow(run, inner.schema)
    return c.restore(inner, names)
