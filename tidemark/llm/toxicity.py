"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability p = sigmoid(bias + weights of
its distinct words), and the document is toxic if any sentence is, or for a cause that no sentence
shows (the leak): score = 1 - (1 - leak) * product(1 - p), the leaky noisy-or. Only documents are
labelled; the likelihood of their labels trains weights, bias and leak together, and the sentence
probabilities then locate the offending ones. The leak absorbs labels that the text doesn't
explain, which would otherwise lift every sentence of long clean documents.

Training takes a bounded sample: of the labelled documents SAMPLE of each class at most, in the
order of a hash of their ids, and of these each that still fits into SAMPLE_BYTES of text: a text too
long for what is left is passed over, and the next one tried. The sample is weighted back to the
classes' true sizes. Scoring covers every document in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

SAMPLE = 3000
SAMPLE_BYTES = 24 << 20
FEATURES = 3000
LEAST_DOCUMENTS = 5
L1 = 0.003  # over the square root of the sample's size
STEPS = 400
RATE = 0.1
THRESHOLD = 0.3
OFFENDING = 0.5

_ENDS = np.zeros(256, np.int64)
_ENDS[list(b".!?\n")] = 1


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its hash and sentence; of each sentence its row, first byte and end."""
    starts, ends, hashes, first = c.hashed_words(data, at, c.ALNUM, lower=True)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    if not len(starts):
        none = np.empty(0, np.int64)
        return hashes, none, none, none, none
    passed = np.cumsum(_ENDS[data])[starts]
    new = np.concatenate([[True], (passed[1:] != passed[:-1]) | (row[1:] != row[:-1])])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    return hashes, np.cumsum(new) - 1, row[head], starts[head], ends[tail]


@dataclass
class Model:
    hashes: np.ndarray  # of the words with a weight, in order
    weights: np.ndarray
    bias: float
    leak: float

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Each row's probability, each sentence's, and the sentences (row, first byte, end)."""
        words, sentence, row, start, end = sentences(data, at)
        logit = np.full(len(row), self.bias)
        if len(self.hashes) and len(words):
            place = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            known = np.flatnonzero(self.hashes[place] == words)
            once = np.unique(sentence[known] * len(self.hashes) + place[known])
            logit += np.bincount(once // len(self.hashes), self.weights[once % len(self.hashes)], len(row))
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        clean = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), len(at) - 1)
        return 1 - (1 - self.leak) * np.exp(clean), p, (row, start, end)


def _fitting(sizes: list[float], most: float) -> list[bool]:
    """Which of these in turn fit into what those before have left."""
    out = []
    for size in sizes:
        out.append(size <= most)
        most -= size * out[-1]
    return out


def _sample(docs: DataFrame, labels: DataFrame, most_bytes: int) -> tuple[pd.DataFrame, dict[int, int]]:
    """doc_id, toxic, features of the sampled documents, and the classes' sizes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    drawn = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(SAMPLE)
        drawn = part if drawn is None else drawn.union(part)
    lengths = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("bytes"))
    lengths = lengths.orderBy(order, "doc_id").toPandas()
    lengths = lengths[np.array(_fitting(lengths["bytes"].fillna(0).tolist(), most_bytes), bool)]
    if not len(lengths):
        return lengths.assign(features=[]), sizes
    chosen = docs.sparkSession.createDataFrame(lengths[["doc_id", "toxic"]])
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            data, at = c.arrow_bytes(batch.column("text"))
            words, sentence, row, *_ = sentences(data, at)
            pairs = np.unique(np.stack([sentence.astype(np.uint64), words]), axis=1) if len(words) else np.empty((2, 0), np.uint64)
            edge = np.searchsorted(row[pairs[0].astype(np.int64)], np.arange(len(at)))
            packed = [pairs[:, i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "features"])

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    found = texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, features binary")
    found = found.groupBy("doc_id", "toxic").agg(F.max("features").alias("features"))
    return found.toPandas().sort_values("doc_id", ignore_index=True), sizes


def fit(docs: DataFrame, labels: DataFrame, most_bytes: int = SAMPLE_BYTES) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic 0 or 1); without both classes in the sample the model is the base rate.

    The sample holds most_bytes of text at most, taken as the module says.
    """
    c.short_batches(docs.sparkSession)
    docs, labels = c.pick(docs, "doc_id", "text"), c.pick(labels, "doc_id", "toxic")
    found, sizes = _sample(docs, labels, most_bytes)
    y = found["toxic"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        total = sum(sizes.values())
        return Model(np.empty(0, np.uint64), np.empty(0), -40.0, sizes.get(1, 0) / total if total else 0.0)
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    weight /= weight.sum()
    # A document at a time, and of each word of the sample one entry a document: the driver holds no more.
    bags = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in found["features"]]
    words = [np.unique(b[1]) for b in bags]
    owner = np.repeat(np.arange(len(bags)), [len(x) for x in words])
    hashes, place = np.unique(np.concatenate(words), return_inverse=True)
    often = np.bincount(place, minlength=len(hashes))
    share = [np.bincount(place, (weight * (y == k))[owner], len(hashes)) / (weight @ (y == k)) for k in (0.0, 1.0)]
    spread = np.abs(share[1] - share[0]) / np.sqrt((share[0] + share[1]) / 2 + 1e-4)
    spread[often < LEAST_DOCUMENTS] = 0
    kept = np.sort(np.argsort(-spread, kind="stable")[:FEATURES])
    kept = hashes[kept[spread[kept] > 0]]
    del words, owner, place, share, hashes
    features, sentence, owner, count = [], [], [], 0
    for i, (number, word) in enumerate(bags):
        own, number = np.unique(number, return_inverse=True)
        at = np.searchsorted(kept, word)
        known = np.flatnonzero(kept[np.minimum(at, len(kept) - 1)] == word) if len(kept) else np.empty(0, np.int64)
        features.append(at[known])
        sentence.append(number[known] + count)
        owner.append(np.full(len(own), i))
        count += len(own)
    features, sentence, owner = (np.concatenate(x).astype(np.int64) for x in (features, sentence, owner))
    return _descend(features, sentence, owner, y, weight, kept)


def _descend(feature, sentence, owner, y, weight, hashes) -> Model:
    """Maximum likelihood with an L1 penalty: Adam with soft thresholds. Weights stay at 0 or more, as
    in a noisy-or no word speaks against another; that also keeps chance words of clean documents out."""
    n, docs = len(hashes), len(y)
    penalty = L1 / np.sqrt(docs)
    x = np.zeros(n + 2)
    x[n], x[n + 1] = -6.0, -3.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x[n] + np.bincount(sentence, x[feature], len(owner)), -40, 40)))
        p = np.minimum(p, 1 - 1e-9)
        leak = 1 / (1 + np.exp(-x[n + 1]))
        clean = np.bincount(owner, np.log1p(-p), docs) + np.log1p(-leak)
        score = np.clip(-np.expm1(clean), 1e-9, 1)
        # d(-log likelihood)/d(clean): 1 - y / score; d(clean)/d(logit) = -p
        by_clean = weight * (1 - y / score)
        by_logit = by_clean[owner] * p
        gradient = np.concatenate([np.bincount(feature, by_logit[sentence], n), [by_logit.sum()], [by_clean.sum() * leak]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        step = RATE * min(1.0, 3 * (1 - t / (STEPS + 1)))
        scale = step / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        x -= scale * m / (1 - 0.9**t)
        x[:n] = np.maximum(x[:n] - scale[:n] * penalty, 0)
    used = np.flatnonzero(x[:n])
    return Model(hashes[used], x[used], float(x[n]), float(1 / (1 + np.exp(-x[n + 1]))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and offending sentences of every row.

    offending lists the sentences of probability OFFENDING or more: start and end in code points,
    and their probability. Null, empty and wordless texts have no sentence and score the leak.
    Rows that repeat score alike; an empty table gives an empty result; texts are taken whole.
    """
    c.short_batches(docs.sparkSession)
    rows = c.pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            data, at = c.arrow_bytes(batch.column("text"))
            total, p, (row, start, end) = model.score(data, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total), _spans(data, at, p, row, start, end)], names=["doc_id", "score", "offending"]
            )

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, score double, offending array<struct<start: int, end: int, score: double>>")


def _spans(data, at, p, row, start, end) -> pa.Array:
    bad = np.flatnonzero(p >= OFFENDING)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(bad) else np.zeros(1, np.int64)
    base = points[at[row[bad]]] if len(bad) else bad
    spans = pa.StructArray.from_arrays(
        [pa.array(points[start[bad]] - base, pa.int32()), pa.array(points[end[bad]] - base, pa.int32()), pa.array(p[bad], pa.float64())],
        names=["start", "end", "score"],
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[bad], np.arange(len(at))), pa.int32()), spans)


def remove(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs scored under the threshold, all columns as they were.

    A model without words tells no document from another and removes none.
    """
    if not len(model.hashes):
        return docs
    c.short_batches(docs.sparkSession)
    inner, names = c.with_internal(docs, __text="text")
    inner = inner.withColumn("__text", F.col("__text").cast("binary"))

    def run(batches):
        for batch in batches:
            total, *_ = model.score(*c.arrow_bytes(batch.column("__text")))
            yield batch.filter(pa.array(total < threshold))

    return c.restore(inner.mapInArrow(run, inner.schema), names)


def held_out(doc_id):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
