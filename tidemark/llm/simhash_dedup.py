"""SimHash near-dedup: an inverted index over byte positions with count filtering.

A fingerprint of 64 bits is eight bytes. Two that differ in at most two bits agree in at least six
byte positions, so pairs sharing fewer positional bytes can't link. A posting list of one positional
byte would hold 1/256 of all fingerprints, and its pairs would grow with the square of the corpus;
a list therefore holds the fingerprints that agree in four positions at once, and fourteen sets of
four are chosen so that the lists a pair meets in tell exactly which positions it shares, if they are
six or more (LISTS). These positions are tallied over a pair's lists, pairs with the guaranteed six
are retained, and their bits compared.

Equal fingerprints are one entry of the index, however many documents have them. A list longer than
POSTING (a crowd of near copies) makes no pairs, as they would grow with its square. Its members go
by the midpoint rule as well, an exact way that stands for all pairs they would make: two
fingerprints lie within two bits exactly if some value lies within one bit of both, so each member
is entered under itself and its 64 one-bit changes, and linked to the smallest entry there: 65 rows
a member, all of them true links, and no link's ends apart.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c
from . import xxh64
from .components import label

SHINGLE = 3
BITS = 2
POSTING = 32
SEED = 42
_CHUNK = 1 << 15
_PIECE = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with every text's words in lower case, a space apart; starts and ends of the shingles in them; and how
    many of these each text has: one of all its words if they are fewer than k, none without words."""
    starts, ends, first = c.word_spans(data, at, c.BLANKS)
    lengths = ends - starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spaced = np.full(len(starts) + int(lengths.sum()), 32, np.uint8)
    letters = np.ones(len(spaced), bool)
    letters[ends] = False
    spaced[letters] = _LOWER[data[c.BLANKS[data]]]
    n = np.diff(first)
    times = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    own = np.repeat(first[:-1] - np.cumsum(times) + times, times) + np.arange(times.sum())
    last = np.minimum(own + k, np.repeat(first[1:], times)) - 1
    return spaced, starts[own], ends[last], times


def majority(hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of each run of hashes the bits that over half of them have, signed; 0 of an empty run."""
    ones = np.zeros((len(times), 64), np.int64)
    owner = np.repeat(np.arange(len(times)), times)
    for i in range(0, len(hashes), _CHUNK):
        # A byte a bit, eight of them added as one number, in runs too short to overflow a byte.
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        own = owner[i : i + _CHUNK]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        runs = np.unique(np.concatenate([heads, np.arange(0, len(own), 255)]))
        sums = np.add.reduceat(bits, runs, axis=0).view(np.uint8).reshape(-1, 64)
        np.add.at(ones, own[runs], sums)
    return np.packbits(ones * 2 > times[:, None], axis=1, bitorder="little").view(np.int64).reshape(-1)


def simhashes(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The signed 64 bits of each text's SimHash, some megabytes of text at a time."""
    parts = [np.empty(0, np.int64)]
    for i, j in c.pieces(at, _PIECE):
        spaced, starts, ends, times = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
        parts.append(majority(xxh64.hashes(spaced, starts, ends, SEED), times))
    return np.concatenate(parts)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (a key of id and text) and fingerprint (signed long) of every row."""
    c.short_batches(docs.sparkSession)
    rows = c.pick(docs, "doc_id", "text").select(
        "doc_id", c.row_key("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text")
    )

    def run(batches):
        for batch in batches:
            prints = pa.array(simhashes(*c.arrow_bytes(batch.column("text")), shingle), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), prints], names=["doc_id", "row", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row string, fingerprint long")


#: The posting lists: four of the eight byte positions each, all sets whose numbers XOR to 0. Any three positions lie
#: in exactly one of the fourteen, so two fingerprints that share six positions share three lists (seven: seven),
#: which together hold exactly the shared positions; sharing five they share one list.
LISTS = tuple(x for x in combinations(range(8), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0)


def links(prints: DataFrame, posting: int = POSTING) -> DataFrame:
    """From distinct fingerprints f: links (a, b) whose components are those of all pairs within two bits."""
    byte = [F.shiftrightunsigned("f", 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(8)]
    entries = [
        F.struct(
            F.lit(sum(1 << i for i in places)).cast("short").alias("places"),
            reduce(lambda value, i: F.shiftleft(value, 8).bitwiseOR(byte[i]), places, F.lit(0).cast("long")).alias("bytes"),
        )
        for places in LISTS
    ]
    index = prints.select("f", F.explode(F.array(*entries)).alias("key")).select("f", "key.places", "key.bytes")
    lists = index.groupBy("places", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    index = c.checkpointed(index.join(lists, ["places", "bytes"]))
    short = index.where(F.col("n") <= posting)
    pairs = short.select("places", "bytes", F.col("f").alias("a")).join(short.select("places", "bytes", F.col("f").alias("b")), ["places", "bytes"]).where("a < b")
    tally = pairs.groupBy("a", "b").agg(F.bit_count(F.bit_or("places")).alias("shared"))
    close = tally.where(F.col("shared") >= 8 - BITS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    crowd = index.where(F.col("n") > posting).select("f").distinct()
    changes = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    near = crowd.select("f", F.explode(F.concat(F.array(F.lit(0).cast("long")), changes)).alias("change")).select(
        "f", F.col("f").bitwiseXOR(F.col("change")).alias("value")
    )
    least = near.groupBy("value").agg(F.min("f").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return close.union(near.join(least, "value").where("f <> b").select(F.col("f").alias("a"), "b"))


def group(docs: DataFrame, shingle: int = SHINGLE, posting: int = POSTING) -> DataFrame:
    """doc_id, fingerprint (signed long), root and component_id of every row.

    component_id is the smallest doc_id reachable by links of two bits at most, the row's own
    included; null ids count last, and it is null only if no row of the component has an id.
    Null, empty and blank texts have fingerprint 0, linked like any other. Rows that repeat have
    equal fingerprints and so one component. An empty table gives an empty result. Other columns
    are ignored.
    """
    rows = c.checkpointed(fingerprints(docs, shingle).drop("row"))
    prints = c.checkpointed(rows.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("smallest")))
    labels = label(links(prints.select("f"), posting))
    labelled = prints.join(labels.withColumnRenamed("node", "f"), "f", "left").select(
        "f", F.coalesce("root", "f").alias("root"), "smallest"
    )
    least = labelled.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = labelled.join(least, "root").select(F.col("f").alias("fingerprint"), "root", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, posting: int = POSTING) -> DataFrame:
    """The row of each component that has the smallest doc_id, all its columns as they were.

    A null id comes after all others; of rows with one id the smaller row key (a hash) stays, of
    rows equal in id and text any one. Each fingerprint's first row is found before components are,
    so however many copies a text has they never meet; texts are shuffled once.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    prints = fingerprints(docs, shingle).groupBy(F.col("fingerprint").alias("f")).agg(F.min(order).alias("first"))
    prints = c.checkpointed(prints)
    labels = label(links(prints.select("f"), posting)).withColumnRenamed("node", "f")
    first = prints.join(labels, "f", "left").groupBy(F.coalesce("root", "f")).agg(F.min("first")["row"].alias("__row")).select("__row")
    inner, names = c.with_internal(docs, __id="doc_id", __text="text")
    inner = inner.withColumn("__row", c.row_key("__id", "__text")).drop("__id", "__text")
    equal = Window.partitionBy("__row").orderBy("__row")
    kept = inner.join(first, "__row", "left_semi").withColumn("__time", F.row_number().over(equal)).where("__time = 1")
    return c.restore(kept, names)
