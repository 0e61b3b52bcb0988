"""Document fingerprints: bottom-k sketches of word shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the K smallest distinct 63-bit hashes of a text's five-word
shingles. Sketches of parts merge into the sketch of the whole; two sketches estimate resemblance
and containment, one the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c
from .ordering import before

K = 128
SHINGLE = 5
SALTS = 64
_BLANK = " \t\n\x0b\x0c\r"
_MASK = (1 << 63) - 1


def with_sketch(rows: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """rows and the sketch of a text column.

    Words are runs of anything but ASCII blanks, unchanged; a text of fewer words than a shingle is
    one shingle; null, empty and blank texts have an empty sketch.
    """
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANK))
    words = F.transform(F.split(trimmed, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))
    hashed = rows.withColumn("_words", F.when(F.length(trimmed) > 0, words).otherwise(F.array().cast("array<long>")))
    places = F.sequence(F.lit(0), F.greatest(F.size("_words") - shingle, F.lit(0)))
    # get() is null past the end, so a short text's missing words hash as nulls: skipped.
    shingles = F.transform(
        places, lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(shingle)]).bitwiseAND(F.lit(_MASK))
    )
    least = F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)
    return hashed.withColumn(name, F.when(F.size("_words") > 0, least).otherwise(F.col("_words"))).drop("_words")


def union_of(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all; 1 of two empty texts, 0 of one.

    Exact where both sketches hold fewer than k hashes. The standard error is sqrt(r (1 - r) / k).
    """
    both = union_of(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact under k."""
    kth = F.get(a, F.lit(k - 1)).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << 63) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 where a is empty."""
    both = distinct_shingles(union_of(a, b, k), k)
    share = resemblance(a, b, k) * both / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def to_string(sketch: Column) -> Column:
    """Sixteen hex digits a hash; empty for an empty sketch."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch a key, from any number of sketches of its parts: key, sketch.

    Hashes over what can still be among the k smallest fall away in SALTS groups a key before the
    key's own rows meet, so a key with a third of all parts takes no task of its own size: at most
    SALTS * k hashes of it come together. Null keys are one key; null and empty sketches add nothing.
    """
    hashes = parts.select(F.col(key), F.explode(sketch).alias("hash")).distinct()
    salted = Window.partitionBy(key, F.pmod("hash", F.lit(SALTS))).orderBy("hash")
    few = hashes.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    merged = few.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("hash")), 1, k).alias(sketch))
    keys = parts.select(key).distinct()
    same = keys[key].eqNullSafe(merged[key])
    return keys.join(merged, same, "left").select(keys[key], F.coalesce(merged[sketch], F.array().cast("array<long>")).alias(sketch))


def with_next(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document, its sketch, and both of the document that follows it by descending doc_id.

    Returns doc_id, text (null as empty), sketch, next_id, next_prefix (as many of the next text's
    first code points as a third of the own text has, or all of it) and next_sketch. After the last
    document comes the first. Null ids come last; rows of one id follow by a hash of their text, and
    equal rows follow one another. An empty table gives an empty result; other columns are ignored.

    Texts are shuffled once, each with its sketch, and a second time by the prefix alone: the order
    is found from ids and lengths.
    """
    text = F.coalesce("text", F.lit(""))
    rows = c.pick(docs, "doc_id", "text").select(
        "doc_id", text.alias("text"), F.coalesce(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text").isNull().cast("string"), text)), F.lit("")).alias("row")
    )
    order = [F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down")]
    ids = rows.select("row", *order, F.length("text").alias("n")).distinct()
    follows = before(ids, ["none", "down", "row"], ["row", "n"]).select("row", F.col("prev.row").alias("prev"), F.col("prev.n").alias("n"))
    # A running count, not row_number(): a rank filter would be pushed below the exchange and end its reuse.
    times = Window.partitionBy("row").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    own = with_sketch(rows, "text", "sketch", k, shingle).withColumn("time", F.count(F.lit(1)).over(times))
    sent = own.where("time = 1").join(follows, "row").select(
        F.col("prev").alias("row"),
        F.col("doc_id").alias("next_id"),
        F.expr("substring(text, 1, n div 3)").alias("next_prefix"),
        F.col("sketch").alias("next_sketch"),
    )
    again = F.col("time") > 1
    # Both joins are on row alone, never null, so that the texts' one exchange serves them and the window.
    return own.join(sent, "row", "left").select(
        "doc_id",
        "text",
        "sketch",
        F.when(again, F.col("doc_id")).otherwise(F.col("next_id")).alias("next_id"),
        F.when(again, F.expr("substring(text, 1, length(text) div 3)")).otherwise(F.col("next_prefix")).alias("next_prefix"),
        F.when(again, F.col("sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"),
    )
