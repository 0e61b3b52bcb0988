"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. Its whole
part is taken outright; the fraction is rounded by the pivotal method: two documents with fractions
p and q exchange mass (fraction times size), at random so that each fraction keeps its expectation,
until one of them is 0 or 1; the other goes on to the next pair. The exchanged masses cancel, so a
source's taken words stay at its target until its last, single fraction is rounded.

The pairing runs as a reduction tree: a source's documents are dealt by a hash into groups of about
FAN, each group is folded in one row, settles all but one document and passes that one on to the
next level, until one is left of each source. Groups are counted a source: one with a third of all
rows is many from the start, a small one is done after its own few levels.
The randomness is a hash of seed and document, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
FAN = 64
SEED = 17


def size_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, 0 of null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).otherwise(F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size -> and weight, target; other columns stay.

    The sources, by code point with null last, weigh `weights` in turn. They share the whole by
    weight; none gets more than `most` times its size, and what is over goes to the others by
    weight. That is one level L with target = min(most * size, L * weight): going through the
    sources by most * size / weight, those whose cap lies under the level of the rest are capped.
    One row a source meets in the two windows; documents never do.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    named = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))
    )
    levels = named.withColumn("level", level).withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    # The first source that isn't capped fixes the level of all that follow.
    fixed = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)["level"]
    return levels.withColumn("fixed", fixed).select(
        *sizes.columns,
        "weight",
        F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fixed") * F.col("weight"))).alias("target"),
    )


_OPEN = "struct<unit:{unit}, size:double, p:double>"


def _fold(unit: str) -> str:
    """SQL: fold a sorted array `units` of (hash, unit, size, p) to (left, settled)."""
    open_type = _OPEN.format(unit=unit)
    settled = f"array<struct<unit:{unit}, up:int>>"
    # a: the one carried; x: the next; `ax`, `xa`: mass that can move to a, to x; t: where the draw falls.
    return f"""
    aggregate(units,
      named_struct('left', cast(null as {open_type}), 'settled', cast(array() as {settled})),
      (s, x) -> if(s.left is null,
        named_struct('left', named_struct('unit', x.unit, 'size', x.size, 'p', x.p), 'settled', s.settled),
        element_at(transform(
          array(named_struct(
            'ax', least((1 - s.left.p) * s.left.size, x.p * x.size),
            'xa', least(s.left.p * s.left.size, (1 - x.p) * x.size))),
          m -> if(x.draw * (m.ax + m.xa) < m.xa,
            if((1 - s.left.p) * s.left.size <= x.p * x.size,
              named_struct(
                'left', named_struct('unit', x.unit, 'size', x.size, 'p', greatest(x.p - m.ax / x.size, 0D)),
                'settled', array_append(s.settled, named_struct('unit', s.left.unit, 'up', 1))),
              named_struct(
                'left', named_struct('unit', s.left.unit, 'size', s.left.size, 'p', least(s.left.p + m.ax / s.left.size, 1D)),
                'settled', array_append(s.settled, named_struct('unit', x.unit, 'up', 0)))),
            if(s.left.p * s.left.size <= (1 - x.p) * x.size,
              named_struct(
                'left', named_struct('unit', x.unit, 'size', x.size, 'p', least(x.p + m.xa / x.size, 1D)),
                'settled', array_append(s.settled, named_struct('unit', s.left.unit, 'up', 0))),
              named_struct(
                'left', named_struct('unit', s.left.unit, 'size', s.left.size, 'p', greatest(s.left.p - m.xa / s.left.size, 0D)),
                'settled', array_append(s.settled, named_struct('unit', x.unit, 'up', 1)))))), 1)))
    """


def round_pivotal(rows: DataFrame, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """rows(source_no, n, unit, size > 0, p in [0, 1)) -> (unit, up 0 or 1), sums of size * p kept by source.

    unit may be any type that can be ordered and tells rows apart; n is how many rows the source has.
    The last fraction of a source goes to the nearer of 0 and 1, so its sum is off by half a unit's
    size at most.
    """
    unit = rows.schema["unit"].dataType.simpleString()
    now = rows.select("source_no", "n", "unit", F.col("size").cast("double").alias("size"), "p")
    done = now.where("p <= 0").select("unit", F.lit(0).alias("up"))
    now = now.where("p > 0")
    largest = now.agg(F.max("n")).first()[0] or 0
    level = 0
    while largest > 0:
        level += 1
        groups = F.ceil(F.col("n") / F.lit(fan))
        hashed = now.withColumn("hash", F.xxhash64(F.lit(seed), F.lit(level), "unit"))
        # Two hashes: one deals the units into groups, the other draws.
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(-level), "unit"), F.lit(1 << 52)) / float(1 << 52)
        folded = (
            hashed.groupBy("source_no", groups.alias("n"), F.pmod(F.xxhash64("hash"), groups).alias("group"))
            .agg(F.sort_array(F.collect_list(F.struct("hash", "unit", "size", "p", draw.alias("draw")))).alias("units"))
            .select("source_no", "n", F.expr(_fold(unit)).alias("f"))
        )
        folded = c.checkpointed(folded.select("source_no", "n", "f.left", "f.settled"))
        done = done.union(folded.select(F.explode("settled").alias("it")).select("it.unit", "it.up"))
        left = folded.select("source_no", "n", "left.unit", "left.size", "left.p")
        done = done.union(left.where("n = 1").select("unit", (F.col("p") >= 0.5).cast("int").alias("up")))
        now = left.where("n > 1")
        largest = -(-largest // fan) if largest > fan else 0
    return done


def _decided(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every row's row key, time among equal rows, size and source; and for each key what its rows get.

    Equal rows are interchangeable: of a key's rows the first `ups` are rounded up.
    """
    rows = c.pick(docs, "doc_id", "source", "text").select(
        "doc_id", "source", c.row_key("doc_id", "source", "text").alias("row"), size_of(F.col("text")).alias("size")
    )
    rows = c.checkpointed(rows.withColumn("time", F.row_number().over(Window.partitionBy("row").orderBy("row"))))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n")), weights, most)
    wanted = wanted.withColumn("source_no", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    wanted = c.checkpointed(wanted.withColumnRenamed("source", "name"))
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    meant = rows.join(wanted, F.col("source").eqNullSafe(F.col("name"))).drop("name", "weight")
    meant = meant.withColumn("mean", mean).withColumn("whole", F.floor("mean").cast("int"))
    fractions = meant.where("size > 0").select("source_no", "n", F.struct("row", "time").alias("unit"), "size", (F.col("mean") - F.col("whole")).alias("p"))
    ups = round_pivotal(fractions, seed).groupBy(F.col("unit.row").alias("row")).agg(F.sum("up").alias("ups"))
    return meant, ups


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: 0 to `most` times.

    Returns a row for each input row: doc_id, source, size (words), source_size, target (of its
    source) and copies. Null texts have size 0; null sources are one source, the last; null ids are
    ids. Documents without words bring nothing to a target and are taken as often as their source's
    whole part says. If no document has a word all targets are 0. Rows that repeat are rounded each
    for itself. An empty table gives an empty result. Other columns are ignored.
    """
    meant, ups = _decided(docs, weights, most, seed)
    number = F.col("whole") + (F.col("time") <= F.coalesce("ups", F.lit(0))).cast("int")
    return meant.join(ups, "row", "left").select("doc_id", "source", "size", "source_size", "target", number.alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as `copies` says, all its columns as they were.

    Texts are shuffled once: numbering equal rows and the join have one key.
    """
    meant, ups = _decided(docs, weights, most, seed)
    keys = meant.groupBy(F.col("row").alias("__row")).agg(F.max("whole").alias("__whole"))
    keys = keys.join(ups.withColumnRenamed("row", "__row"), "__row", "left").withColumn("__ups", F.coalesce("ups", F.lit(0))).drop("ups")
    inner, names = c.with_internal(docs, __id="doc_id", __source="source", __text="text")
    inner = inner.withColumn("__row", c.row_key("__id", "__source", "__text")).drop("__id", "__source", "__text")
    inner = inner.withColumn("__time", F.row_number().over(Window.partitionBy("__row").orderBy("__row")))
    number = F.col("__whole") + (F.col("__time") <= F.col("__ups")).cast("int")
    taken = inner.join(keys, "__row").withColumn("__number", number).where("__number > 0")
    return c.restore(taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__number")))), names)
