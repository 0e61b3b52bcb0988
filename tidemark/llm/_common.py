"""Helpers that the training-data operators share.

Text reaches Python as UTF-8 bytes in Arrow batches; words are found and hashed with numpy over
the batch's one contiguous buffer, so that no Python object is made per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Documents vary from bytes to megabytes, so batches are kept short.
BATCH_ROWS = 500

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_SEED = 20_240_601


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The columns of these exact names, whatever else the table holds.

    Columns are taken by position, so that others whose names differ in case only, hold dots or
    occur twice cannot make a reference ambiguous. The first of several equal names counts.
    """
    wanted = [(n, n) for n in names] + [(old, new) for new, old in renamed.items()]
    tagged = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return tagged.select(*[F.col(f"c{df.columns.index(old)}").alias(new) for old, new in wanted])


def with_internal(df: DataFrame, **internal: str) -> tuple[DataFrame, list[str]]:
    """All columns under positional names c0.. , then copies of the named ones; see `restore`."""
    tagged = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return (
        tagged.select("*", *[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in internal.items()]),
        list(df.columns),
    )


def restore(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Undo `with_internal`: the original columns, and internal ones to be returned besides."""
    return df.select(*[f"c{i}" for i in range(len(names))], *more).toDF(*names, *more)


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and Spark runs in one process, one of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to a new table in the shared folder and read it again; and the table's folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file systems, once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, column: str, size: int, most: int = 128 << 20) -> DataFrame:
    """Spread by a column so that a partition holds about `most` of `size` bytes, where the session's shuffle
    partitions would hold more; else as it is, to be shuffled (and coalesced) as the session says."""
    wanted = size // most + 1
    return df.repartition(wanted, column) if wanted > partitions(df.sparkSession) else df


def collapsed(rows: DataFrame, key: str, value: str, most: int = 1000) -> DataFrame:
    """rows(key, value) and `times`: rows equal in both are one row, of keys that hold over 1/most of all rows
    (and over `most` rows). Other rows stay single, times 1.

    There are fewer than `most` such keys whatever the table, so that they may be collected and broadcast. Equal
    rows are added up before they are shuffled.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where((F.col("n") > most) & (F.col("n") * most > total)).select(F.col(key).alias("_hot"))
    found = hot.collect()
    single = rows.withColumn("times", F.lit(1).cast("long"))
    if not found:
        return single
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    added = rows.join(hot, same, "left_semi").groupBy(row_key(key, value).alias("_row")).agg(
        F.first(key).alias(key), F.first(value).alias(value), F.count(F.lit(1)).alias("times")
    )
    return single.join(hot, same, "left_anti").unionByName(added.drop("_row"))


def row_key(*columns: str) -> Column:
    """128 bits as text, never null, of columns that may be: one key for windows and joins alike, so that
    rows are shuffled once for both. Nulls differ from empty strings."""
    flags = F.concat(*[F.col(x).isNull().cast("string") for x in columns])
    return F.coalesce(F.md5(F.concat_ws("\u0001", flags, *[F.col(x).cast("string") for x in columns]).cast("binary")), F.lit(""))


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def arrow_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, null as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def table(separators: str | None = None, kept: bytes | None = None) -> np.ndarray:
    """For each byte, whether it belongs to a word: all but separators, or kept and all non-ASCII."""
    if kept is None:
        out = np.ones(256, bool)
        out[list(separators.encode())] = False
        return out
    out = np.zeros(256, bool)
    out[list(kept)] = True
    out[128:] = True
    return out


#: [^\x20\x09-\x0D]+
BLANKS = table(" \t\n\x0b\x0c\r")
#: Runs of ASCII letters, digits and non-ASCII characters, case kept.
ALNUM = table(kept=b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def word_spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the n + 1 offsets of each row's words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    word = inside[data]
    edges = at[(at > 0) & (at < len(data))]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[edges] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, .. n - 1 modulo 2 ** 64; kept and grown by doubling up to 32 MB."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, _U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others (splitmix64's)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _letters(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A random number a byte, and the same with A-Z as a-z."""
    letters = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=_U) | _U(1 << 63)
    lower = letters.copy()
    lower[ord("A") : ord("Z") + 1] = letters[ord("a") : ord("z") + 1]
    return letters, lower


#: Independent families of word hashes: the numbers of the bytes, and the base.
_FAMILIES = ((*_letters(_SEED), _BASE), (*_letters(_SEED + 1), _U(0xC13FA9A902A6328F)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, family: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, all at once from one prefix sum."""
    if not len(starts):
        return np.empty(0, _U)
    exact, folded, base = _FAMILIES[family]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((folded if lower else exact)[data] * powers(base, len(data)), out=sums[1:], dtype=_U)
        out = (sums[ends] - sums[starts]) * powers(inverse(base), len(data))[starts]
        return mix(out + (ends - starts).astype(_U))


def pieces(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most about `limit` bytes, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hashed_words(
    data: np.ndarray, at: np.ndarray, inside: np.ndarray, lower: bool = False, limit: int = 1 << 21, family: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes of all words and each row's word offsets, in pieces of bounded memory."""
    parts, first = [], [np.zeros(1, np.int64)]
    count = 0
    for i, j in pieces(at, limit):
        lo, hi = at[i], at[j]
        s, e, f = word_spans(data[lo:hi], at[i : j + 1] - lo, inside)
        parts.append((s + lo, e + lo, word_hashes(data[lo:hi], s, e, lower, family)))
        first.append(f[1:] + count)
        count += len(s)
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U), np.zeros(len(at), np.int64)
    return (*(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(first))


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: of sorted numbers the high planes shrink in the shuffle's compression."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
