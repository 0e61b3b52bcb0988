"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import decontaminate, fingerprints, licenses, lm_score, mixing, pii, sharding, simhash_dedup, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(c.documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = c.documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "offending",
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), F.coalesce("next_prefix", F.lit("")))
    rows = fingerprints.with_next(c.documents(spark, sf_dir)).withColumn("edited", edited)
    rows = fingerprints.with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.to_string(F.col("sketch")).alias("fingerprint"),
        fingerprints.to_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        "next_id",
        fingerprints.distinct_shingles(F.col("sketch")).alias("n_shingles"),
        fingerprints.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_own"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(c.documents(spark, sf_dir))
    first = F.transform("base", lambda x: x["first"])

    def labels(*places):
        every = F.concat(*[F.transform(p, lambda x: x["label"]) for p in places])
        return F.array_join(F.array_sort(F.array_distinct(every)), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "found").alias("labels"),
        "score",
        "found",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(c.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of quality, but those of the held-out fold."""
    docs, labels = c.documents(spark, sf_dir), table(spark, sf_dir, "labels")
    chosen = labels.where((F.col("quality") == 1) & ~toxicity.held_out(F.col("doc_id")))
    return lm_score.score(docs, lm_score.fit(docs, chosen))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.group(c.documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(c.documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_own(c.documents(spark, sf_dir))

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return rows.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = c.pick(c.documents(spark, sf_dir), "doc_id", "text").select(
        "doc_id",
        c.row_key("doc_id", "text").alias("row"),
        sharding.size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.places(rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_decontamination,
            op2_toxicity,
            op3_fingerprints,
            op4_license_scan,
            op5_substring_dedup,
            op6_lm_score,
            op7_simhash_dedup,
            op8_mixing,
            op9_pii,
            op10_sharding,
        )
    }


#: Windows compared as text, marks by position. The other queries have columns that hash, draw or learn in ways that
#: SQL lacks; tests hold the columns that SQL can tell against it.
OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w WHERE len(words) >= 35
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM starts
), repeated AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS at FROM repeated
), places AS (
  SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS at FROM w
), kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.at) AS text
  FROM places p LEFT JOIN covered c ON c.doc_id = p.doc_id AND c.at = p.at WHERE c.at IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL}
