"""Operator 7: exact duplicates by a 128-bit content hash, with bytes compared inside groups.

Native DataFrame operations only. Two texts are equal when they are identical after deleting every
character of ``[\\x20\\x09-\\x0D]``; a null text counts as empty. Of equal texts the row with the most
code points in its original text stays, then the smallest id; a null id comes after all others, and
of rows that agree in both, one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, documents, id_text, query, stage


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def row_key(doc_id: Column, text: Column) -> Column:
    """Of id and raw text; beside the content hash it tells the rows of a group apart."""
    return F.xxhash64(doc_id, text)


def _best(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: rows, and the one that stays. Complements turn smallest first into largest.

    Written, so that the join on it stands on two plain exchanges and a hot key can be split.
    """
    return stage(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"),
                       F.bitwise_not("row").alias("row"))).alias("best")), "groups")


def _decided(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group. A hot group is one row on the right; AQE splits the left."""
    return rows.join(groups, keys).select(
        "doc_id", "points", "hash", "sha", "key", F.bitwise_not("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.bitwise_not("best.row")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row per row of ``docs``: doc_id, points, hash, sha (binary), key, keep_id, group_size, kept.

    Facts of a few bytes per row are written once and grouped by hash. The texts themselves are
    aggregated by (hash, text), which compares whole texts and reduces copies before the shuffle; a
    hash that turns out to stand for several texts is grouped by the text instead.
    """
    texts = id_text(docs, id_col, text_col).select(
        "doc_id", F.char_length("text").alias("points"), normalised(F.col("text")).alias("norm"),
        row_key(F.col("doc_id"), F.col("text")).alias("key"))
    hashed = texts.withColumn("hash", content_hash(F.col("norm")))
    facts = stage(hashed.select(
        "doc_id", "points", "hash", "key", F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.monotonically_increasing_id().alias("row")), "facts")
    collided = stage(
        hashed.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("hash"),
        "collided")
    if collided.isEmpty():
        return _decided(facts, _best(facts, "hash"), ["hash"])
    sound = facts.join(collided, "hash", "left_anti")
    mixed = stage(hashed.join(collided, "hash").select(
        "doc_id", "points", "hash", "norm", "key", F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.monotonically_increasing_id().alias("row")), "mixed")
    return _decided(sound, _best(sound, "hash"), ["hash"]).unionByName(
        _decided(mixed, _best(mixed, "hash", "norm"), ["hash", "norm"]))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that are equal in id and text are one row here: one of them is kept, whichever its other columns.
    """
    stay = stage(exact_dedup(docs).filter("kept").select("hash", "key"), "stay")
    text = F.coalesce(docs["text"], F.lit(""))
    key = row_key(docs["doc_id"].cast("long"), text)
    out = docs.join(stay, (md5_bytes(normalised(text)) == stay["hash"]) & (key == stay["key"]), "left_semi")
    repeated = docs.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])


@query("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
 first_value(doc_id) OVER w AS keep_id,
 count(*) OVER (PARTITION BY norm) AS group_size,
 row_number() OVER w = 1 AS kept,
 sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)""")
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
