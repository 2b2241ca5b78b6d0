"""Exact de-duplication with a split for heavy digests.

A frequent-items sketch (a Misra-Gries summary per task, merged; Spark's ``approx_top_k``) proposes digests that may be
frequent. They are counted exactly, and the few that really are (at most ``1 / heavy_share`` by arithmetic) travel as a
broadcast, so that their copies are resolved where they are read. All other digests have few rows each and take an
ordinary shuffle. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candora.llm.shared import stored

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: A digest with at least this share of all rows is heavy, so there are at most 1,000 heavy digests.
HEAVY_SHARE = 1 / 1000
#: Counters of the frequent-items sketch: its error is below rows / 4,000, so no heavy digest escapes it.
TRACKED = 16384


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``_digest`` (SHA-256 of the normalised text, 32 bytes) of every row."""
    return docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("_digest"),
    )


def heavy_digests(rows: DataFrame, share: float = HEAVY_SHARE, tracked: int = TRACKED) -> DataFrame:
    """``_digest``, ``_keep`` and ``_size`` of the digests that hold at least ``share`` of all ``rows``.

    The sketch's candidates are verified by an exact count, which Spark combines before its shuffle.
    """
    limit = max(1, int(1 / share))
    guess = rows.select(F.hex("_digest").alias("_hex")).agg(
        F.expr(f"approx_top_k(_hex, {limit}, {tracked})").alias("_top"), F.count(F.lit(1)).alias("_rows")
    )
    candidates = guess.select(F.explode("_top").alias("_t"), "_rows").select(
        F.unhex("_t.item").alias("_digest"), "_rows"
    )
    counted = rows.join(F.broadcast(candidates), "_digest")  # at most ``limit`` candidates
    counted = counted.groupBy("_digest").agg(
        F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"), F.max("_rows").alias("_rows")
    )
    large = (F.col("_size") >= F.col("_rows") * F.lit(share)) & (F.col("_size") > 1)
    return counted.filter(large).drop("_rows")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``keep_id`` (smallest id with an equal text), ``group_size``, ``text_sha256``.

    Null and empty texts are equal. Ids should be unique; a repeated id is reported as often as it occurs. A row with
    a null id never stays while its group has another one. Columns of ``docs`` beyond the two are ignored.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    heavy = stored(heavy_digests(rows), "heavy")
    marked = rows.join(F.broadcast(heavy), "_digest", "left")
    resolved = marked.filter(F.col("_size").isNotNull())
    rest = rows.join(F.broadcast(heavy), "_digest", "left_anti")
    groups = rest.groupBy("_digest").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    joined = rest.join(groups, "_digest")
    return resolved.select("_id", "_digest", "_keep", "_size").unionByName(
        joined.select("_id", "_digest", "_keep", "_size")
    ).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
