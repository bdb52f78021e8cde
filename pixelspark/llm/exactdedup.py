"""Exact dedup by progressive refinement, in DataFrame functions alone.

The first scan groups rows by length and a hash of their first characters, and keeps the groups of two or more in a
bitmap of fixed size. The second scan hashes a whole text only where that bitmap has its group, so texts that nothing
resembles are never hashed as a whole; the bitmap has no false negatives, and its false positives cost a hash. Texts
themselves are never shuffled, and groups are counted before the shuffle, so a group of any size is one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flagged, staged, table

PREFIX_CHARS = 256

def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical as they are; null counts as empty. Of equal texts the row with the largest id
    stays; null ids rank lowest, and of repeated rows with that id one stays. text_sha256 is null for texts that the
    first two levels have shown to be alone, unless ``digest_all``. An empty table gives an empty result; only the
    two named columns are used.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"n_bytes": F.octet_length("text"), "prefix": F.xxhash64(F.substring("text", 1, prefix_chars))})
    alike = rows.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    group = F.xxhash64("n_bytes", "prefix")
    marked = flagged(rows, alike, group, group, "maybe")
    maybe = F.col("maybe")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    hashed = marked.select("doc_id", "n_bytes", "prefix", "maybe", (digest if digest_all else F.when(maybe, digest)).alias("text_sha256"))
    hashed = staged(hashed.withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    groups = hashed.where("maybe").groupBy("n_bytes", "prefix", "text_sha256").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("keep")).where("n > 1")
    groups = staged(groups, "exact-groups")  # so that both sides of the join are dealt out anew and a large group's rows are split
    return hashed.join(groups, ["n_bytes", "prefix", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row of their text that stays; null texts are empty ones, equal ids and repeated rows as in
    ``exact_groups``."""
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
