"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by digest, one row per distinct text ever seen. A batch is reduced to one row
per digest before any join, so no group of copies meets in one task; the digests go through a sort-merge anti-join
with the index, and what is new is appended in the index's own bucketing.

Defined cases: a null text equals an empty one, and texts of white space only equal both. Of equal texts the row with
the most code points stays, then the smallest doc_id (null last). Rows repeated with the staying id and length are all
marked kept. An empty table gives no rows and leaves the index as it is. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, fresh, staged, text_or_empty
from .store import DigestStore


def normalised(column: str = "text") -> Column:
    return F.translate(text_or_empty(column), SPACE, "")


class DigestIndex(DigestStore):
    """A digest table at `path`; opening the same path again, in any session and with any partition setting, goes on with what it holds. Another
    number of buckets or another id type than it was made with is an error."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        super().__init__(spark, path, f"keep_id {id_type}, n_chars BIGINT", buckets)

    def deduplicate(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """One row per row of docs: id, keep_id, group_size (in this batch), kept, text_sha256. Appends the new digests.

        Where the index already had a text, keep_id is the id that it stored and no row of the batch is kept.
        """
        text = normalised(text_column)
        rows = staged(
            docs.select(
                F.col(id_column).alias("doc_id"),
                F.length(text_or_empty(text_column)).cast("long").alias("n_chars"),
                F.unhex(F.sha2(text, 256)).alias("digest"),
            ),
            "digests",
        )
        best = F.min(F.struct((-F.col("n_chars")).alias("order"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
        groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))
        groups = groups.select("digest", "group_size", F.col("best.id").alias("first_id"), (-F.col("best.order")).alias("first_chars"))
        known = self.table().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
        groups = staged(groups.hint("merge").join(known, "digest", "left"), "digest_groups")
        self.append(self.lacking(groups).select("digest", F.col("first_id").alias("keep_id"), F.col("first_chars").alias("n_chars")))
        old = F.coalesce(F.col("old"), F.lit(False))
        return rows.join(groups, "digest").select(
            "doc_id",
            F.when(old, F.col("old_id")).otherwise(F.col("first_id")).alias("keep_id"),
            "group_size",
            (~old & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_chars") == F.col("first_chars"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents against a new index."""
    with DigestIndex(spark, fresh(spark, "digest_index")) as index:
        return index.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM t
"""
