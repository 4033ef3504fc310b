"""A training corpus from raw documents: quality, lines, near copies, benchmark passages, mix.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. run() writes
what each stage returns and reads it again for the next. All stages but the last return the columns that they got.

Defined cases: those of the operators. Null and empty texts are scored like others by the first stage, which drops what it rejects. A
document that loses more than three quarters of its text to earlier documents goes with them; one that had none stays. Rows that share a doc_id
are one document for the third stage; those without one are told apart by their text. Further columns pass through, whatever their names; only
the last stage adds columns, which take the place of ones of their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from strandline.llm.shared import staged, unused

#: Share of its characters that a document must keep when lines that others have are taken out.
LEFT = 0.25


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of 0.3 and more)."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each group of equal or nearly equal lines kept once; n_chars follows the text.

    A document of which less than LEFT of its characters stays is a copy, or made of copies, and goes with them: near copies share most lines with
    their originals, and what differs would stay as a fragment that no later stage can tell from a document."""
    before, rest = unused(docs, "_before", "_rest")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*others).alias(rest), F.length("text").alias(before))
    out = line_dedup.dedup_lines(rows)
    out = out.where((F.col("n_dropped") == 0) | (F.length("text") >= LEFT * F.col(before)) & (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != ""))
    kept = {c: F.col("text") if c == "text" else F.col(f"{rest}.`{c}`") for c in docs.columns}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("n_dropped") == 0, kept["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[x.alias(c) for c, x in kept.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    # rows without an id go by their text, and after all that have one
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))
    name = unused(docs, "_own")[0]
    rows = docs.withColumn(name, own)
    gone = near_dedup.near_duplicates(rows, id_column=name).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return rows.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The columns that the mix adds; ones of these names give way to them.
OWN = ["size", "source_size", "target", "taken", "repeats"]


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix uses, with size, source_size, target, taken and repeats (times that the document is used). Rows are told apart by a key,
    so repeated rows get shares of their own."""
    name, taken = unused(docs, "_row", "_mixed")
    rows = staged(docs.withColumn(name, F.monotonically_increasing_id()), "mix_rows")
    mixed = mixing.mix(rows, key=F.col(name)).where("taken > 0")
    mixed = mixed.select(F.col("key").alias(name), F.struct("size", "source_size", "target", "taken", (F.col("taken") / F.col("size")).cast("long").alias("repeats")).alias(taken))
    return rows.join(mixed, name).select(*[F.col(f"`{c}`") for c in docs.columns if c not in OWN], *[F.col(f"{taken}.{c}").alias(c) for c in OWN])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", fuzzy_lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("mixing", target_mix),
]

#: SQL can't express the classifier, nor the tiling, nor the knapsack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
