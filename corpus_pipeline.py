"""The corpus pipeline: five stages, each over all that its predecessor kept, written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns of `documents`; the last returns each
document's token ids, their number and the text they decode to. Ids may be null or repeated: no stage joins on them. A null
text comes out of the suffix-array stage as an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incunable.llm.bpe import bpe
from incunable.llm.common import materialize, shared_dir
from incunable.llm.decontaminate import contamination
from incunable.llm.quality import THRESHOLD, quality
from incunable.llm.simhash import near_duplicates
from incunable.llm.suffix import dedup_bytes
from incunable.llm.toxicity import held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a row number that outlives joins: ids may be null or repeated."""
    return materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 4, 2))
    return quality(docs, labels, carry=COLUMNS).where(F.col("score") >= THRESHOLD).select("carry.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays (the first row, where ids repeat or are null)."""
    rows = _numbered(docs)
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("m")
    kept = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(least).select("m.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters covered by long strings of bytes that also start elsewhere go, whole ones only; n_chars follows the text of documents that lose any."""
    out = dedup_bytes(docs, carry=("doc_id", "lang", "source", "n_chars"), characters=True)
    less = F.col("n_removed") > 0
    return out.select("carry.doc_id", F.col("kept").alias("text"), "carry.lang", "carry.source", F.when(less, F.length("kept").cast("long")).otherwise(F.col("carry.n_chars")).alias("n_chars"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return found.where("not contaminated").select("carry.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (32-bit, little-endian), their number, the text that they decode to, and its other columns."""
    out = bpe(docs, carry=("lang", "source", "n_chars"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"), "carry.*")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("byte-level BPE", encode_stage),
]

#: SQL can express neither the classifier nor the fingerprints; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
