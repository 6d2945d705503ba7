"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and encoding, each stage written and read again."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import shared_folder
from voxelith.llm.lines import dedup_lines
from voxelith.llm.mixing import mix_documents
from voxelith.llm.nearcopies import drop_near_copies
from voxelith.llm.pieces import encode
from voxelith.llm.quality import keep_quality

PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return keep_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id has too."""
    return dedup_lines(docs).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return drop_near_copies(docs, size=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, both best scores, and where the second best differs."""
    return encode(docs, PIECES_MODEL, changes_only=True).drop("decoded")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mixing),
    ("sentencepiece", encoding),
]
ORACLE_SQL = None  # near-dedup, mixing and the pieces are beyond SQL; tests compare with brute force


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows go to Parquet in the shared folder and are read from there, until the next stage's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
