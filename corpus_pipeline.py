"""The corpus pipeline: documents in; good, different, clean ones out, encoded into pieces.

Five stages, each given all rows that the one before it kept: quality (bad documents go),
near-duplicates (the least doc_id of each class stays), repeated passages (cut from the
texts), benchmark leaks (documents that hold a test item go), and piece encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uvsieve.llm.common import read_table, written
from uvsieve.llm.decontaminate import drop_leaked
from uvsieve.llm.minhash import near_duplicates
from uvsieve.llm.pieces import encode_pieces
from uvsieve.llm.quality import keep_good
from uvsieve.llm.queries import tokenizer_path
from uvsieve.llm.repeats import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    return keep_good(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least doc_id.

    Rows without doc_id take part, behind all others (in order of a hash). Rows that repeat doc_id and text are one document, of which one row stays;
    other texts of a doc_id stay or go with it."""
    behind = F.lit(2**62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), behind)).withColumn("_mark", F.hash("text"))
    classes = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), likeness=0.8)
    stay = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_key"))
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key", "_mark"]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier."""
    return cut_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaked(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces under merge-dropout."""
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"), rate=0.1, seed=17, carry=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("repeated_passages", repeated_passages), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL can express none of the stages; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written out and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
