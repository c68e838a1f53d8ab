"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytepieces import decode_bytes, encode_bytes, read_ranks, serialise
from .common import read_table
from .conversations import damaged, repair_conversations, summarised
from .decontaminate import leaks
from .digest import fingerprints
from .langid import identify_language
from .lmscore import score_documents
from .minhash import near_duplicates
from .oracle import ORACLE_SQL
from .pages import main_texts
from .pieces import encode_pieces
from .quality import score_quality
from .repeats import remove_repeats
from .tokencount import count_tokens
from .vectorcodes import compress, with_label_error


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), rate=0.1, seed=17)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), likeness=0.8)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), scale=1024, parts=4, entries=256, rounds=4)
    digest = books.digest() if books else hashlib.sha256().hexdigest()
    return with_label_error(coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label")).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return summarised(repair_conversations(damaged(rows), rows.select("conv_id")))


def op13_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = serialise(read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken")))
    encoded = encode_bytes(read_table(spark, sf_dir, "documents", "doc_id", "text"), model, public_tokenizers.PATTERN)
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode_bytes(encoded, model).select("doc_id", "n_tokens", F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_encode_pieces": op1_encode_pieces,
    "op2_fingerprints": op2_fingerprints,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_main_text": op4_main_text,
    "op5_language_id": op5_language_id,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality": op8_quality,
    "op9_lm_scores": op9_lm_scores,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_repaired_conversations": op12_repaired_conversations,
    "op13_byte_pieces": op13_byte_pieces,
}

__all__ = ["QUERIES", "ORACLE_SQL"]
