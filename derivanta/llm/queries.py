"""The queries of this subpackage: one for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, embedding_dedup, license_scan, line_dedup, merkle, minhash, nearest, packing, quality, ranking, repetition, token_files
from .common import Scratch
from .oracles import ORACLES  # noqa: F401

END_OF_TEXT, CAPACITY = 0, 2048


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The host is the document's source, the path its language there."""
    return quality.classify(docs, quality.fit(docs, labels), F.col("source"), F.col("lang"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode_texts(_read(spark, sf_dir, "documents"), path, pattern)
    both = bpe.decode_ids(coded, path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "token-files").path("orc")
    token_files.write_token_ids(_read(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN, end_id=1)
    return token_files.with_crc32(token_files.read_token_ids(spark, out))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, END_OF_TEXT, CAPACITY)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.embedding_links(_read(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.sql("select -1L conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").withColumn("text", F.lit(chat_format.FORGED))
    chats = chat_format.format_chats(rows.unionByName(forged))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampered copy of a text has A-Z lower-cased, where 5 divides the crc32 of the decimal doc_id."""
    docs = _read(spark, sf_dir, "documents")
    leaf_of = lambda text: merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_of(F.col("text")).alias("leaf"), F.when(hit, leaf_of(lowered)).alias("tampered"))
    made = merkle.manifest(leaves, "source", ["doc_id"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("siblings"))
    out = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("siblings")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = repetition.repetition_rules(_read(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)
    return found.withColumnRenamed("query_id", "item_id")


QUERIES = {
    "op12_ranking": op12_ranking,
    "op11_repetition": op11_repetition,
    "op13_merkle": op13_merkle,
    "op1_quality": op1_quality,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op7_nearest": op7_nearest,
    "op10_chat_format": op10_chat_format,
    "op2_bpe": op2_bpe,
    "op5_token_files": op5_token_files,
    "op6_line_dedup": op6_line_dedup,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
}
