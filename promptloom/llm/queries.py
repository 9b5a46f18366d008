"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import oracles
from promptloom.llm.common import new_path, table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run starts with a cache of its own, so that it encodes every distinct text."""
    from promptloom.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.suffix_dedup import suffix_dedup

    found = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.quality import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.sharding import kd_shards

    placed = kd_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as lengths and checksums."""
    from promptloom.llm.pieces import decode, encode
    from promptloom.llm.token_file import joined_crc

    model = public_tokenizers.path("piece_bpe_32k.model")
    parts = decode(encode(table(spark, sf_dir, "documents"), model), model)
    size = lambda c: F.octet_length(c).cast("long")
    cells = {c: F.struct(F.col("part").alias("at"), size(c).alias("bytes"), F.crc32(c).alias("crc")) for c in ("ids", "data")}
    docs = parts.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_parts"), *(F.sum(size(c)).alias(f"n_{c}") for c in cells), *(F.collect_list(x).alias(c) for c, x in cells.items()))
    return docs.select("doc_id", "n_parts", F.expr("n_ids div 4").alias("n_tokens"), joined_crc("ids").alias("ids_crc32"), F.col("n_data").alias("n_bytes"), joined_crc("data").alias("text_crc32"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.token_file import document_checks, read_token_file, write_token_file

    path = new_path(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return document_checks(read_token_file(spark, path, checks=True)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptloom.llm.fingerprints import edited_fingerprints, fingerprint

    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("lanes").alias("fingerprint"),
        fingerprint("edited_lanes").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_top_k": op7_top_k,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_file": op9_token_file,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.NEAR,
    "op4_quality_rules": oracles.QUALITY,
    "op7_top_k": oracles.TOP_K,
    "op8_line_dedup": oracles.LINES,
    "op11_collocations": oracles.COLLOCATIONS,
}
