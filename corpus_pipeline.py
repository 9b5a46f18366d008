"""A training corpus from documents: quality rules, line dedup, near duplicates, repeated passages, packing.

Every stage takes and gives the columns of documents, whatever other columns its input has; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm.common import write_table
from promptloom.llm.jaccard import jaccard_groups
from promptloom.llm.keyed import with_key
from promptloom.llm.lines import line_dedup
from promptloom.llm.packing import pack
from promptloom.llm.quality import quality_rules
from promptloom.llm.suffix_dedup import suffix_dedup

WORD = r"[^\x20\x09-\x0D]"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents and a unique key for each row."""
    return with_key(docs.select(*COLUMNS))


def _with_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows that have a new text (key, new), with it and its length."""
    out = rows.select("key", "doc_id", "lang", "source").join(texts, "key")
    return out.select("doc_id", F.col("new").alias("text"), "lang", "source", F.char_length("new").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows with repeated or null ids are judged one by one; null and empty texts go."""
    rows = _rows(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(rows.select("doc_id", "key"), "doc_id").select(F.col("key").alias("doc_id"), "quality")
    kept = quality_rules(rows.select(F.col("key").alias("doc_id"), "text", "lang"), labels).where("kept").select(F.col("doc_id").alias("key"))
    return rows.join(kept, "key", "left_semi").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur; those that lose all their words by it go. Rows with repeated or null ids
    are different documents; null and empty texts stay, empty."""
    rows = _rows(docs)
    out = line_dedup(rows.select(F.col("key").alias("row"), "text"), "row")
    stays = (F.col("n_dropped") == 0) | F.col("text").rlike(WORD)
    return _with_text(rows, out.where(stays).select("key", F.col("text").alias("new")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id. Rows with repeated or null ids are different documents,
    in the order of ids, null ones last; null and empty texts are like nothing and stay."""
    rows = _rows(docs)
    groups = jaccard_groups(rows.select(F.col("key").alias("row"), "text"), id_col="row")
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return rows.join(first, "key", "left_semi").select(*COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; bytes that are no whole character after a cut go with them, and so do
    documents of which nothing is left. Rows with repeated or null ids are different documents, in the order of ids, null ones
    last; null and empty texts stay, empty."""
    rows = _rows(docs)
    out = suffix_dedup(rows.select(F.col("key").alias("row"), "text"), id_col="row")
    kept = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(kept), kept).otherwise(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")))
    out = out.where((F.size("spans") == 0) | (F.octet_length("kept") > 0))
    return _with_text(rows, out.select("key", whole.alias("new")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; null and empty texts are a document of the end id alone; rows with
    repeated or null ids are packed like others."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("packing", packing_stage),
]

#: Tokens and hashes of bytes are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
