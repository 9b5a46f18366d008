"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import path_exists, write_table
from promptloom.llm.tokens import token_ids, version_digest

#: Up to so many missing digests (of 32 bytes) are sent to all executors; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = token_ids(path).ids
        for b in batches:
            n = [len(ids(t.as_py())) // 4 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs; the counts are those of the tokenizers library for the file `tokenizer`,
    without begin, end or added special tokens, truncation or padding.

    cache_dir holds (digest, n_tokens) under the digest of the tokenizer's version. Texts are joined to it by the SHA-256 of the
    content as the tokenizer sees it (these tokenizers read the text unchanged, null as empty); each distinct text that it
    lacks is encoded once and appended. A text's copies meet as map-side aggregates, so a text with a third of all rows is as
    cheap as any other. When few digests are missing, they filter the scan; else texts are shuffled once, distinct.

    Null texts count as empty (0 bytes, 0 tokens); an empty table gives no rows; repeated rows and null ids are kept as they
    are; other columns are ignored. A rerun after a failure may append a digest again; readers take one of the equal rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    cache_path = f"{cache_dir.rstrip('/')}/{version_digest(tokenizer)}"
    schema = "digest binary, n_tokens long"
    wanted = keyed
    known = None
    if path_exists(spark, cache_path):
        known = spark.read.schema(schema).parquet(cache_path)
        missing = write_table(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
        if missing.count() <= BROADCAST_DIGESTS:
            wanted, known = keyed.join(F.broadcast(missing), "digest", "left_semi"), None
    once = wanted.groupBy("digest").agg(F.any_value("text").alias("text"))
    if known is not None:
        once = once.join(known, "digest", "left_anti")
    once.select("digest", "text").mapInArrow(_count(tokenizer), schema).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(schema).parquet(cache_path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    narrow = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return narrow.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
