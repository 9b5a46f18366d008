"""Token-id files: rANS blocks in ascending document order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm import rans
from promptloom.llm.common import drop_path, new_path, shuffle_partitions
from promptloom.llm.tokens import token_ids

TOKENS = "part int, at long, doc_id long, ids binary"
BLOCKS = "first long, doc_ids array<long>, doc_starts array<long>, lengths array<int>, n_ids int, payload binary"
#: Blocks that are coded side by side.
TOGETHER = 16


def _narrow(tokenizer: str, end_id: int) -> bool:
    """Whether ids are kept in 16 bits between the stages."""
    return max(token_ids(tokenizer).largest, end_id) < 1 << 16


def _tokenize(tokenizer: str, end_id: int, narrow: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batched, part, at, kind = token_ids(tokenizer).batches, TaskContext.get().partitionId(), 0, "<u2" if narrow else "<u4"
        end = np.array([end_id], kind).tobytes()
        for b in batches:
            first = 0
            for flat, offsets in batched(b.column("text").to_pylist()):
                data, width, n = flat.astype(kind).tobytes(), int(kind[-1]), len(offsets) - 1
                cut = (offsets * width).tolist()
                ids = [data[x:y] + end for x, y in zip(cut[:-1], cut[1:], strict=True)]
                starts = at + offsets[:-1] + np.arange(n)
                at += int(offsets[-1]) + n
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(starts.astype(np.int64)), b.column("doc_id").slice(first, n), pa.array(ids, pa.binary())], ["part", "at", "doc_id", "ids"])
                first += n

    return run


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return run


def _encode(model_ids: bytes, shares: bytes, scale_bits: int, offsets: dict[int, int], kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rans.Model(np.frombuffer(model_ids, np.uint32), np.frombuffer(shares, np.uint32), scale_bits)
        held: list[tuple[int, list, np.ndarray]] = []
        docs: list[tuple] = []  # pieces of the open block: doc_id, start of the document, length, ids
        first = size = 0

        def close() -> None:
            nonlocal docs, size
            if docs:
                held.append((first, [d[:3] for d in docs], np.concatenate([d[3] for d in docs])))
            docs, size = [], 0

        def flush() -> pa.RecordBatch:
            payloads = model.encode([h[2] for h in held])
            cols = [
                pa.array([h[0] for h in held], pa.int64()),
                pa.array([[d[0] for d in h[1]] for h in held], pa.list_(pa.int64())),
                pa.array([[d[1] for d in h[1]] for h in held], pa.list_(pa.int64())),
                pa.array([[d[2] for d in h[1]] for h in held], pa.list_(pa.int32())),
                pa.array([len(h[2]) for h in held], pa.int32()),
                pa.array(payloads, pa.binary()),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["first", "doc_ids", "doc_starts", "lengths", "n_ids", "payload"])

        for b in batches:
            for part, at, doc, raw in zip(*(b.column(c).to_pylist() for c in ("part", "at", "doc_id", "ids")), strict=True):
                start, ids = offsets[part] + at, np.frombuffer(raw, kind)
                if docs and first + size != start:
                    close()
                done = 0
                while done < len(ids):
                    if not docs:
                        first = start + done
                    take = ids[done : done + rans.BLOCK - size]
                    docs.append((doc, start, len(take), take))
                    size += len(take)
                    done += len(take)
                    if size == rans.BLOCK:
                        close()
                        if len(held) >= TOGETHER:
                            yield flush()
        close()
        if held:
            yield flush()

    return run


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", scale_bits: int = rans.SCALE_BITS) -> None:
    """Write the ids of all documents, each followed by end_id, in ascending document order to the folder `path`:

    - table/: id, share of 2**scale_bits (the frequency table that all blocks share)
    - blocks/: first (ids before the block), doc_ids, doc_starts and lengths of the pieces of documents in it, n_ids, payload

    Texts are dealt by range of (doc_id, hash of the text), tokenized once and kept as a table until the blocks are written.
    Counts of ids and sizes of parts (as many as shuffle partitions) are all that the driver sees. Null texts are empty, null ids
    come first, repeated rows follow each other; an empty table gives an empty table/ and blocks/.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    ordered = keyed.repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kept = new_path(spark, "ids")
    narrow = _narrow(tokenizer, end_id)
    kind, width = ("<u2", 2) if narrow else ("<u4", 4)
    ordered.mapInArrow(_tokenize(tokenizer, end_id, narrow), TOKENS).write.option("compression", "zstd").parquet(kept)
    tokens = spark.read.schema(TOKENS).parquet(kept)

    counts = tokens.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ids, shares = rans.frequencies(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), scale_bits)
    spark.createDataFrame(pd.DataFrame({"id": ids.astype(np.int64), "share": shares.astype(np.int64)}), "id long, share long").coalesce(1).write.parquet(f"{path}/table")

    sizes = tokens.groupBy("part").agg(F.max(F.col("at") + F.octet_length("ids") / width).cast("long").alias("n")).orderBy("part").collect()
    offsets = dict(zip([r["part"] for r in sizes], np.cumsum([0, *(r["n"] for r in sizes)]).tolist(), strict=False))
    tokens.mapInArrow(_encode(ids.tobytes(), shares.tobytes(), scale_bits, offsets, kind), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_path(spark, kept)


def _decode(model_ids: bytes, shares: bytes, scale_bits: int, checks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rans.Model(np.frombuffer(model_ids, np.uint32), np.frombuffer(shares, np.uint32), scale_bits)
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                c = b.slice(at, TOGETHER)
                doc, start, piece, raw = [], [], [], []
                for first, ids, docs, starts, lengths in zip(c.column("first").to_pylist(), model.decode(c.column("payload").to_pylist()), *(c.column(k).to_pylist() for k in ("doc_ids", "doc_starts", "lengths")), strict=True):
                    cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
                    data = ids.astype("<u4").tobytes()
                    doc += docs
                    start += starts
                    piece += [first + x for x in cuts[:-1]]
                    raw += [data[4 * i : 4 * j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(piece, pa.int64())]
                if checks:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())], ["doc_id", "start", "piece_start", "n", "crc"])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(raw, pa.binary())], ["doc_id", "start", "piece_start", "ids"])

    return run


def read_token_file(spark: SparkSession, path: str, scale_bits: int = rans.SCALE_BITS, checks: bool = False) -> DataFrame:
    """The pieces of documents in the blocks: doc_id, start (of the document), piece_start and ids (little-endian unsigned
    32-bit) or, with checks, their number n and CRC-32 crc. Every block is decoded on its own; a damaged one raises ValueError."""
    table = spark.read.schema("id long, share long").parquet(f"{path}/table").orderBy("id").toPandas()
    model = (table["id"].to_numpy(np.uint32).tobytes(), table["share"].to_numpy(np.uint32).tobytes())
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_decode(*model, scale_bits, checks), "doc_id long, start long, piece_start long, " + ("n long, crc long" if checks else "ids binary"))


@F.pandas_udf(T.LongType())
def joined_crc(parts: pd.Series) -> pd.Series:
    """The CRC-32 of what arrays of (at, bytes, crc) make up in the order of at."""

    def one(rows) -> int:
        first, *more = sorted(rows, key=lambda r: r["at"])
        crc = first["crc"]
        for r in more:
            crc = rans.crc32_joined(crc, r["crc"], r["bytes"])
        return crc

    return parts.map(one)


def document_checks(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in read_token_file's result with checks. The checksums of a document's
    pieces are joined, not its ids; a document is known by its start, as repeated doc_ids are different documents."""
    docs = pieces.groupBy("start").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct(F.col("piece_start").alias("at"), (4 * F.col("n")).alias("bytes"), "crc")).alias("parts"))
    return docs.select("doc_id", "start", "n_tokens", joined_crc("parts").alias("ids_crc32"))
