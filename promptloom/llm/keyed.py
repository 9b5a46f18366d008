"""Documents with a unique key, and entries of (hash, key) packed into byte planes."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.llm.common import write_table


#: Ids that are null or repeated: up to so many are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_ROOM = 1 << 62


def with_key(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with a unique `key` (long) in the order of ids. It is the id, where ids are unique. Where some are null or repeated, it is
    the id times the most often repeated one's count, plus a rank among the rows with the same id (in a fixed order); rows without
    an id come last. Only rows with repeated or null ids are sorted, and written once, so that every stage sees the same keys. Where
    such keys need over 62 bits, all rows are numbered in the order of ids. rows have no column `key` of their own."""
    own = F.col(id_col).cast("long")
    ids = rows.select(own.alias("_id"))
    odd = ids.groupBy("_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("_id").isNull())
    if odd.isEmpty():
        return rows.withColumn("key", own)
    odd = write_table(odd, "odd-ids")
    low, top = ids.agg(F.min("_id"), F.max("_id")).first()
    times = odd.where("_id is not null").agg(F.max("n")).first()[0] or 1
    order = (own.asc_nulls_last(), F.xxhash64(*rows.columns))
    if max(abs(low or 0), abs(top or 0)) + 2 >= _ROOM // times:
        return write_table(rows.orderBy(*order).withColumn("key", F.monotonically_increasing_id()), "keyed")
    named = odd.where("_id is not null").select("_id")
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    plain = rows.where(own.isNotNull()).join(named, own == F.col("_id"), "left_anti").withColumn("key", own * times)
    rest = rows.where(own.isNull()).unionByName(rows.join(named, own == F.col("_id"), "left_semi"))
    rest = write_table(rest.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "keyed")
    # an _at is a part and a position in it: with the sizes of the parts before, positions have no gaps, and neither have ranks
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rest.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    rest = rest.join(F.broadcast(sizes), part == F.col("_part")).withColumn("_at", place + F.col("_before")).drop("_part", "_before")
    first = rest.groupBy(own.alias("_id")).agg(F.min("_at").alias("_first"))
    first = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
    rest = rest.join(first, own.eqNullSafe(F.col("_id")))
    key = F.coalesce(own, F.lit((top if top is not None else -1) + 1).cast("long")) * times + F.col("_at") - F.col("_first")
    return plain.unionByName(rest.withColumn("key", key).drop("_id", "_first", "_at"))


def keyed_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (with_key), doc_id, text (null as empty)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_key(rows).select("key", "doc_id", "text")


def bucket_bits(spark: SparkSession, per_partition: int = 4) -> int:
    """Bits of the number of hash buckets: a few for each shuffle partition."""
    return min(20, max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition - 1).bit_length()))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no live table needs."""
    gc.collect()
    spark._jvm.System.gc()


def to_planes(values: np.ndarray, width: int | None = None) -> bytes:
    """64-bit integers as byte planes, lowest first; planes of zeros compress to nothing."""
    v = np.ascontiguousarray(values).astype("<u8", copy=False)
    if width is None:
        width = max(1, -(-int(v.max()).bit_length() // 8)) if len(v) else 1
    return bytes([width]) + v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def to_steps(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit integers as the byte planes of their steps."""
    return to_planes(np.diff(ascending, prepend=ascending.dtype.type(0)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def segments(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """First and past-the-last position of each run of equal values."""
    starts = runs(sorted_values).tolist()
    return list(zip(starts, [*starts[1:], len(sorted_values)][: len(starts)], strict=True))


def in_larger_runs(sorted_values: np.ndarray) -> np.ndarray:
    """Whether the value has an equal neighbour."""
    same = sorted_values[1:] == sorted_values[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(sorted_values) else np.zeros(0, bool)
