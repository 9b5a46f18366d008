"""Row numbers, running totals and rolling frames over keys that may be very large.

A job's rows are cut into buckets of an order-preserving column (hours of a time, ranges of a sequence). Buckets are windows of
their own; what lies before a bucket comes from the totals of its job's buckets, a small table. So a job with most of the rows
is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.jobs.workdir import work_path

ORDER = ("ts", "seq", "attempt")


def by_hour(ts: str = "ts") -> Column:
    return F.date_trunc("hour", ts)


def running_totals(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the total of its column over the key's rows up to this one. bucket must not decrease
    along order; null keys are equal."""
    x = df.withColumn("_b", bucket)
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_s_{n}": c for n, c in sums.items()})
    totals = x.groupBy(*keys, "_b").agg(*(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    at = {k: f"_k{i}" for i, k in enumerate([*keys, "_b"])}
    totals = totals.select(*(F.col(k).alias(a) for k, a in at.items()), *(F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_p_{n}") for n in sums))
    met = reduce(and_, (F.col(k).eqNullSafe(F.col(a)) for k, a in at.items()))
    x = x.select("*", *(F.sum(f"_s_{n}").over(within).alias(f"_w_{n}") for n in sums)).join(totals, met)
    return x.select(*df.columns, *((F.coalesce(F.col(f"_w_{n}"), F.lit(0)) + F.col(f"_p_{n}")).alias(n) for n in sums))


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], name: str = "n") -> DataFrame:
    """df with the row number within the key, from 1."""
    return running_totals(df, keys, bucket, order, {name: F.lit(1).cast("long")})


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, and for each name in shares the exact percentile of value, interpolated between neighbours, nulls left out.

    No group is held by a task: values are counted, sorted by range and written; running totals of the counts tell which values
    hold the two ranks that a percentile lies between. What is gathered for a group is these values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    path = work_path(df.sparkSession, "values")
    counts.orderBy(*keys, value).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    placed = df.sparkSession.read.schema(T.StructType([*counts.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)
    upto = running_totals(placed, keys, F.col("_part"), [value], {"_upto": F.col("_c")})
    names = {k: f"_q{i}" for i, k in enumerate(keys)}
    total = placed.groupBy(*keys).agg(F.sum("_c").alias("_n")).select("_n", *(F.col(k).alias(n) for k, n in names.items()))
    met = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    ranked = upto.join(total, met).drop(*names.values())
    at = {name: F.lit(p) * (F.col("_n") - 1) for name, p in shares.items()}
    holds = lambda i: F.max(F.when((F.col("_upto") - F.col("_c") <= i) & (i < F.col("_upto")), F.col(value)))
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *(x for name, a in at.items() for x in (holds(F.floor(a)).alias(f"_lo_{name}"), holds(F.ceil(a)).alias(f"_hi_{name}"))))

    def between(name: str) -> Column:
        lo, hi, a = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), at[name]
        return F.when(lo == hi, lo).otherwise((F.ceil(a) - a) * lo + (a - F.floor(a)) * hi).alias(name)

    return found.select(*keys, *map(between, shares))


def rolling(df: DataFrame, keys: Sequence[str], n: str, size: int, aggs: dict[str, Column], chunk: int = 100_000) -> DataFrame:
    """df with aggregates over the last `size` rows by the row number n. Rows are cut into chunks of numbers; a chunk's last
    size - 1 rows are repeated in front of the next one."""
    own = F.floor((F.col(n) - 1) / chunk)
    at = (F.col(n) - 1) % chunk
    homes = F.when(at >= chunk - (size - 1), F.array(own, own + 1)).otherwise(F.array(own))
    x = df.withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    w = Window.partitionBy(*keys, "_chunk").orderBy(n).rowsBetween(-(size - 1), 0)
    x = x.select("*", *(a.over(w).alias(k) for k, a in aggs.items()))
    return x.where(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk")
