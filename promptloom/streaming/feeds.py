"""Structured Streaming: intake, scoring and telemetry of unbounded feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.schemas import ERROR_CLASSES
from promptloom.sources.prompts import check_lines, split_rows


def run_available(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is there and return what it wrote. Batches are written under their number, so one that is repeated
    after a failure replaces itself; in complete and update mode a reader takes a key's last batch."""

    def write(batch: DataFrame, number: int) -> None:
        (each or (lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")))(batch, number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{path}/out").parquet(f"{path}/out")


def stream_prompts(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """JSON lines of a growing folder -> split_rows with file (a hash of its path); seq is the line's number in its file, and rows
    without an id are named by both, so that equal lines have different ids, the same ones when a batch is repeated. A file is
    one task's, and at most 2 GB."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    lines = files.select(F.hex(F.xxhash64(F.col("_metadata.file_path"))).alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r", -1)).alias("at", "line"))
    return split_rows(check_lines(lines.select("file", F.col("at").cast("long").alias("seq"), "line")), F.concat_ws("-", "file", "seq"))


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_score(prompts: DataFrame, score: Callable[[DataFrame, str], DataFrame], path: str) -> DataFrame:
    """Score each micro-batch; a repeated batch finds its written attempts and calls nobody again."""

    def each(batch: DataFrame, number: int) -> None:
        score(batch, f"{path}/score/batch={number}").write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = prompts.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return prompts.sparkSession.read.parquet(f"{path}/out")


def stream_status(results: DataFrame) -> DataFrame:
    """job_id, succeeded, failed, input_tokens, output_tokens, errors (class -> how many) so far; the state is a row a job, as classes
    are a fixed list (what is not in it counts as other). In update mode a batch gives the jobs that it changed: last_rows tells
    how all stand."""
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    kind = F.when(~ok, F.when(F.col("failure_class").isin(*ERROR_CLASSES), F.col("failure_class")).otherwise("other"))
    classes = (*ERROR_CLASSES, "other")
    sums = [F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    per = results.groupBy("job_id").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), *sums, *(F.count_if(kind == c).alias(f"_{c}") for c in classes))
    errors = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*(F.col(f"_{c}") for c in classes))), lambda _, n: n > 0)
    return per.select("job_id", "succeeded", "failed", "input_tokens", "output_tokens", errors.alias("errors"))


def last_rows(written: DataFrame, *keys: str) -> DataFrame:
    """What run_available wrote in update mode: each key's row of the last batch that has it. Null keys are equal."""
    rest = [c for c in written.columns if c not in keys and c != "batch"]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def stream_quota_usage(attempts: DataFrame, late: str = "10 minutes", size: str = "60 seconds", slide: str | None = None) -> DataFrame:
    """job_id, minute, requests, throttled by event time; rows later than `late` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    per = attempts.withWatermark("ts", late).groupBy("job_id", w.alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("http_status") == 429).alias("throttled"))
    return per.select("job_id", F.col("w.start").alias("minute"), "requests", "throttled")


def stream_dedupe(results: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each item; ids are kept for `late`."""
    return results.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "item_id"])

