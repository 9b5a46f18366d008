"""Result logs and job records: writing, reading back, export."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.jobs.workdir import work_path
from promptloom.schemas import RESULTS
from promptloom.sources.slices import slices

#: The folder of a log whose files are named after the runs that are whole.
COMMITS = "_commits"
SUCCESS_KEYS = ("item_id", "status", "response_text", "input_tokens", "output_tokens", "latency_s", "attempt")
ERROR_KEYS = ("item_id", "status", "failure_class", "message", "attempt", "http_status")


def result_line() -> Column:
    """One of the two JSON shapes of a result; an error keeps a null http_status."""
    good = F.to_json(F.struct(*SUCCESS_KEYS))
    bad = F.to_json(F.struct(*ERROR_KEYS), {"ignoreNullFields": "false"})
    return F.when(F.col("status") == "success", good).otherwise(bad)


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_results(results: DataFrame, path: str, run: str | None = None) -> None:
    """Append JSON lines, a folder for each run and job, and then the run's name to the log's commits, which readers obey. A run that
    is in there is not written again; one that broke off is, and until then none of its rows is seen. So a driver that is started
    anew with the same name doubles and loses nothing. Without a name every call is a run of its own.

    Rows are rebalanced by job: those of a small job are together, in one file; a job with more than a task's share of bytes is
    split."""
    run = run or uuid.uuid4().hex
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"a run's name has letters, digits, points and dashes only, unlike {run!r}")
    spark = results.sparkSession
    fs, place = _fs(spark, path)
    commit = place(f"{path}/{COMMITS}/{run}")
    if fs.exists(commit):
        return
    results.select("job_id", result_line().alias("value")).hint("rebalance", "job_id").write.mode("overwrite").partitionBy("job_id").text(f"{path}/run={run}")
    fs.create(commit, True).close()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """RESULTS without seq of the committed runs of write_results; an empty table where there are none."""
    fs, place = _fs(spark, path)
    commits = place(f"{path}/{COMMITS}")
    runs = sorted(f.getPath().getName() for f in fs.listStatus(commits)) if fs.exists(commits) else []
    filled = lambda folder: any(f.getPath().getName().startswith("job_id=") for f in fs.listStatus(place(folder)))
    folders = [f for f in (f"{path}/run={r}" for r in runs) if fs.exists(place(f)) and filled(f)]
    if not folders:
        return spark.createDataFrame([], RESULTS).drop("seq")
    lines = spark.read.schema("value string, job_id string").option("basePath", path).text(folders).select("job_id", F.col("value").alias("line"), F.monotonically_increasing_id().alias("seq"))
    parsed = F.from_json("line", T._parse_datatype_string(RESULTS))
    # Spark's parser takes some torn lines for whole; those that end like an object and parse are decided here, map-only
    whole = lines.select("job_id", "line").mapInArrow(_whole_objects, "job_id string, line string")
    return whole.select("job_id", parsed.alias("r")).select("job_id", *(f"r.{c.split()[0]}" for c in RESULTS.split(", ")[2:]))


def _whole_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def whole(x: str) -> bool:
        try:
            return isinstance(json.loads(x), dict)
        except ValueError:
            return False

    for c in slices(batches, "line"):
        yield c.filter(pa.array([whole(x) for x in c.column("line").to_pylist()], pa.bool_()))


def export_results(results: DataFrame, reports: DataFrame, include: str = "all", partial: bool = False) -> DataFrame:
    """The results of finished jobs (with partial, of all): all, success or errors. write_export puts them into files."""
    keep = {"all": F.lit(True), "success": F.col("status") == "success", "errors": F.col("status") != "success"}[include]
    jobs = reports.select("job_id", F.col("status").alias("_state")) if partial else reports.where(~F.col("status").isin("queued", "running")).select("job_id")
    return results.where(keep).join(jobs.select("job_id"), "job_id", "left_semi")


def array_lines(results: DataFrame, order: tuple[str, ...] = ("job_id", "seq")) -> DataFrame:
    """at, value: lines of one JSON array, in the order of at. Rows are sorted by range and written once, numbered; the first and
    the last one of these get the brackets, so nothing is gathered. No results are an empty array."""
    spark, path = results.sparkSession, work_path(results.sparkSession, "sorted")
    results.select(*order, result_line().alias("j")).orderBy(*order).select(F.monotonically_increasing_id().alias("at"), "j").write.parquet(path)
    placed = spark.read.schema("at long, j string").parquet(path)
    low, high = placed.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return spark.createDataFrame([(0, "[]")], "at long, value string")
    return placed.select("at", F.concat(F.when(F.col("at") == low, "[").otherwise(","), "j", F.when(F.col("at") == high, "]").otherwise("")).alias("value"))


def write_export(results: DataFrame, path: str, fmt: str = "ndjson") -> None:
    """Results as text files in the order of (job_id, seq): ndjson, a line each, or array, whose files put together in the order of
    their names are one JSON array."""
    if fmt == "ndjson":
        lines = results.select("job_id", "seq", result_line().alias("value")).orderBy("job_id", "seq")
    elif fmt == "array":
        lines = array_lines(results).orderBy("at")
    else:
        raise ValueError(f"fmt is ndjson or array, not {fmt}")
    lines.select("value").write.text(path)


def upsert_reports(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """One record a job, the newest (updates before existing at the same time)."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("job_id").orderBy(F.desc("updated_at"), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def to_record(reports: DataFrame) -> DataFrame:
    """job_id, data: a record as one JSON string, nulls and maps included."""
    return reports.select("job_id", F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("data"))


def from_record(records: DataFrame, schema: str | T.StructType) -> DataFrame:
    return records.select(F.from_json("data", schema).alias("r")).select("r.*")
