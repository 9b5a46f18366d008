"""Prompt intake: files and tables to valid prompts and row errors."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.schemas import BAD_ROW
from promptloom.sources.arrays import array_elements
from promptloom.sources.heads import file_heads, readable
from promptloom.sources.slices import slices

CHECKED = "seq long, ok boolean, is_object boolean, has_id boolean, item_id string, prompt string, error string, line string"


def _check(text: str) -> tuple:
    """(parses, is an object, has an id, id as text, prompt if a string, parser's message): what Spark's lenient JSON functions
    can't tell - trailing text, duplicate keys, NaN."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        return False, False, False, None, None, str(e)
    if not isinstance(raw, dict):
        return True, False, False, None, None, None
    prompt = raw.get("prompt")
    return True, True, "id" in raw, str(raw["id"]) if "id" in raw else None, prompt if isinstance(prompt, str) else None, None


def _check_element(text: str) -> tuple:
    """As _check, of an array's element: no line of its own, so that its syntax errors are its file's; numbers keep their digits."""

    def constant(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    try:
        raw = json.loads(text, parse_float=Decimal, parse_constant=constant)
    except ValueError as e:
        raise ValueError(f"syntax error in an array: {e}") from e
    if not isinstance(raw, dict):
        return True, False, False, None, None, None
    prompt = raw.get("prompt")
    return True, True, "id" in raw, str(raw["id"]) if "id" in raw else None, prompt if isinstance(prompt, str) else None, None


def _checked(keep: list[str], check: Callable[[str], tuple] = _check):
    names = [*keep, *(c.split()[0] for c in CHECKED.split(", "))]
    found = {"ok": pa.bool_(), "is_object": pa.bool_(), "has_id": pa.bool_(), "item_id": pa.string(), "prompt": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in slices(batches, "line"):
            lines = c.column("line").to_pylist()
            if check is _check:
                full = [bool(x and x.strip()) for x in lines]
                c, lines = c.filter(pa.array(full, pa.bool_())), [x for x, f in zip(lines, full, strict=True) if f]
            rows = [check(x.strip()) for x in lines]
            cols = {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(found.items())}
            yield pa.RecordBatch.from_arrays([cols[n] if n in cols else c.column(n) for n in names], names)

    return run


def check_lines(lines: DataFrame) -> DataFrame:
    """(seq, line) -> CHECKED after file, if there is one; blank lines left out; vectorized, without a shuffle."""
    keep = [c for c in ("file",) if c in lines.columns]
    return lines.select(*keep, "seq", "line").mapInArrow(_checked(keep), ", ".join([*(f"{c} string" for c in keep), CHECKED]))


def split_rows(checked: DataFrame, place: Column | None = None) -> DataFrame:
    """CHECKED -> item_id, seq, prompt, failure_class, message, attempt (and file): prompts have no failure_class, bad rows no
    prompt. Rows without an id are named by place, which is seq if none is given."""
    place = F.col("seq") if place is None else place
    named = F.when(F.col("has_id"), F.col("item_id")).otherwise(F.concat(F.lit("offset-"), place))
    good = F.col("ok") & F.col("prompt").isNotNull()
    return checked.select(
        *(c for c in ("file",) if c in checked.columns),
        F.when(F.col("ok"), named).otherwise(F.concat(F.lit("line-"), place)).alias("item_id"),
        "seq",
        F.when(good, F.col("prompt")).alias("prompt"),
        F.when(~good, F.lit("invalid_input")).alias("failure_class"),
        F.when(~F.col("ok"), F.concat(F.lit("malformed JSON line: "), F.col("error"))).when(~good, F.lit(BAD_ROW)).alias("message"),
        F.when(~good, F.lit(1)).alias("attempt"),
    )


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, line: every physical line of each file, counted from 0. Lines are counted per split, and the counts of earlier
    splits of the file are added: one more scan, no shuffle of text."""
    parts = spark.read.text(path).select(F.input_file_name().alias("file"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"), F.expr("_metadata.file_block_start").alias("block"))
    sizes = parts.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return parts.join(sizes, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("seq"), "line")


def read_prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files -> split_rows with file; seq counts the lines of each file."""
    return split_rows(check_lines(number_lines(spark, path)))


def read_prompt_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that are one JSON array each, of any size -> split_rows with file; seq is the position in it. A syntax error fails the
    query. Numbers that are ids keep their digits, 1.0 as well as 1e2; of a key that comes twice the last one counts."""
    rows = array_elements(spark, path).select("file", "seq", "line").mapInArrow(_checked(["file"], _check_element), f"file string, {CHECKED}")
    return split_rows(rows)


#: Bytes in which a file's first mark is looked for; those that are white space.
HEAD = 64
_BLANK = "".join(chr(i) for i in range(256) if chr(i).isspace())


def detect_format(spark: SparkSession, path: str) -> DataFrame:
    """file, format: array where the first non-blank byte of the first HEAD is [, else lines. Only these bytes are read, and files are
    listed in tasks; where only Spark's readers know the path's file system, its lines are scanned (_format_of_lines)."""
    if not readable(path):
        return _format_of_lines(spark, path)
    first = F.substring(F.ltrim(F.decode("head", "ISO-8859-1"), F.lit(_BLANK)), 1, 1)
    return file_heads(spark, path, HEAD).select("file", F.when(first == "[", "array").otherwise("lines").alias("format"))


def _format_of_lines(spark: SparkSession, path: str) -> DataFrame:
    """As detect_format, from the beginnings of a file's first lines, HEAD of each at most, in characters. Spark reads no empty files;
    they come from the listing that it makes anyway."""
    text = spark.read.text(path)
    files = spark.createDataFrame([(re.sub("^file:/+", "/", f), re.sub("^file:/+", "/", unquote(f))) for f in text.inputFiles()], "_file string, name string")
    own = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    first = text.select(own.alias("file"), F.expr("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.substring("value", 1, HEAD).alias("line")).where("block = 0")
    begin = first.groupBy("file").agg(F.min("at").alias("begin")).withColumnRenamed("file", "_f")
    first = first.join(begin, F.col("file") == F.col("_f")).where(F.col("at") < F.col("begin") + HEAD)
    lines = first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    head = F.substring(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 1, HEAD)
    kinds = lines.select("file", F.when(F.regexp_replace(head, r"^\s+", "").startswith("["), "array").otherwise("lines").alias("format"))
    return files.join(kinds, F.col("_file") == F.col("file"), "left").select(F.col("name").alias("file"), F.coalesce("format", F.lit("lines")).alias("format"))


def prompts_from_table(df: DataFrame, id_col: str, prompt_col: str, job_col: str, seq_col: str) -> DataFrame:
    """job_id, seq, item_id, prompt, failure_class, message, attempt: prompts that are in a table already."""
    good = F.col(prompt_col).isNotNull()
    return df.select(
        F.col(job_col).alias("job_id"),
        F.col(seq_col).cast("long").alias("seq"),
        F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("offset-"), F.col(seq_col))).alias("item_id"),
        F.col(prompt_col).alias("prompt"),
        F.when(~good, F.lit("invalid_input")).alias("failure_class"),
        F.when(~good, F.lit(BAD_ROW)).alias("message"),
        F.when(~good, F.lit(1)).alias("attempt"),
    )


def cap_items(rows: DataFrame, n: int, job_col: str | Column = "job_id") -> DataFrame:
    """The first n rows of each job in the order of seq, errors included. The window keeps a group's limit before its shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(job_col).orderBy("seq"))).where(F.col("_n") <= n).drop("_n")
