"""Files of prompts and results."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from promptloom.sources import prompts as intake
from promptloom.sources.heads import file_heads
from promptloom.sources import results as logs


def lines(spark, tmp_path, text):
    (tmp_path / "in.jsonl").write_text(text)
    return {r.seq: r for r in intake.read_prompt_lines(spark, str(tmp_path / "in.jsonl")).collect()}


def test_bad_line_is_isolated(spark, tmp_path):
    got = lines(spark, tmp_path, '{"id": "a", "prompt": "x"}\n{not valid json\n\n{"id": "b", "prompt": ""}\n{"prompt": "p"} x\n[1]\n{"id": null, "prompt": "q"}\n{"id": true}\n')
    assert got[0].item_id == "a" and got[0].failure_class is None
    assert got[1].item_id == "line-1" and got[1].failure_class == "invalid_input" and got[1].message.startswith("malformed JSON line: ")
    assert 2 not in got and got[3].prompt == ""
    assert got[4].item_id == "line-4" and got[5].item_id == "offset-5" and got[5].message == "row missing a string 'prompt' field"
    assert got[6].item_id == "None" and got[6].prompt == "q" and got[7].item_id == "True" and got[7].prompt is None


def test_line_numbers_over_many_splits(spark, tmp_path):
    n = 5000
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"prompt": f"p{i}", "pad": "x" * 50}) + "\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = intake.read_prompt_lines(spark, str(tmp_path / "big.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.seq for r in rows) == list(range(n)) and all(r.prompt == f"p{r.seq}" and r.item_id == f"offset-{r.seq}" for r in rows)


def test_array_and_format(spark, tmp_path):
    (tmp_path / "a.json").write_text('  [{"id":"a"},{"id":"b","prompt":"ok"}]')
    (tmp_path / "b.json").write_text('{"prompt":"ok"}\n')
    (tmp_path / "c.json").write_text("")
    got = intake.read_prompt_array(spark, str(tmp_path / "a.json")).orderBy("seq").collect()
    assert [(r.item_id, r.failure_class) for r in got] == [("a", "invalid_input"), ("b", None)]
    kinds = {os.path.basename(r.file): r.format for r in intake.detect_format(spark, str(tmp_path / "*.json")).collect()}
    assert kinds == {"a.json": "array", "b.json": "lines", "c.json": "lines"}


def test_arrays_of_many_files_keep_file_and_position(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"a{i}.json").write_text(json.dumps([{"id": f"{i}-{k}", "prompt": "q\n\"ü\" " * 500} for k in range(4)] + [7]))
    rows = intake.read_prompt_array(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.file), r.seq, r.item_id, len(r.prompt or "")) for r in rows) == sorted((f"a{i}.json", k, f"{i}-{k}" if k < 4 else "offset-4", 3000 if k < 4 else 0) for i in range(3) for k in range(5))


def test_heads_of_many_files(spark, tmp_path):
    """Each file once, whatever the tasks; only the first bytes, also of patterns and folders in folders."""
    for i in range(60):
        folder = tmp_path / f"part={i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"{i} ü.json").write_bytes((b"\xa0\x85 [" if i % 2 else b"{") + b"\xff" * 100_000)
    (tmp_path / "part=0" / "_SUCCESS").write_text("")
    for tasks in (1, 7):
        rows = file_heads(spark, str(tmp_path), 64, tasks).collect()
        assert len(rows) == len({r.file for r in rows}) == 60 and all(len(r["head"]) == 64 for r in rows)
    for path in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/part=*", f"{tmp_path}/*/*.json"):
        kinds = intake.detect_format(spark, path).collect()
        assert len(kinds) == 60 and all((r.format == "array") == (int(os.path.basename(r.file).split()[0]) % 2 == 1) for r in kinds)
    assert intake.detect_format(spark, f"{tmp_path}/part=1/1 ü.json").count() == 1 and intake.detect_format(spark, str(tmp_path / "none")).count() == 0


def test_format_is_told_by_the_first_64_characters(spark, tmp_path):
    for name, text in {"a": "\n" * 63 + "[", "b": "\n" * 64 + "[", "c": " \r\n\t[1]", "d": "x" * 70_000 + "\n[", "e e": "\n\n"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    kinds = {os.path.basename(r.file): r.format for r in intake.detect_format(spark, str(tmp_path / "*.json")).collect()}
    assert kinds == {"a.json": "array", "b.json": "lines", "c.json": "array", "d.json": "lines", "e e.json": "lines"}


def test_streamed_lines_have_names_of_their_own(spark, tmp_path):
    from promptloom.streaming import feeds

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.jsonl").write_text('{"prompt": "same"}\n\n{"prompt": "same"}\n{"id": "x", "prompt": "p"}\n{broken\n')
    rows = feeds.run_available(feeds.stream_prompts(spark, str(tmp_path / "in")), str(tmp_path / "out")).collect()
    assert sorted(r.seq for r in rows) == [0, 0, 2, 2, 3, 3, 4, 4] and len({r.item_id for r in rows}) == 7
    assert len({r.item_id for r in rows if r.item_id.startswith("line-")}) == 2


def test_sliding_quota_windows(spark, tmp_path):
    from promptloom.streaming import feeds

    rows = spark.sql("SELECT 'j' AS job_id, timestamp_seconds(s) AS ts, CASE WHEN s % 20 = 0 THEN 429 ELSE 200 END AS http_status FROM (SELECT explode(sequence(600, 700, 10)) AS s) UNION ALL SELECT 'end', timestamp_seconds(90000), 200")
    rows.write.parquet(str(tmp_path / "in"))
    out = feeds.run_available(feeds.stream_quota_usage(feeds.stream_table(spark, str(tmp_path / "in")), "1 minute", "60 seconds", "30 seconds"), str(tmp_path / "out"))
    got = {int(r.minute.timestamp()): (r.requests, r.throttled) for r in out.where("job_id = 'j'").collect()}
    assert got == {w: (sum(w <= s < w + 60 for s in range(600, 701, 10)), sum(w <= s < w + 60 for s in range(600, 701, 20))) for w in range(570, 701, 30)}


RESULTS = [("j", 0, "a", "success", "hi", 1, 2, 0.5, 1, None, None, None), ("j", 1, "b", "error", None, None, None, None, 5, "transient_exhausted", "m", None), ("k", 0, "c", "error", None, None, None, None, 1, "invalid_input", "m", 400)]


def results(spark):
    from promptloom.schemas import RESULTS as schema

    return spark.createDataFrame(RESULTS, schema)


def test_result_log_shapes_and_torn_tail(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.write_results(results(spark), path, "r")
    text = [json.loads(x[0]) for x in spark.read.text(path).select("value").collect()]
    assert {frozenset(x) for x in text} == {frozenset(logs.SUCCESS_KEYS), frozenset(logs.ERROR_KEYS)}
    with open(f"{path}/run=r/job_id=j/torn.txt", "w") as f:
        f.write('{"item_id": "torn", "status": "suc\n\n')
    back = logs.read_results(spark, path).collect()
    assert sorted((r.job_id, r.item_id, r.status, r.http_status) for r in back) == [("j", "a", "success", None), ("j", "b", "error", None), ("k", "c", "error", 400)]
    assert logs.read_results(spark, str(tmp_path / "none")).count() == 0


def test_export(spark):
    reports = spark.createDataFrame([("j", "partial"), ("k", "running")], "job_id string, status string")
    assert [r.item_id for r in logs.export_results(results(spark), reports, "errors").collect()] == ["b"]
    assert logs.export_results(results(spark), reports, "all", partial=True).count() == 3
    parts = logs.array_lines(results(spark)).orderBy("at").collect()
    assert [x["item_id"] for x in json.loads("".join(r.value for r in parts))] == ["a", "b", "c"]


def test_export_files(spark, tmp_path):
    many = spark.range(300).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("job_id"), F.col("id").alias("seq"), F.concat(F.lit("i"), "id").alias("item_id"), F.lit("success").alias("status"), F.lit('two\nlines "q"').alias("response_text"), *(F.lit(1).alias(c) for c in ("input_tokens", "output_tokens", "latency_s", "attempt", "http_status")), *(F.lit(None).cast("string").alias(c) for c in ("failure_class", "message")))
    read = lambda name: "\n".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    logs.write_export(many.repartition(5), str(tmp_path / "array"), "array")
    want = [f"i{i}" for i in range(300) if i % 3 == 0] + [f"i{i}" for i in range(300) if i % 3]
    assert [x["item_id"] for x in json.loads(read("array"))] == want
    logs.write_export(many, str(tmp_path / "lines"))
    assert [json.loads(x)["item_id"] for x in read("lines").split("\n") if x] == want
    logs.write_export(many.limit(0), str(tmp_path / "none"), "array")
    assert json.loads(read("none")) == []


def test_records(spark):
    old = spark.createDataFrame([("a", 1, {"x": 1}), ("b", 1, {})], "job_id string, updated_at int, e map<string,int>")
    new = spark.createDataFrame([("a", 2, {"y": 2})], old.schema)
    both = logs.upsert_reports(old, new)
    back = logs.from_record(logs.to_record(both), both.schema)
    assert {(r.job_id, r.updated_at, tuple(r.e.items())) for r in back.collect()} == {("a", 2, (("y", 2),)), ("b", 1, ())}


def test_logs_are_checked_in_small_slices(spark):
    """a batch of many long lines is never in a worker as Python objects at once, and what goes back is small, too."""
    import pyarrow as pa

    rows = ['{"item_id": "%d", "response_text": "%s"}' % (i, "é" * 2000) + ("x" if i % 5 == 0 else "") for i in range(3000)]
    out = list(logs._whole_objects(iter([pa.record_batch({"job_id": ["j"] * len(rows), "line": rows}), pa.record_batch({"job_id": ["j"], "line": ["[" + "1," * 2_000_000 + "1]"]})])))
    assert [x for b in out for x in b.column("line").to_pylist()] == [x for i, x in enumerate(rows) if i % 5]
    assert len(out) > 10 and max(b.nbytes for b in out) < 2 << 20


def test_prompt_lines_are_checked_in_small_slices(spark):
    """as logs; blank and null lines are left out, positions stay."""
    import pyarrow as pa

    rows = [None if i % 7 == 0 else " 　" if i % 7 == 1 else '{"id": %d, "prompt": "%s"}' % (i, "é" * 2000) for i in range(3000)]
    batch = pa.record_batch({"file": ["f"] * len(rows), "seq": list(range(len(rows))), "line": rows})
    out = list(intake._checked(["file"])(iter([batch])))
    assert [(r["seq"], r["item_id"], r["prompt"]) for b in out for r in b.to_pylist()] == [(i, str(i), "é" * 2000) for i in range(3000) if i % 7 > 1]
    assert len(out) > 5 and max(b.nbytes for b in out) < 4 << 20
