"""Live status by batches and after a restart."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.streaming import feeds

ROWS = "job_id string, status string, failure_class string, input_tokens long, output_tokens long"


def rows(lo, hi):
    kinds = [("success", None), ("error", "invalid_input"), ("error", "transient_exhausted"), ("success", None), ("error", "strange"), (None, None)]
    return [(["a", "b", None][i % 3], *kinds[i % 6 if i % 3 else i % 5], i, 2 * i) for i in range(lo, hi)]


def batch_status(spark, data):
    out: dict = {}
    for job, status, kind, i, o in data:
        s = out.setdefault(job, [0, 0, 0, 0, {}])
        if status == "success":
            s[0], s[2], s[3] = s[0] + 1, s[2] + i, s[3] + o
        else:
            known = kind if kind in ("invalid_input", "transient_exhausted") else "other"
            s[1] += 1
            s[4][known] = s[4].get(known, 0) + 1
    return out


def test_status_equals_the_batch_after_every_batch(spark, tmp_path):
    src, path, data = str(tmp_path / "in"), str(tmp_path / "out"), []
    for part in range(3):
        more = rows(40 * part, 40 * part + 40 if part < 2 else 81)
        spark.createDataFrame(more, ROWS).coalesce(1).write.mode("append").parquet(src)
        data += more
        out = feeds.run_available(feeds.stream_status(feeds.stream_table(spark, src, 1)), path, "update")  # each run goes on where the last one ended
        got = {r.job_id: [r.succeeded, r.failed, r.input_tokens, r.output_tokens, dict(r.errors)] for r in feeds.last_rows(out, "job_id").collect()}
        assert got == batch_status(spark, data)
    # the last batch changed one job only
    last = out.agg(F.max("batch")).first()[0]
    assert out.where(F.col("batch") == last).count() == 1
