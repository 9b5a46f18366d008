"""Windows, policies and reports against plain Python."""

from __future__ import annotations

from collections import deque

from pyspark.sql import functions as F

from promptloom.operators import ordered, reporting, telemetry


def log(spark, rows):
    """rows: (seconds, class)."""
    data = [("j", i, 1, float(t), c) for i, (t, c) in enumerate(rows)]
    df = spark.createDataFrame(data, "job_id string, seq long, attempt int, s double, failure_class string")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).withColumn("latency_s", F.col("seq") / 100)


def test_rolling_over_small_chunks_equals_a_plain_window(spark):
    df = log(spark, [(i * 400.0, "success") for i in range(57)])
    n = ordered.numbered(df, ["job_id"], ordered.by_hour(), ordered.ORDER)
    got = {r.seq: (r.n, r.a) for r in ordered.rolling(n, ["job_id"], "n", 5, {"a": F.sum("seq")}, chunk=10).collect()}
    assert got == {i: (i + 1, sum(range(max(0, i - 4), i + 1))) for i in range(57)}


def test_breaker_openings(spark):
    rows = [(i, "transient") for i in range(12)] + [(20 + i, "success") for i in range(14)] + [(50 + i, "transient") for i in range(9)]
    got = [(r.seq, round(r.failure_rate, 6)) for r in telemetry.breaker_openings(log(spark, rows)).orderBy("seq").collect()]
    assert got == [(9, 1.0), (28, round(15 / 29, 6))]


def test_latency_profile_by_sketches(spark):
    df = log(spark, [(i, "success") for i in range(101)]).withColumnsRenamed({"failure_class": "outcome", "job_id": "condition"})
    exact, near = (telemetry.latency_profile(df, exact=e).first() for e in (True, False))
    assert (exact.n, exact.p50, exact.p95) == (101, 0.5, 0.95) and abs(near.p50 - 0.5) < 0.02 and abs(near.p95 - 0.95) < 0.02


def test_failure_rate_matches_a_deque(spark):
    classes = ["transient", "success", "throttled", "fatal_auth", "invalid_input"]
    rows = [(i * 97.0, classes[i * i % 5]) for i in range(300)]
    got = {r.seq: (r.failure_rate, r.trips) for r in telemetry.rolling_failure_rate(log(spark, rows)).collect()}
    last = deque(maxlen=100)
    for i, (_, c) in enumerate(rows):
        last.append(c in ("transient", "fatal_auth"))
        rate = sum(last) / len(last)
        assert got[i] == (rate, len(last) >= 10 and rate > 0.5)


def test_ledger_clamps_and_refuses(spark):
    df = spark.createDataFrame([("a", 1, 0.10), ("b", 2, -5.0), ("c", 3, 0.95), ("d", 4, 0.1)], "job_id string, submitted_at int, cost_usd double")
    got = [(r.total_before, r.total_after, r.refused) for r in reporting.spend_ledger(df).orderBy("submitted_at").collect()]
    assert got == [(0.0, 0.1, False), (0.1, 0.1, False), (0.1, 1.05, False), (1.05, 1.15, True)]


def test_status_precedence(spark):
    rows = [(True, True, 5, 1, 1, "cancelled"), (False, True, 5, 5, 0, "failed"), (False, False, 0, 0, 0, "succeeded"), (False, False, 5, 5, 0, "succeeded"), (False, False, 5, 0, 5, "failed"), (False, False, 5, 2, 3, "partial")]
    df = spark.createDataFrame(rows, "cancelled boolean, aborted boolean, ingested long, succeeded long, failed long, want string")
    assert all(r.got == r.want for r in df.withColumn("got", reporting.final_status()).collect())


def test_metrics(spark):
    df = spark.createDataFrame([("a", "partial", 10, 9, 1, 0, 2, 3, 1.5, 0.01)], "job_id string, status string, ingested long, succeeded long, failed long, in_flight long, throttle_events long, retries_issued long, rate_limit_rps double, cost_usd double")
    text = [r.value for r in reporting.metrics_text(df).collect()]
    assert len(text) == 24 and text[0].startswith("# HELP promptloom_job_ingested_total") and 'promptloom_job_ingested_total{job_id="a",status="partial"} 10.0' in text
