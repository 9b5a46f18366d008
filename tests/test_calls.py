"""Calls inside a wave: due times, calls in flight, deadlines, and stops that tasks tell each other."""

from __future__ import annotations

import sys
import threading
import time

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from promptloom.functions.scalar import retry_due_s
from promptloom.jobs.fixtures import respond_offline
from promptloom.jobs.responders import Caller, Calls, run_attempts
from promptloom.jobs.scoring import Policy, score
from promptloom.jobs.stops import Stops
from promptloom.operators import outcomes as O
from promptloom.operators import telemetry

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def prompts(spark, n, job="j"):
    return spark.range(n).select(F.lit(job).alias("job_id"), F.col("id").alias("seq"), F.concat(F.lit("item-"), "id").alias("item_id"), F.lit("text").alias("prompt"), F.lit("m").alias("model"), F.lit(64).alias("max_tokens"))


def answer(status=200, tokens=1, **more):
    return pd.DataFrame([{"http_status": status, "transport_error": None, "malformed": False, "response_text": "ok", "input_tokens": tokens, "output_tokens": tokens, **more}])


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_no_call_before_it_is_due():
    clock, at = Clock(), []

    def respond(batch):
        at.append((batch["item_id"].iloc[0], clock.now))
        clock.now += 0.4
        return answer()

    due = [None, 990.0, 1003.5, 1003.6, 1010.25]
    out = Calls(lambda: respond, clock=clock, sleep=clock.sleep).run(pd.DataFrame({"job_id": "j", "item_id": list("abcde"), "due_s": due}))
    assert [i for i, _ in at] == list("abcde")
    assert all(d is None or t >= d for (_, t), d in zip(at, due, strict=True)) and at[2][1] == 1003.5 and at[4][1] == 1010.25
    assert out["ts"].tolist() == [pd.Timestamp(round(t * 1e6), unit="us", tz="UTC") for _, t in at]


def test_due_times_of_retries(spark):
    rows = [("j", "a", 1, "throttled", 0.5, {"x-ratelimit-reset-requests": "1007"}), ("j", "b", 2, "transient", 0.25, {"x-ratelimit-reset-requests": "1007"}), ("j", "c", 3, "throttled", 0.0, {"x-ratelimit-reset-requests": "soon"}), ("j", "d", 9, "throttled", 0.0, None)]
    log = spark.createDataFrame(rows, "job_id string, item_id string, attempt int, failure_class string, latency_s double, headers map<string,string>").withColumn("ts", F.timestamp_micros(F.lit(1_000_000_000)))
    due = {r.item_id: r.due_s for r in log.select("item_id", retry_due_s().alias("due_s")).collect()}
    assert 1007 <= due["a"] <= 1007 + 0.25 + 1.0
    assert 1000.25 <= due["b"] <= 1000.25 + 2.0
    assert 1000 <= due["c"] <= 1004 and 1000 <= due["d"] <= 1030
    assert log.withColumn("ts", F.lit(None).cast("timestamp")).select(retry_due_s().alias("x")).where("x is null").count() == 4


def test_many_calls_at_once_keep_their_rows():
    most, now, lock = [0], [0], threading.Lock()

    def respond(batch):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        if batch["item_id"].iloc[0] == "5":
            raise RuntimeError("boom")
        return answer().assign(response_text=batch["item_id"])

    began = time.monotonic()
    out = Calls(lambda: respond, in_flight=16).run(pd.DataFrame({"job_id": "j", "item_id": [str(i) for i in range(320)]}))
    assert time.monotonic() - began < 8 and most[0] == 16  # one after another they take 16 s
    assert all(r.response_text == r.item_id for r in out.itertuples() if r.item_id != "5")
    assert out["transport_error"].dropna().tolist() == ["unexpected error: boom"]
    assert out.loc[out["item_id"] != "5", "latency_s"].min() >= 0.05


def test_a_call_that_hangs_fails_alone():
    def respond(batch):
        time.sleep(30 if batch["item_id"].iloc[0] == "2" else 0.01)
        return answer()

    began = time.monotonic()
    out = Calls(lambda: respond, in_flight=2, deadline_s=0.5).run(pd.DataFrame({"job_id": "j", "item_id": [str(i) for i in range(8)]}))
    assert time.monotonic() - began < 5
    assert out["transport_error"].tolist() == [None, None, "no answer in 0.5 s"] + [None] * 5


class Refused:
    """401 from the sixth row on; calls leave a file each."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, batch):
        import uuid

        (self.folder / uuid.uuid4().hex).touch()
        time.sleep(0.002)
        return answer(401 if batch["seq"].iloc[0] >= 5 else 200)


def test_a_fatal_response_ends_the_wave(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    done = score(prompts(spark, 1000), Caller(lambda: Refused(calls), slots=4), str(tmp_path / "run"))
    made = len(list(calls.iterdir()))
    assert made < 100 and done.attempts.count() == made
    assert done.stopped.collect() == [("j", "fatal_auth", "fatal_auth (HTTP 401)")]
    rows = done.results.collect()
    assert len(rows) == 1000 and {r.failure_class for r in rows} <= {"fatal_auth", None}
    waiting = [r for r in rows if r.message == "fatal_auth (HTTP 401)"]
    assert len(waiting) == 1000 - made and all(r.attempt == 1 and r.http_status is None for r in waiting)
    assert O.conservation(prompts(spark, 1000), done.results).first().conserved
    again = score(prompts(spark, 1000), Caller(lambda: Refused(calls), slots=4), str(tmp_path / "run"))
    assert again.results.count() == 1000 and len(list(calls.iterdir())) == made


def test_spending_ends_the_wave(spark, tmp_path):
    done = score(prompts(spark, 2000), Caller(lambda: lambda b: answer(tokens=10_000), slots=4), str(tmp_path / "run"), Policy(spend_cap=0.4))
    assert 100 <= done.attempts.count() <= 100 + 4 * 50 + 4 * 50
    assert done.stopped.first().stop_class == "fatal_auth" and "spend guard" in done.stopped.first().abort_reason
    assert done.results.count() == 2000


def test_other_jobs_go_on(spark, tmp_path):
    both = prompts(spark, 60, "bad").unionByName(prompts(spark, 60, "good"))

    class OneBad:
        def __call__(self, batch):
            return answer(402 if batch["job_id"].iloc[0] == "bad" else 200)

    done = score(both, Caller(OneBad, slots=2), str(tmp_path / "run"))
    assert done.results.where("job_id = 'good' and status = 'success'").count() == 60
    assert done.results.where("job_id = 'bad' and failure_class = 'fatal_billing'").count() == 60
    # rows of two jobs in one call: those that go on are called
    stops = Stops(str(tmp_path / "more"))
    stops.stop("bad", "fatal_billing", "fatal_billing (HTTP 402)")
    part = pd.DataFrame({"job_id": ["bad", "good", "bad", "good"], "item_id": list("abcd")})
    out = Calls(lambda: lambda b: pd.concat([answer()] * len(b)), batch=4, stops=Stops(str(tmp_path / "more"))).run(part)
    assert out["http_status"].tolist() == [None, 200, None, 200] and [bool(s) for s in out["stopped"]] == [True, False, True, False]


def test_attempts_of_a_run_feed_the_studies(spark, tmp_path):
    class Timed:
        def __call__(self, batch):
            headers = {"x-ratelimit-reset-requests": str(int(time.time())), "x-ratelimit-remaining-tokens-per-day": "5", "x-ratelimit-limit-tokens-per-day": "9"}
            return answer(429 if batch["attempt"].iloc[0] == 1 and batch["seq"].iloc[0] % 20 == 0 else 200, headers=headers)

    log = score(prompts(spark, 60), Caller(Timed, slots=2), str(tmp_path / "run")).attempts
    assert log.where("ts is null or headers is null").count() == 0 and log.count() == 63
    retried = log.where("attempt = 2").select((F.unix_micros("ts") / 1e6 >= F.col("due_s")).alias("ok")).collect()
    assert len(retried) == 3 and all(r.ok for r in retried)
    assert telemetry.rolling_latency(log).count() == 60
    assert telemetry.quota_compliance(log, 1000, 100).count() == 3
    assert telemetry.header_drift(log).first().limits == 1
    assert telemetry.reset_lag(log).first().n == 3


def test_empty_table(spark, tmp_path):
    none = prompts(spark, 0)
    assert score(none, Caller(lambda: lambda b: answer(), slots=2), str(tmp_path / "run")).results.count() == 0
    assert run_attempts(none, lambda: lambda b: answer(), slots=2).count() == 0
    assert respond_offline(none.withColumn("attempt", F.lit(1)), timed=True).count() == 0
