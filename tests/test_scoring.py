"""The wave driver: conservation under fault mixes, budget, abort, resume, pacing."""

from __future__ import annotations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.jobs.fixtures import respond_offline
from promptloom.jobs.responders import run_attempts, spaced
from promptloom.jobs.scoring import NotConserved, Policy, resume, score
from promptloom.operators import outcomes as O
from promptloom.operators import telemetry


def prompts(spark, n, job="j"):
    return spark.range(n).select(F.lit(job).alias("job_id"), F.col("id").alias("seq"), F.concat(F.lit("item-"), "id").alias("item_id"), F.lit("text").alias("prompt"), F.lit("m").alias("model"), F.lit(64).alias("max_tokens"))


def offline(**faults):
    return lambda df: respond_offline(df, **faults)


MIXES = [dict(p_429=0.5), dict(p_500=0.5), dict(p_timeout=0.3), dict(p_400=0.3, p_malformed=0.2), dict(p_error=0.4, p_429=0.3)]


@pytest.mark.parametrize("mix", MIXES)
def test_every_item_ends_once(spark, tmp_path, mix):
    p = prompts(spark, 60)
    r = score(p, offline(seed=3, **mix), str(tmp_path / "s")).results
    audit = O.conservation(p, r).first()
    assert audit.conserved and audit.ok == 60


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    p = prompts(spark, 80)
    a = score(p, offline(), str(tmp_path / "a")).results.orderBy("seq").collect()
    b = score(p.repartition(5), offline(), str(tmp_path / "b")).results.orderBy("seq").collect()
    assert a == b


def test_budget_bounds_retries(spark, tmp_path):
    done = score(prompts(spark, 100), offline(p_timeout=0.0, p_429=1.0), str(tmp_path / "s"))
    assert done.attempts.where("attempt > 1").count() == 20
    assert done.results.where("failure_class = 'transient_exhausted'").count() == 100


def test_fatal_response_stops_the_job(spark, tmp_path):
    def attempt(df):
        x = offline(p_timeout=0.0, p_429=0.0, p_500=0.0, p_400=0.0, p_malformed=0.0)(df)
        return x.withColumn("http_status", F.when(F.col("seq") >= 5, 401).otherwise(F.col("http_status")))

    done = score(prompts(spark, 1000), attempt, str(tmp_path / "s"), Policy(chunk=50))
    assert done.ingested.first().n == 50 and done.results.count() == 50
    assert done.results.where("failure_class = 'fatal_auth'").count() == 45


def test_resume_scores_the_rest_and_restart_repeats_no_call(spark, tmp_path):
    p = prompts(spark, 60)
    first = score(p.where("seq < 20"), offline(), str(tmp_path / "a")).results
    both = resume(p, first, offline(), str(tmp_path / "b"))
    assert O.conservation(p, both).first().conserved

    def broken(df):
        return offline()(df).withColumn("http_status", F.raise_error(F.lit("called again")).cast("int"))

    assert score(p.where("seq < 20"), broken, str(tmp_path / "a")).results.orderBy("seq").collect() == first.orderBy("seq").collect()


def test_exceptions_of_a_responder_are_data(spark):
    class Raises:
        def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
            raise RuntimeError("boom")

    rows = run_attempts(prompts(spark, 30), Raises, slots=3).collect()
    assert len(rows) == 30 and all(r.transport_error == "unexpected error: boom" and r.http_status is None for r in rows)


def test_a_responder_fails_row_by_row(spark):
    class Picky:
        made = 0

        def __init__(self):
            Picky.made += 1
            if Picky.made == 1:
                raise OSError("no connection")

        def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
            if batch["item_id"].iloc[0].endswith("3"):
                raise RuntimeError("boom")
            return pd.DataFrame({"http_status": 200, "transport_error": None, "malformed": False, "response_text": batch["item_id"], "input_tokens": 1, "output_tokens": 1, "latency_s": 0.1})

    rows = sorted(run_attempts(prompts(spark, 40).coalesce(1), Picky, slots=1).collect(), key=lambda r: r.seq)
    assert sum(r.transport_error == "unexpected error: no connection" for r in rows) == 1
    assert all(r.transport_error == "unexpected error: boom" for r in rows if r.item_id.endswith("3") and r.transport_error != "unexpected error: no connection")
    assert sum(r.http_status == 200 and r.response_text == r.item_id for r in rows) >= 35


@settings(max_examples=40, deadline=None)
@given(st.floats(0.5, 20), st.integers(1, 6), st.lists(st.floats(0, 3), min_size=5, max_size=60))
def test_calls_keep_to_the_rate(rate, slots, work):
    now = [0.0]
    wait = spaced(rate, slots, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s + 1e-9))
    at = []
    for w in work:
        at.append(wait(1))
        now[0] += w
    assert all(sum(t <= x < t + w for x in at) <= rate / slots * w + 1 + 1e-6 for t in at for w in (1, 5, 10))


def answers(df, status=200):
    return offline(p_timeout=0.0, p_429=0.0, p_500=0.0, p_400=0.0, p_malformed=0.0)(df).withColumn("http_status", F.lit(status) if isinstance(status, int) else status)


def test_messages_and_codes(spark, tmp_path):
    code = F.when(F.col("seq") == 7, 402).when(F.col("seq") == 2, 422).when(F.col("seq") > 7, 429).otherwise(200)
    rows = {r.seq: (r.failure_class, r.message, r.http_status, r.attempt) for r in score(prompts(spark, 10), lambda df: answers(df, code), str(tmp_path / "s")).results.collect()}
    assert rows[0] == (None, None, None, 1) and rows[2] == ("invalid_input", "max attempts exhausted", 422, 1)
    assert rows[7] == ("fatal_billing", "fatal: HTTP 402", 402, 1) and rows[9] == ("fatal_billing", "fatal_billing (HTTP 402)", None, 1)
    none = score(prompts(spark, 10, "k"), lambda df: answers(df, 429), str(tmp_path / "b"), Policy(budget_share=0.1)).results
    assert {(r.message, r.http_status) for r in none.collect()} == {("retry budget exhausted", 429)}
    worn = score(prompts(spark, 1, "m"), lambda df: answers(df, 503), str(tmp_path / "w"), Policy(budget_share=9.0)).results.first()
    assert (worn.attempt, worn.failure_class, worn.message) == (5, "transient_exhausted", "max attempts exhausted")
    short = score(prompts(spark, 4, "n"), lambda df: answers(df, 429), str(tmp_path / "v"), Policy(budget_share=9.0, waves=2)).results
    assert {(r.attempt, r.message) for r in short.collect()} == {(2, "max attempts exhausted")}


def test_cap_takes_the_first_items_of_each_job(spark, tmp_path):
    p = prompts(spark, 50).unionByName(prompts(spark, 7, "k")).unionByName(prompts(spark, 5, None))
    done = score(p.repartition(3), offline(), str(tmp_path / "s"), Policy(max_items=10, chunk=2))
    got = {(r.job_id, r.seq) for r in done.results.collect()}
    assert got == {("j", i) for i in range(10)} | {("k", i) for i in range(7)} | {(None, i) for i in range(5)}
    assert {r.job_id: r.n for r in done.ingested.collect()} == {"j": 10, "k": 7, None: 5}


def test_cancel_ends_waiting_items_and_later_slices(spark, tmp_path):
    p = prompts(spark, 500).unionByName(prompts(spark, 20, "k"))
    done = score(p, lambda df: answers(df, F.when(F.col("seq") % 2 == 0, 503).otherwise(200)), str(tmp_path / "s"), Policy(chunk=10, budget_share=9.0, cancelled=lambda step: ["j"] if step == 0 else []))
    assert {r.job_id: r.n for r in done.ingested.collect()} == {"j": 10, "k": 20}
    rows = done.results.where("job_id = 'j'").collect()
    assert sum(r.status == "success" for r in rows) == 5
    assert {(r.failure_class, r.message, r.http_status, r.attempt) for r in rows if r.status == "error"} == {("cancelled", "job cancelled before dispatch", None, 1)}
    assert done.results.where("job_id = 'k' and attempt = 5").count() == 10 and [r.job_id for r in done.stopped.collect()] == ["j"]


def test_spend_cap_stops_before_the_next_slice(spark, tmp_path):
    done = score(prompts(spark, 2000), lambda df: answers(df), str(tmp_path / "s"), Policy(chunk=20, spend_cap=0.001))
    stop = done.stopped.first()
    assert done.results.count() == 220 and stop.stop_class == "fatal_auth" and stop.abort_reason.startswith("spend guard: cost $0.0") and stop.abort_reason.endswith(">= cap $0.001")


def test_large_jobs_are_ranked_by_ranges(spark, tmp_path, monkeypatch):
    from promptloom.jobs import scoring

    want = score(prompts(spark, 90), offline(), str(tmp_path / "a")).results.orderBy("seq").collect()
    monkeypatch.setattr(scoring, "WINDOW_ROWS", 3)
    monkeypatch.setattr(scoring, "RANGE_ROWS", 7)
    assert score(prompts(spark, 90), offline(), str(tmp_path / "b")).results.orderBy("seq").collect() == want


@pytest.mark.parametrize("broken", [lambda df: answers(df).where("seq <> 4"), lambda df: answers(df).withColumn("item_id", F.when(F.col("seq") == 4, "item-5").otherwise(F.col("item_id")))])
def test_audit_raises(spark, tmp_path, broken):
    with pytest.raises(NotConserved, match="differ in j"):
        score(prompts(spark, 10), broken, str(tmp_path / "s"))


def test_null_jobs_resume_and_reconcile(spark, tmp_path):
    p = prompts(spark, 6, None)
    first = score(p.where("seq < 4"), lambda df: answers(df), str(tmp_path / "a")).results
    assert sorted(r.seq for r in O.pending_prompts(p, first).collect()) == [4, 5]
    assert O.conservation(p, resume(p, first, lambda df: answers(df), str(tmp_path / "b"))).first().conserved
    assert {r.verdict for r in O.reconcile(p, first).collect()} == {"ok", "missing"}


def test_quota_counts_across_hours(spark):
    ts = [3599.0, 3599.5, 3600.2, 3604.0, 3608.9, 3609.5]
    df = spark.createDataFrame([("j", t) for t in ts], "job_id string, s double").select("job_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    got = {r.window_s: (r.checked, r.most) for r in telemetry.quota_compliance(df, 1.0, 1.0).collect()}
    assert got == {w: (6, max(sum(t <= x < t + w for x in ts) for t in ts)) for w in (1, 5, 10)}


def test_outcomes_first_terminal_attempt_wins(spark):
    rows = [("j", 0, "a", 1, "transient", 5), ("j", 0, "a", 2, "success", 1), ("j", 0, "a", 3, "invalid_input", 1), ("j", 1, "b", 1, "transient", 2), ("j", 1, "b", 2, "transient", 2), ("j", 2, "c", 1, "throttled", 8)]
    df = spark.createDataFrame(rows, "job_id string, seq long, item_id string, attempt int, failure_class string, max_attempts int")
    got = {r.item_id: (r.attempt, r.status, r.final_class) for r in O.attempt_outcomes(df).collect()}
    assert got == {"a": (2, "success", None), "b": (2, "error", "transient_exhausted")}
