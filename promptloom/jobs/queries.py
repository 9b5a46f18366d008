"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.functions import scalar as S
from promptloom.jobs import fixtures as X
from promptloom.jobs.fixtures import respond_offline
from promptloom.jobs.responders import run_attempts
from promptloom.jobs.scoring import Policy, resume, score
from promptloom.jobs.workdir import work_path
from promptloom.operators import outcomes as O
from promptloom.operators import planning as P
from promptloom.operators import telemetry
from promptloom.operators.ordered import numbered
from promptloom.operators import reporting as R
from promptloom.sources import prompts as intake
from promptloom.sources import results as logs
from promptloom.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return O.attempt_outcomes(X.draws(spark, d))


def _partial(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).where("seq % 3 <> 0")


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    p = _partial(spark, d).select("job_id", "item_id", "status", F.col("seq").alias("log_seq"))
    again = p.where("log_seq % 7 = 0").withColumn("log_seq", F.col("log_seq") + 1_000_000_000)
    ghosts = p.select("job_id").distinct().select("job_id", F.concat(F.lit("ghost-"), "job_id").alias("item_id"), F.lit("error").alias("status"), F.lit(0).cast("long").alias("log_seq"))
    return p.unionByName(again).unionByName(ghosts)


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """A row a job, and one without prompts."""
    ids = X.prompts(spark, d).select("job_id").distinct().unionByName(spark.createDataFrame([("zz-empty",)], "job_id string"))
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("job_id"))
    return ids.withColumn("i", i).select(
        "job_id",
        "i",
        (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("i"))).alias("submitted_at"),
        (F.col("i") * 10).cast("double").alias("elapsed_s"),
        (F.col("i") % 5 == 0).alias("running"),
        (F.col("i") % 7 == 3).alias("cancelled"),
        (F.col("i") % 11 == 4).alias("aborted"),
    )


def _live(spark: SparkSession, d: str) -> DataFrame:
    """Results so far: some items have none yet."""
    return _outcomes(spark, d).where("seq % 13 <> 5").withColumn("failure_class", F.col("final_class"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return R.job_counts(X.prompts(spark, d), _live(spark, d))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """seq, line: a kind of fault for each last digit of doc_id; the others hold the whole text."""
    line = F.expr(
        """CASE doc_id % 10 WHEN 0 THEN concat('{"id": "a', doc_id, '"}') WHEN 1 THEN concat('{"id": "a', doc_id, '", "prompt": 3}')
        WHEN 2 THEN concat('{"prompt": "p', doc_id, '"}') WHEN 3 THEN concat('{"id": "a', doc_id, '", "prom') WHEN 4 THEN concat('{"id": "a', doc_id, '", "prompt": "p"} x')
        WHEN 5 THEN '' WHEN 6 THEN to_json(named_struct('id', doc_id, 'prompt', text)) WHEN 7 THEN '{"id": null, "prompt": "p"}'
        ELSE to_json(named_struct('id', concat('a', doc_id), 'prompt', text)) END"""
    )
    return X.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), line.alias("line"))


#: Documents of a file of lines, elements of a file with an array.
FILE_LINES, FILE_ELEMENTS = 500, 200


def _raw_files(spark: SparkSession, d: str) -> str:
    """The raw lines in files of FILE_LINES documents each, by ranges of doc_id and in its order."""
    path = work_path(spark, "lines")
    lines = _raw(spark, d).withColumn("part", F.floor(F.col("seq") / FILE_LINES))
    lines.repartition("part").sortWithinPartitions("part", "seq").select("part", "line").write.partitionBy("part").text(path)
    return path


def _with_texts(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes; successes have the document as response."""
    texts = X.prompts(spark, d).select("item_id", F.coalesce("prompt", F.lit("")).alias("response_text"))
    return _outcomes(spark, d).join(texts, "item_id").withColumn("failure_class", F.col("final_class"))


def _made(spark: SparkSession, d: str) -> DataFrame:
    """The attempts that an item needed."""
    ended = _outcomes(spark, d).select("job_id", "item_id", F.col("attempt").alias("last"))
    return X.draws(spark, d).join(ended, ["job_id", "item_id"]).where("attempt <= last")


@query
def classify_attempts(spark, d):
    return X.attempts(spark, d).select("job_id", "seq", "http_status", "malformed", "failure_class", "max_attempts")


@query
def failure_predicates(spark, d):
    x = X.attempts(spark, d).groupBy("failure_class").agg(F.count("*").alias("n"))
    return x.select("failure_class", S.is_fatal().alias("fatal"), S.is_retryable().alias("retryable"), S.is_breaker_failure().alias("breaker_failure"), "n")


@query
def completion_parse(spark, d):
    body = F.expr(
        """CASE doc_id % 6 WHEN 0 THEN concat('{"choices": [{"message": {"content": "t', doc_id, '"}}], "usage": {"prompt_tokens": ', doc_id, ', "completion_tokens": 5}}')
        WHEN 1 THEN '{"choices": [{"message": {"content": null, "reasoning_content": "r"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}'
        WHEN 2 THEN '{"usage": {"prompt_tokens": 1}}' WHEN 3 THEN '{"choices": []}' WHEN 4 THEN 'oops'
        ELSE concat('{"choices": [{"message": {"content": "t', doc_id, '"}}]}') END"""
    )
    bodies = X.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.expr("CASE WHEN doc_id % 12 = 11 THEN 500 ELSE 200 END").alias("http_status"), body.alias("body"))
    return S.parse_completion(bodies).drop("body")


@query
def rate_headers(spark, d):
    x = X.with_headers(X.attempts(spark, d)).where("http_status in (200, 429)").select("seq", S.rate_headers().alias("h"))
    get = lambda k: F.try_element_at("h", F.lit(k)).try_cast("long")
    return x.select("seq", F.size("h").alias("kept"), get("x-ratelimit-remaining-requests").alias("remaining_requests"), get("x-ratelimit-remaining-tokens-per-day").alias("remaining_day"))


@query
def reset_wait(spark, d):
    x = X.with_headers(X.attempts(spark, d)).where("http_status = 429")
    wait = S.reset_wait_s(F.try_element_at("headers", F.lit("x-ratelimit-reset-requests")), F.unix_micros("ts") / 1e6)
    return x.select("seq", F.round(wait, 6).alias("wait_s"))


@query
def backoff_bounds(spark, d):
    top = S.backoff_envelope_s()
    return X.draws(spark, d).select("item_id", "attempt", top.alias("envelope_s"), F.round(top * S.unit_hash("item_id", "attempt", F.lit("backoff"), seed=7), 6).alias("delay_s"))


@query
def cost_per_row(spark, d):
    return _outcomes(spark, d).where("status = 'success'").select("item_id", "model", "input_tokens", "output_tokens", S.cost_usd().alias("cost_usd"))


@query
def unit_hash(spark, d):
    return X.prompts(spark, d).select("item_id", F.round(S.unit_hash("item_id", F.lit(1), F.lit("x"), seed=7), 9).alias("u"))


@query
def prompts_validate(spark, d):
    docs = X.table(spark, d, "documents").withColumn("name", F.concat(F.lit("doc-"), "doc_id"))
    x = intake.prompts_from_table(docs, "name", "text", "source", "doc_id")
    return x.select("job_id", "seq", "item_id", "failure_class", F.length("prompt").alias("chars"))


@query
def read_lines(spark, d):
    rows = intake.read_prompt_lines(spark, _raw_files(spark, d))
    # the parser's position differs by engine; its kind does not
    return rows.select(F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long").alias("part"), "item_id", "seq", F.md5("prompt").alias("prompt_md5"), "failure_class", F.regexp_replace("message", "^(malformed JSON line).*", "$1").alias("message"))


@query
def read_array(spark, d):
    """Every job's prompts, whole, in files of FILE_ELEMENTS elements, a JSON array each; some elements have no id or no text."""
    path = work_path(spark, "arrays")
    seq = F.col("seq")
    element = F.when(seq % 17 == 3, F.to_json(F.struct(F.col("item_id").alias("id"), seq.alias("prompt")))).when(seq % 17 == 5, F.to_json(F.struct("prompt"))).otherwise(F.to_json(F.struct(F.col("item_id").alias("id"), "prompt")))
    x = numbered(X.prompts(spark, d), ["job_id"], F.floor(seq / 100_000), ["seq"])
    x = x.select("job_id", "n", F.floor((F.col("n") - 1) / FILE_ELEMENTS).alias("part"), element.alias("j"))
    last = x.groupBy("job_id", "part").agg(F.max("n").alias("last"))
    x = x.join(last, ["job_id", "part"])
    line = F.concat(F.when((F.col("n") - 1) % FILE_ELEMENTS == 0, "[").otherwise(","), "j", F.when(F.col("n") == F.col("last"), "]").otherwise(""))
    x.repartition("job_id", "part").sortWithinPartitions("job_id", "part", "n").select("job_id", "part", line.alias("value")).write.partitionBy("job_id", "part").text(path)
    rows = intake.read_prompt_array(spark, path)
    from_path = lambda k, kind: F.regexp_extract("file", f"{k}=([^/]+)/", 1).cast(kind)
    return rows.select(from_path("job_id", "string").alias("job_id"), from_path("part", "long").alias("part"), "seq", "item_id", F.md5("prompt").alias("prompt_md5"), "failure_class", "message")


@query
def detect_format(spark, d):
    path = work_path(spark, "formats")
    p = X.prompts(spark, d).groupBy("job_id").agg(F.min("seq").alias("seq"))
    p.select("job_id", F.when(F.col("seq") % 2 == 0, F.concat(F.lit('  [{"id": "'), "job_id", F.lit('"}]'))).otherwise('{"prompt": "p"}').alias("value")).repartition("job_id").write.partitionBy("job_id").text(path)
    found = intake.detect_format(spark, f"{path}/*")
    return found.select(F.regexp_extract("file", "job_id=([^/]+)/", 1).alias("job_id"), "format")


@query
def prompts_cap(spark, d):
    return intake.cap_items(X.prompts(spark, d).select("job_id", "seq", "item_id"), 20)


@query
def request_validate(spark, d):
    r = X.table(spark, d, "documents").select(
        "doc_id",
        F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 300 END").alias("concurrency"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 7 % 5000 END").alias("max_tokens"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://host.example/x' WHEN 2 THEN 'ftp://host.example' WHEN 3 THEN 'not a url' WHEN 4 THEN 'http://h' ELSE 'HTTPS://host.example' END").alias("webhook_url"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END").alias("model"),
    )
    return S.validate_requests(r).select("doc_id", "model", F.col("max_tokens").cast("long").alias("max_tokens"), "valid", "reason")


@query
def resume_pending(spark, d):
    return O.pending_prompts(X.prompts(spark, d), _partial(spark, d)).select("job_id", "seq", "item_id")


@query
def conservation_audit(spark, d):
    return O.conservation(X.prompts(spark, d), _dirty(spark, d))


@query
def fatal_cutoff(spark, d):
    log = X.attempts(spark, d)
    cancels = spark.createDataFrame([("job-3", 500)], "job_id string, cancel_seq long")
    return O.apply_cutoffs(log.select("job_id", "seq", "item_id"), O.fatal_cutoffs(log), cancels)


@query
def job_counts(spark, d):
    return _counts(spark, d)


@query
def errors_by_class(spark, d):
    return R.errors_by_class(_outcomes(spark, d).withColumn("failure_class", F.col("final_class")))


@query
def usage_cost(spark, d):
    return R.usage_and_cost(_outcomes(spark, d))


@query
def final_status(spark, d):
    x = _jobs(spark, d).join(_counts(spark, d), "job_id", "left").na.fill(0, ["ingested", "succeeded", "failed"])
    return x.select("job_id", R.final_status().alias("status"))


@query
def progress_timing(spark, d):
    return R.progress(_jobs(spark, d).join(_counts(spark, d), "job_id")).select("job_id", "progress_pct", "throughput_rps", "eta_s")


@query
def job_report(spark, d):
    jobs = _jobs(spark, d).withColumn("abort_reason", F.lit(None).cast("string"))
    r = R.job_report(X.prompts(spark, d), _live(spark, d), _made(spark, d), jobs)
    errors = F.array_join(F.transform(F.map_entries("errors_by_class"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return r.select("job_id", "status", "ingested", "succeeded", "failed", "pending", "cost_usd", errors.alias("errors"), "throttle_events", "retries_issued", "submitted_at", "backpressure.retry_budget_remaining", "backpressure.observed_mean_latency_s", "backpressure.littles_law_optimal_concurrency")


@query
def attempt_summary(spark, d):
    return R.attempt_summary(_made(spark, d)).withColumn("mean_latency_s", F.round("mean_latency_s", 9))


@query
def latency_profile(spark, d):
    x = X.attempts(spark, d).select(F.when(F.day("ts").between(10, 13), "storm").otherwise("normal").alias("condition"), F.col("failure_class").alias("outcome"), "latency_s")
    return telemetry.latency_profile(x)


@query
def replay_counts(spark, d):
    return R.replay_counts(_dirty(spark, d))


@query
def latest_result(spark, d):
    return O.latest_result(_dirty(spark, d)).select("job_id", "item_id", "status", "log_seq")


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).where("status = 'success'").groupBy("job_id").agg((F.sum(S.cost_nanos()) / 1e9).alias("cost"))


@query
def spend_ledger(spark, d):
    x = _jobs(spark, d).join(_costs(spark, d), "job_id", "left")
    cost = F.coalesce("cost", F.lit(0.0)) * F.when(F.col("i") % 4 == 1, -1).otherwise(500)
    return R.spend_ledger(x.select("job_id", "submitted_at", cost.alias("cost_usd"))).select("job_id", "total_before", "total_after", "refused")


def _report(spark: SparkSession, d: str) -> DataFrame:
    x = _jobs(spark, d).join(_counts(spark, d), "job_id", "left").join(_costs(spark, d), "job_id", "left").na.fill(0, ["ingested", "succeeded", "failed", "in_flight", "cost"])
    return x.select("job_id", R.final_status().alias("status"), "ingested", "succeeded", "failed", "in_flight", F.lit(7).alias("throttle_events"), F.lit(3).alias("retries_issued"), F.lit(1.5).alias("rate_limit_rps"), F.col("cost").alias("cost_usd"))


@query
def metrics_rows(spark, d):
    return R.metrics_rows(_report(spark, d))


@query
def metrics_text(spark, d):
    return R.metrics_text(_report(spark, d)).select("value")


@query
def cost_projection(spark, d):
    ok = _outcomes(spark, d).where("status = 'success'").agg(F.avg(F.col("input_tokens").cast("double")).alias("avg_in"), F.avg(F.col("output_tokens").cast("double")).alias("avg_out"))
    return P.cost_projection(spark, averages=ok)


@query
def cost_ranking(spark, d):
    per = _outcomes(spark, d).where("status = 'success'").groupBy("model").agg((F.sum(S.cost_nanos()) / F.count("*") / 1e6).alias("usd_per_1000"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("usd_per_1000", "model"))
    return per.select("model", "usd_per_1000", place.cast("long").alias("place")).orderBy("place")


@query
def cost_variance(spark, d):
    return P.cost_variance(_outcomes(spark, d))


@query
def model_comparison(spark, d):
    return P.model_comparison(X.attempts(spark, d))


@query
def capacity_plan(spark, d):
    rates = X.attempts(spark, d).groupBy("job_id").agg(F.count("*").alias("items"), F.avg("latency_s").alias("mean_latency_s"))
    rates = rates.withColumn("concurrency", F.substring("job_id", 5, 9).cast("int") * 2 + 1)
    return P.capacity_plan(rates).drop("mean_latency_s")


@query
def header_drift(spark, d):
    return telemetry.header_drift(X.with_headers(X.attempts(spark, d)))


@query
def reset_lag(spark, d):
    return telemetry.reset_lag(X.with_headers(X.attempts(spark, d)))


@query
def attempt_outcomes(spark, d):
    return _outcomes(spark, d).select("job_id", "item_id", "attempt", "status", "final_class", "message")


@query
def retry_budget(spark, d):
    n = X.prompts(spark, d).groupBy("job_id").agg(F.count("*").alias("n"))
    return O.apply_retry_budget(X.draws(spark, d), n).select("job_id", "item_id", "attempt", "final_class", "message")


@query
def rolling_latency(spark, d):
    return telemetry.rolling_latency(X.attempts(spark, d)).select("job_id", "seq", "mean_latency_s")


@query
def rolling_failure_rate(spark, d):
    return telemetry.rolling_failure_rate(X.attempts(spark, d)).select("job_id", "seq", "failure_rate", "trips")


@query
def breaker_openings(spark, d):
    return telemetry.breaker_openings(X.attempts(spark, d))


@query
def spend_guard(spark, d):
    o = _outcomes(spark, d)
    n = o.groupBy("job_id").agg(F.count("*").alias("ingested"))
    return telemetry.spend_guard(o.join(n, "job_id"), cap=0.002, every=10)


@query
def spend_guard_cutoff(spark, d):
    o = _outcomes(spark, d)
    n = o.groupBy("job_id").agg(F.count("*").alias("ingested"))
    cuts = telemetry.spend_cutoffs(telemetry.spend_guard(o.join(n, "job_id"), cap=0.002, every=10), 0.002)
    none = spark.createDataFrame([], "job_id string, cancel_seq long")
    return O.apply_cutoffs(o.select("job_id", "seq", "item_id"), cuts, none)


@query
def quota_compliance(spark, d):
    return telemetry.quota_compliance(X.attempts(spark, d), 0.01, 1.5)


@query
def success_streaks(spark, d):
    return telemetry.success_streaks(X.attempts(spark, d))


@query
def merge_outcomes(spark, d):
    bad = intake.split_rows(intake.check_lines(_raw(spark, d))).where("failure_class is not null").select("item_id", "seq", "failure_class", "attempt")
    good = _outcomes(spark, d).select("item_id", "seq", F.col("final_class").alias("failure_class"), "attempt")
    return O.merge_outcomes(bad, good)


@query
def upsert_reports(spark, d):
    jobs = _jobs(spark, d).select("job_id", "i")
    old = jobs.select("job_id", F.lit("old").alias("state"), F.lit(1).alias("updated_at"))
    return logs.upsert_reports(old, jobs.where("i % 2 = 0").select("job_id", F.lit("new").alias("state"), F.lit(2).alias("updated_at")))


@query
def all_job_ids(spark, d):
    return R.all_job_ids(X.prompts(spark, d), X.attempts(spark, d))


@query
def export_filter(spark, d):
    reports = _jobs(spark, d).select("job_id", F.when(F.col("running"), "running").otherwise("partial").alias("status"))
    return logs.export_results(_outcomes(spark, d), reports, "errors").select("job_id", "item_id", F.col("final_class").alias("failure_class"))


@query
def export_array(spark, d):
    return logs.array_lines(_with_texts(spark, d)).select("value")


@query
def export_files(spark, d):
    """Errors of finished jobs as lines, read back."""
    reports = _jobs(spark, d).select("job_id", F.when(F.col("running"), "running").otherwise("partial").alias("status"))
    path = work_path(spark, "export")
    logs.write_export(logs.export_results(_with_texts(spark, d), reports, "errors"), path)
    return spark.read.text(path)


@query
def results_roundtrip(spark, d):
    path = work_path(spark, "results")
    logs.write_results(_with_texts(spark, d), path)
    return logs.read_results(spark, path).select("job_id", "item_id", "status", "attempt", "input_tokens", F.md5("response_text").alias("text_md5"), "failure_class", "message", "http_status")


@query
def job_record_json(spark, d):
    c = _counts(spark, d)
    return logs.from_record(logs.to_record(c), c.schema).select("job_id", "ingested", "succeeded", "failed")


class _DrawResponder:
    """Looks up what the offline columns say, as a responder would answer."""

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["o_status", "o_error", "o_malformed", "o_text", "o_in", "o_out"]].set_axis(["http_status", "transport_error", "malformed", "response_text", "input_tokens", "output_tokens"], axis=1).assign(latency_s=0.0)


def _called(prompts: DataFrame) -> DataFrame:
    """One attempt through the responder's interface."""
    names = {"http_status": "o_status", "transport_error": "o_error", "malformed": "o_malformed", "response_text": "o_text", "input_tokens": "o_in", "output_tokens": "o_out"}
    x = respond_offline(prompts).drop("latency_s", "headers", "ts").withColumnsRenamed(names)
    return run_attempts(x, _DrawResponder, slots=8, batch=64).drop(*names.values(), "granted_s")


@query
def run_attempts_once(spark, d):
    x = _called(X.prompts(spark, d).withColumn("attempt", F.lit(1)))
    return S.classify(x).select("item_id", "http_status", "malformed", "input_tokens", "output_tokens", "failure_class")


QUERIES["run_attempts"] = QUERIES.pop("run_attempts_once")


def _scored(results: DataFrame) -> DataFrame:
    return results.select("job_id", "item_id", "attempt", F.col("failure_class").alias("final_class"), "message", "http_status")


@query
def score_batch(spark, d):
    return _scored(score(X.prompts(spark, d), respond_offline, work_path(spark, "score")).results)


#: When the runs of _log begin, near the end of a day.
LOG_START = 1768435170.0


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The attempts of a run with times and headers, retries when they are due; as score gives them."""
    return score(X.prompts(spark, d), lambda df: respond_offline(df, timed=True), work_path(spark, "score"), Policy(start=LOG_START)).attempts


@query
def scored_log(spark, d):
    return _log(spark, d).select("job_id", "item_id", "attempt", "due_s", F.unix_micros("ts").alias("ts_us"), "latency_s", "http_status", "failure_class")


@query
def scored_rolling_latency(spark, d):
    return telemetry.rolling_latency(_log(spark, d)).select("job_id", "seq", "mean_latency_s")


@query
def scored_quota_compliance(spark, d):
    return telemetry.quota_compliance(_log(spark, d), 0.01, 1.5)


@query
def scored_header_drift(spark, d):
    return telemetry.header_drift(_log(spark, d))


@query
def scored_reset_lag(spark, d):
    return telemetry.reset_lag(_log(spark, d))


@query
def score_conversations(spark, d):
    """Prompts whose ids are made of two numbers."""
    return _scored(score(X.conversation_prompts(spark, d), respond_offline, work_path(spark, "score")).results)


@query
def score_capped(spark, d):
    """The first 20 prompts of each job, in slices of 3 and 30."""
    return _scored(score(X.prompts(spark, d), respond_offline, work_path(spark, "score"), Policy(max_items=20, chunk=3)).results)


@query
def score_cancelled(spark, d):
    """Two jobs are cancelled after the first attempts."""
    return _scored(score(X.prompts(spark, d), respond_offline, work_path(spark, "score"), Policy(cancelled=lambda step: ["src1", "src3"] if step == 0 else [])).results)


@query
def score_guarded(spark, d):
    """Jobs that spend too much by their first attempts are stopped."""
    return _scored(score(X.prompts(spark, d), respond_offline, work_path(spark, "score"), Policy(spend_cap=0.006)).results)


@query
def score_aborted(spark, d):
    """Some first attempts are refused for good, which stops their jobs."""

    def attempt(df: DataFrame) -> DataFrame:
        return respond_offline(df).withColumn("http_status", F.when(F.col("seq") % 211 == 3, 401).otherwise(F.col("http_status")))

    return _scored(score(X.prompts(spark, d), attempt, work_path(spark, "score")).results)


@query
def score_events(spark, d):
    """A prompt for each event: the larger table."""
    return _scored(score(X.event_prompts(spark, d), respond_offline, work_path(spark, "score")).results)


@query
def score_resumed(spark, d):
    """An earlier run's results and the rest of the prompts, which is a run with a budget of its own."""
    p = X.prompts(spark, d)
    first = score(p.where("seq % 3 = 1"), respond_offline, work_path(spark, "score")).results
    return _scored(resume(p, first, respond_offline, work_path(spark, "score")))


@query
def quota_per_minute(spark, d):
    return telemetry.quota_per_minute(X.attempts(spark, d)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def _written(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = work_path(spark, name)
    df.write.parquet(path)
    return path


@query
def stream_status(spark, d):
    """Several batches, of which each gives the jobs that it changed."""
    o = _outcomes(spark, d).select("job_id", "seq", "status", F.col("final_class").alias("failure_class"), "input_tokens", "output_tokens")
    src = work_path(spark, "results")
    o.repartitionByRange(6, "seq").write.parquet(src)
    out = feeds.last_rows(feeds.run_available(feeds.stream_status(feeds.stream_table(spark, src, 2)), work_path(spark, "stream"), "update"), "job_id")
    named = F.transform(F.array_sort(F.map_entries("errors")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumn("errors", F.array_join(named, ","))


@query
def stream_quota(spark, d):
    """Closed by a last row far ahead, so that the watermark passes every minute of the table."""
    log = X.attempts(spark, d).select("job_id", "ts", "http_status")
    src, parts, files = work_path(spark, "attempts"), 3, 2
    low, high = log.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    for i in range(parts if low is not None else 0):  # written one after another, so that batches come in the order of time
        at = F.floor((F.unix_micros("ts") - low) * parts / (high - low + 1))
        log.where(at == i).repartition(files).write.mode("append").parquet(src)
    end = log.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("job_id"), (F.col("ts") + F.make_interval(days=F.lit(2))).alias("ts"), F.lit(None).cast("int").alias("http_status"))
    end.write.mode("append").parquet(src)
    out = feeds.run_available(feeds.stream_quota_usage(feeds.stream_table(spark, src, files)), work_path(spark, "stream"))
    return out.where("job_id <> 'end'").select("job_id", F.col("minute").cast("timestamp_ntz").alias("minute"), "requests", "throttled")


@query
def stream_dedupe(spark, d):
    log = X.attempts(spark, d).select("job_id", "item_id", "ts")
    src = _written(spark, log.unionByName(log.where("hash(item_id) % 3 = 0")), "results")
    return feeds.run_available(feeds.stream_dedupe(feeds.stream_table(spark, src, 64), "60 days"), work_path(spark, "stream")).select("job_id", "item_id")


@query
def stream_prompts(spark, d):
    """Names of rows without an id hang on a hash of their file; their kind does not."""
    out = feeds.run_available(feeds.stream_prompts(spark, f"{_raw_files(spark, d)}/*"), work_path(spark, "stream"))
    return out.select("seq", F.regexp_replace("item_id", "^(offset|line)-.*", "$1").alias("item_id"), F.md5("prompt").alias("prompt_md5"), "failure_class")


@query
def stream_score(spark, d):
    """Streamed prompts, scored by batches; one row an item."""
    src = _written(spark, X.prompts(spark, d), "prompts")
    scored = feeds.stream_score(feeds.stream_table(spark, src, 64), lambda df, path: score(df, respond_offline, path).results, work_path(spark, "stream"))
    return _scored(scored)
