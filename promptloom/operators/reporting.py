"""Per-job reports: counts, status, usage, timing, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.scalar import cost_nanos, iso_utc, retry_limit
from promptloom.operators.planning import littles_law
from promptloom.schemas import LEDGER_CAP


def job_counts(prompts: DataFrame, results: DataFrame, dispatched: DataFrame | None = None) -> DataFrame:
    """job_id, ingested, succeeded, failed, in_flight, pending. dispatched (job_id, item_id) tells items on their way; without
    it, everything unfinished is pending. One aggregation by job over the union of narrow rows."""
    zero = F.lit(0).cast("long")
    parts = prompts.select("job_id", F.lit(1).cast("long").alias("i"), zero.alias("s"), zero.alias("f"), zero.alias("d"))
    parts = parts.unionByName(results.select("job_id", zero.alias("i"), (F.col("status") == "success").cast("long").alias("s"), (F.col("status") != "success").cast("long").alias("f"), zero.alias("d")))
    if dispatched is not None:
        parts = parts.unionByName(dispatched.select("job_id", zero.alias("i"), zero.alias("s"), zero.alias("f"), F.lit(1).cast("long").alias("d")))
    t = parts.groupBy("job_id").agg(*(F.sum(c).alias(c) for c in "isfd"))
    left = F.greatest(F.col("i") - F.col("s") - F.col("f"), zero)
    flying = F.least(F.greatest(F.col("d") - F.col("s") - F.col("f"), zero), left)
    return t.select("job_id", F.col("i").alias("ingested"), F.col("s").alias("succeeded"), F.col("f").alias("failed"), flying.alias("in_flight"), (left - flying).alias("pending"))


def errors_by_class(results: DataFrame) -> DataFrame:
    """job_id, failure_class, errors."""
    return results.where("status <> 'success'").groupBy("job_id", "failure_class").agg(F.count("*").alias("errors"))


def errors_map(results: DataFrame) -> DataFrame:
    """job_id, errors_by_class: a map in the order of classes; a job has at most as many entries as there are classes."""
    by = errors_by_class(results).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("failure_class", "errors"))).alias("e"))
    return by.select("job_id", F.map_from_entries("e").alias("errors_by_class"))


def usage_and_cost(results: DataFrame) -> DataFrame:
    """job_id, input_tokens, output_tokens, cost_usd, avg_tokens over successes; results have model."""
    ok = results.where("status = 'success'")
    return ok.groupBy("job_id").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum(cost_nanos()) / 1e9).alias("cost_usd"),
        F.avg((F.col("input_tokens") + F.col("output_tokens")).cast("double")).alias("avg_tokens"),
    )


def final_status() -> Column:
    """Of counts with cancelled and aborted flags. An empty job has succeeded."""
    return (
        F.when(F.col("cancelled"), "cancelled")
        .when(F.col("aborted"), "failed")
        .when(F.col("ingested") == 0, "succeeded")
        .when(F.col("failed") == 0, "succeeded")
        .when(F.col("succeeded") == 0, "failed")
        .otherwise("partial")
    )


def progress(counts: DataFrame) -> DataFrame:
    """counts with elapsed_s and running -> progress_pct, throughput_rps, eta_s. The time left counts pending items twice, as the
    status page always has."""
    done = F.col("succeeded") + F.col("failed")
    rate = F.when(F.col("elapsed_s") > 0, done / F.col("elapsed_s")).otherwise(F.lit(0.0))
    left = F.greatest(F.lit(0), F.col("ingested") - done) + F.col("pending")
    return counts.select(
        "*",
        F.round(F.when(F.col("ingested") > 0, done / F.col("ingested") * 100).otherwise(F.lit(0.0)), 1).alias("progress_pct"),
        F.round(rate, 3).alias("throughput_rps"),
        F.round(F.when(F.col("running") & (rate > 0), left / rate), 1).alias("eta_s"),
    )


def attempt_summary(classified: DataFrame) -> DataFrame:
    """job_id, attempts, throttle_events, retries_issued, items, max_attempts_of_item, mean_latency_s (of successes, from whole
    microseconds). A retry is an attempt after the first."""
    good = F.col("failure_class") == "success"
    per = classified.groupBy("job_id", "item_id").agg(
        F.count("*").alias("a"),
        F.count_if(F.col("failure_class") == "throttled").alias("t"),
        F.count_if(good).alias("g"),
        F.sum(F.when(good, F.round(F.col("latency_s") * 1e6).cast("long"))).alias("us"),
    )
    return per.groupBy("job_id").agg(
        F.sum("a").alias("attempts"),
        F.sum("t").alias("throttle_events"),
        (F.sum("a") - F.count("*")).alias("retries_issued"),
        F.count("*").alias("items"),
        F.max("a").alias("max_attempts_of_item"),
        (F.sum("us") / F.sum("g") / 1e6).alias("mean_latency_s"),
    )


def job_report(prompts: DataFrame, results: DataFrame, classified: DataFrame, jobs: DataFrame) -> DataFrame:
    """One status row a job: jobs has job_id, elapsed_s, running, cancelled, aborted, abort_reason and perhaps submitted_at,
    started_at, finished_at, which are written as UTC text; results have model. Every part is aggregated by job before they are
    joined on it."""
    counts = jobs.join(job_counts(prompts, results), "job_id", "left").na.fill(0, ["ingested", "succeeded", "failed", "in_flight", "pending"])
    status = F.when(F.col("running"), "running").otherwise(final_status())
    x = progress(counts).withColumn("status", status)
    x = x.join(usage_and_cost(results), "job_id", "left").join(errors_map(results), "job_id", "left").join(attempt_summary(classified), "job_id", "left")
    none = F.create_map().cast("map<string,bigint>")
    x = x.na.fill(0, ["input_tokens", "output_tokens", "cost_usd", "throttle_events", "retries_issued", "mean_latency_s"])
    stamps = {c: iso_utc(c) for c in ("submitted_at", "started_at", "finished_at") if c in jobs.columns}
    return x.withColumns({"errors_by_class": F.coalesce("errors_by_class", none), "backpressure": backpressure(), **stamps}).drop("mean_latency_s")


def backpressure() -> Column:
    """What logged attempts tell about the service: 429s, retries, retries left, mean latency of successes, and the requests in
    flight that would keep up the job's throughput at it."""
    return F.struct(
        F.col("throttle_events").alias("throttle_events_429"),
        F.col("retries_issued"),
        F.greatest(F.lit(0).cast("long"), retry_limit("ingested") - F.col("retries_issued")).alias("retry_budget_remaining"),
        F.round("mean_latency_s", 4).alias("observed_mean_latency_s"),
        littles_law("throughput_rps", "mean_latency_s").alias("littles_law_optimal_concurrency"),
    )


def replay_counts(log: DataFrame) -> DataFrame:
    """succeeded, failed (every other row), distinct items of a result log, by job."""
    return log.groupBy("job_id").agg(F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(~F.coalesce(F.col("status") == "success", F.lit(False))).alias("failed"), F.count_distinct("item_id").alias("items"))


def spend_ledger(reports: DataFrame, prior: float = 0.0, cap: float = LEDGER_CAP) -> DataFrame:
    """reports (a row for each run: job_id, submitted_at, cost_usd) with total_before, total_after, refused. Negative costs count
    as nothing. Runs are few, and one after another by nature."""
    spent = F.greatest(F.lit(0.0), F.col("cost_usd"))
    w = Window.partitionBy(F.lit(0)).orderBy("submitted_at", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    after = F.lit(prior) + F.sum(spent).over(w)
    return reports.select("*", F.round(after - spent, 6).alias("total_before"), F.round(after, 6).alias("total_after"), (F.round(after - spent, 6) >= cap).alias("refused"))


#: Metric, after the prefix -> (type, help, column of the report). Names and types are fixed values.
METRICS = {
    "job_ingested_total": ("counter", "Prompts taken in.", "ingested"),
    "job_succeeded_total": ("counter", "Prompts with a success.", "succeeded"),
    "job_failed_total": ("counter", "Prompts with a final error.", "failed"),
    "job_in_flight": ("gauge", "Prompts on their way.", "in_flight"),
    "job_throttle_events_total": ("counter", "Responses with status 429.", "throttle_events"),
    "job_retries_issued_total": ("counter", "Attempts after the first.", "retries_issued"),
    "job_current_rate_limit_rps": ("gauge", "Requests a second that the rate policy allows.", "rate_limit_rps"),
    "job_estimated_cost_usd": ("gauge", "Dollars spent.", "cost_usd"),
}


def metrics_rows(reports: DataFrame, prefix: str = "promptloom") -> DataFrame:
    """metric, kind, job_id, status, value: eight rows a job. prefix names the service whose metrics these are."""
    rows = [F.struct(F.lit(f"{prefix}_{m}").alias("metric"), F.lit(kind).alias("kind"), F.lit(text).alias("help"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for m, (kind, text, c) in METRICS.items()]
    return reports.select("job_id", "status", F.explode(F.array(*rows)).alias("m")).select("m.metric", "m.kind", "m.help", "job_id", "status", "m.value")


def metrics_text(reports: DataFrame, prefix: str = "promptloom") -> DataFrame:
    """at, by, value: the lines of the text exposition, in order of at and by."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate(METRICS) for x in (f"{prefix}_{m}", i)])
    rows = metrics_rows(reports, prefix)
    digits = F.regexp_replace(F.format_string("%.9f", "value"), r"(\.\d+?)0+$", "$1")  # whole billionths, without an exponent
    line = F.format_string('%s{job_id="%s",status="%s"} %s', "metric", "job_id", "status", digits)
    body = rows.select(order[F.col("metric")].alias("at"), F.concat(F.lit("2"), "job_id").alias("by"), line.alias("value"))
    heads = reports.sparkSession.createDataFrame([(i, str(k), t) for i, (m, (kind, text, _)) in enumerate(METRICS.items()) for k, t in enumerate((f"# HELP {prefix}_{m} {text}", f"# TYPE {prefix}_{m} {kind}"))], "at int, by string, value string")
    return body.unionByName(heads).orderBy("at", "by")


def all_job_ids(stored: DataFrame, live: DataFrame) -> DataFrame:
    return stored.select("job_id").union(live.select("job_id")).distinct()
