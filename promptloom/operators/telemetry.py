"""Latency, throttling and quota studies over an attempt log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.scalar import cost_nanos, is_breaker_failure, rate_headers
from promptloom.operators.ordered import ORDER, by_hour, numbered, percentiles, rolling, running_totals
from promptloom.schemas import JOB_SPEND_CAP


def latency_profile(classified: DataFrame, by: tuple[str, ...] = ("condition", "outcome"), exact: bool = True) -> DataFrame:
    """by, n, p50, p95, mean of latency_s. Exact percentiles are found by ranks (ordered.percentiles), the others by a bounded
    sketch."""
    rest = [F.count("*").alias("n"), F.round(F.avg("latency_s"), 6).alias("mean")]
    if not exact:
        return classified.groupBy(*by).agg(*rest, *(F.round(F.percentile_approx("latency_s", p, 10_000), 6).alias(k) for k, p in (("p50", 0.5), ("p95", 0.95)))).select(*by, "n", "p50", "p95", "mean")
    found = _beside(classified.groupBy(*by).agg(*rest), percentiles(classified, by, "latency_s", {"p50": 0.5, "p95": 0.95}), by)
    return found.select(*by, "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean")


def _beside(groups: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """groups with the other columns of more; null keys are equal."""
    more = more.withColumnsRenamed({k: f"_r_{k}" for k in by})
    met = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by))
    return groups.join(more, met, "left").drop(*(f"_r_{k}" for k in by))


def rolling_latency(classified: DataFrame, size: int = 200) -> DataFrame:
    """Successes with the mean latency of their job's last `size` successes, from whole microseconds, whose sums are exact."""
    ok = numbered(classified.where("failure_class = 'success'"), ["job_id"], by_hour(), ORDER)
    ok = ok.withColumn("_us", F.round(F.col("latency_s") * 1e6).cast("long"))
    out = rolling(ok, ["job_id"], "n", size, {"_sum": F.sum("_us"), "_rows": F.count("*")})
    return out.withColumn("mean_latency_s", F.col("_sum") / F.col("_rows") / 1e6).drop("_us", "_sum", "_rows")


def rolling_failure_rate(classified: DataFrame, size: int = 100, least: int = 10, threshold: float = 0.5) -> DataFrame:
    """Attempts with the failed share of their job's last `size`, and whether a breaker would trip."""
    x = numbered(classified, ["job_id"], by_hour(), ORDER).withColumn("_f", is_breaker_failure().cast("long"))
    out = rolling(x, ["job_id"], "n", size, {"failures": F.sum("_f"), "outcomes": F.count("*")})
    rate = F.col("failures") / F.col("outcomes")
    return out.withColumns({"failure_rate": rate, "trips": (F.col("outcomes") >= least) & (rate > threshold)}).drop("_f")


def breaker_openings(classified: DataFrame, size: int = 100, least: int = 10, threshold: float = 0.5) -> DataFrame:
    """job_id, seq, failure_rate of the attempts at which a job's rolling failure rate comes to trip a breaker: the attempt before
    them did not. A comparison of neighbours by number, without a state that passes from row to row."""
    x = rolling_failure_rate(classified, size, least, threshold).select("job_id", "seq", "n", "failure_rate", "trips")
    before = x.where("not trips").select(F.col("job_id").alias("_job"), (F.col("n") + 1).alias("_n"))
    return x.where("trips").join(before, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("n") == F.col("_n")), "left_semi").select("job_id", "seq", "failure_rate")


def spend_guard(outcomes: DataFrame, cap: float = JOB_SPEND_CAP, every: int = 50) -> DataFrame:
    """job_id, seq, done, cost_so_far, projected of each job's first breach: after a success that makes the number of outcomes a
    multiple of `every`, when the cost or its projection to all items reaches the cap. outcomes: job_id, seq, status, model,
    tokens, ingested; seq is the order of completion."""
    x = running_totals(
        outcomes,
        ["job_id"],
        F.floor(F.col("seq") / 100_000),
        ["seq"],
        {"done": F.lit(1).cast("long"), "nanos": F.when(F.col("status") == "success", cost_nanos()).otherwise(0)},
    )
    x = x.withColumn("cost_so_far", F.col("nanos") / 1e9).withColumn("projected", F.col("cost_so_far") / F.col("done") * F.greatest("ingested", "done"))
    hit = x.where((F.col("status") == "success") & (F.col("done") % every == 0) & ((F.col("cost_so_far") >= cap) | (F.col("projected") >= cap)))
    first = hit.groupBy("job_id").agg(F.min_by(F.struct("seq", "done", "cost_so_far", "projected"), "seq").alias("b"))
    return first.select("job_id", "b.seq", "b.done", "b.cost_so_far", "b.projected")


def spend_cutoffs(breaches: DataFrame, cap: float = JOB_SPEND_CAP) -> DataFrame:
    """Breaches of spend_guard as cut-offs of jobs (outcomes.apply_cutoffs). What comes after is classed fatal_auth, as ever;
    abort_reason says why."""
    reason = spend_reason(F.col("cost_so_far"), F.col("projected"), cap)
    return breaches.select("job_id", F.col("seq").alias("cutoff_seq"), F.lit("fatal_auth").alias("failure_class"), F.lit(None).cast("int").alias("http_status"), reason.alias("abort_reason"))


def spend_reason(cost: Column, projected: Column, cap: float) -> Column:
    """Fixed text: why a job stopped that reached its cap."""
    return F.format_string(f"spend guard: cost $%.4f / projected $%.4f >= cap ${cap}", cost, projected)


def quota_compliance(grants: DataFrame, rate: float, capacity: float, windows: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """job_id, window_s, checked, most, allowed, violations: for every grant at t, the grants in [t, t + window) are at most
    rate * window + capacity. Hours are windows of their own, each with the first seconds of the next one."""
    reach = max(windows)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(t / F.lit(3_600_000_000))
    x = grants.select("job_id", t.alias("t"), own.alias("own"))
    early = F.col("t") % 3_600_000_000 < reach * 1_000_000
    x = x.withColumn("hour", F.explode(F.when(early, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    for w in windows:
        frame = Window.partitionBy("job_id", "hour").orderBy("t").rangeBetween(0, w * 1_000_000 - 1)
        x = x.withColumn(f"w{w}", F.count("*").over(frame))
    x = x.where("own = hour")
    rows = F.array(*(F.struct(F.lit(w).alias("window_s"), F.col(f"w{w}").alias("n"), F.lit(rate * w + capacity).alias("allowed")) for w in windows))
    x = x.select("job_id", F.explode(rows).alias("r")).select("job_id", "r.*")
    return x.groupBy("job_id", "window_s", "allowed").agg(F.count("*").alias("checked"), F.max("n").alias("most"), F.count_if(F.col("n") > F.col("allowed")).alias("violations"))


def success_streaks(classified: DataFrame, every: int = 50) -> DataFrame:
    """job_id, streak (429s before it), successes, increases: runs of successes that only 429s break; each `every`-th success of
    a run raises the rate."""
    hit = (F.col("failure_class") == "throttled").cast("long")
    x = running_totals(classified.select("job_id", *ORDER, "failure_class"), ["job_id"], by_hour(), ORDER, {"streak": hit})
    runs = x.where("failure_class = 'success'").groupBy("job_id", "streak").agg(F.count("*").alias("successes"))
    return runs.withColumn("increases", F.floor(F.col("successes") / every).cast("long"))


def header_drift(attempts: DataFrame, unit: str = "tokens-per-day") -> DataFrame:
    """job_id, limits (distinct), first, last and least remaining, rises (remaining above its predecessor's), from attempts with
    headers in time order. A bucket's edge values stand for it, so neighbours across hours are compared, too."""
    h = attempts.select("job_id", *ORDER, rate_headers().alias("h")).select("job_id", *ORDER, F.try_element_at("h", F.lit(f"x-ratelimit-remaining-{unit}")).try_cast("long").alias("left"), F.try_element_at("h", F.lit(f"x-ratelimit-limit-{unit}")).try_cast("long").alias("limit"))
    h = h.where("left is not null").withColumn("hour", by_hour())
    w = Window.partitionBy("job_id", "hour").orderBy(*ORDER)
    h = h.withColumn("rise", (F.col("left") > F.lag("left").over(w)).cast("long"))
    at = F.struct(*ORDER)
    per = h.groupBy("job_id", "hour").agg(F.min_by("left", at).alias("first"), F.max_by("left", at).alias("last"), F.min("left").alias("least"), F.sum("rise").alias("rises"), F.collect_set("limit").alias("limits"))
    edge = Window.partitionBy("job_id").orderBy("hour")
    per = per.withColumn("edge_rise", F.coalesce((F.col("first") > F.lag("last").over(edge)).cast("long"), F.lit(0)))
    return per.groupBy("job_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("limits")))).cast("long").alias("limits"),
        F.min_by("first", "hour").alias("first_remaining"),
        F.max_by("last", "hour").alias("last_remaining"),
        F.min("least").alias("least_remaining"),
        (F.coalesce(F.sum("rises"), F.lit(0)) + F.sum("edge_rise")).alias("rises"),
    )


def reset_lag(attempts: DataFrame) -> DataFrame:
    """job_id, n, median, least and most seconds from a 429 to its reset header, and the share in the past."""
    h = rate_headers()
    lag = F.try_element_at(h, F.lit("x-ratelimit-reset-requests")).try_cast("double") - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    x = attempts.where("http_status = 429").select("job_id", lag.alias("lag")).where("lag is not null")
    rest = x.groupBy("job_id").agg(F.count("*").alias("n"), F.round(F.min("lag"), 6).alias("least"), F.round(F.max("lag"), 6).alias("most"), F.round(F.avg((F.col("lag") < 0).cast("double")), 6).alias("past_share"))
    found = _beside(rest, percentiles(x, ["job_id"], "lag", {"median": 0.5}), ["job_id"])
    return found.select("job_id", "n", F.round("median", 6).alias("median"), "least", "most", "past_share")


def quota_per_minute(classified: DataFrame) -> DataFrame:
    """job_id, minute, requests, throttled: tumbling minutes."""
    return classified.groupBy("job_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("requests"), F.count_if(F.col("http_status") == 429).alias("throttled"))
