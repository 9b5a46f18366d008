"""Column expressions over attempts, responses and headers. Everything here is built in and stays in generated code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.schemas import DEFAULT_MAX_TOKENS, DEFAULT_MODEL, MALFORMED_CLASS, OTHER_CLASS, PRICES, RATE_HEADERS, RESET_HEADER, RETRY_SHARE, STATUS_CLASSES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_hash(*parts: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values alone, not on partitions or order."""
    key = F.concat_ws("|", F.lit(seed), *(col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _pair(p: tuple[str, int]) -> str:
    return f"named_struct('failure_class', '{p[0]}', 'max_attempts', {p[1]})"


def failure_class(http_status: str = "http_status", malformed: str = "malformed") -> Column:
    """struct(failure_class, max_attempts). A null status is a transport failure. One expression from text: a call to the JVM for
    each part of it would take longer than a small job."""
    known = " ".join(f"WHEN {http_status} = {code} THEN {_pair(p)}" for code, p in STATUS_CLASSES.items())
    return F.expr(f"CASE WHEN {http_status} = 200 AND coalesce({malformed}, false) THEN {_pair(MALFORMED_CLASS)} {known} ELSE {_pair(OTHER_CLASS)} END")


def classify(attempts: DataFrame) -> DataFrame:
    """attempts with failure_class and max_attempts; a map-only step."""
    return attempts.withColumn("_c", failure_class()).select("*", "_c.failure_class", "_c.max_attempts").drop("_c")


def is_fatal(c: str = "failure_class") -> Column:
    return F.expr(f"{c} IN ('fatal_auth', 'fatal_billing')")


def is_retryable(c: str = "failure_class") -> Column:
    return F.expr(f"{c} IN ('throttled', 'transient')")


def is_breaker_failure(c: str | Column = "failure_class") -> Column:
    """Throttling and invalid input say nothing about the service's health."""
    return col(c).isin("transient", "fatal_auth", "fatal_billing")


def parse_completion(df: DataFrame, status_col: str = "http_status", body_col: str = "body") -> DataFrame:
    """df with response_text, malformed, input_tokens, output_tokens of a chat completion; other statuses keep the body as text."""
    v = F.try_parse_json(col(body_col))
    df = df.withColumn("_v", F.when(col(status_col) == 200, v))
    content = F.try_variant_get("_v", "$.choices[0].message.content", "variant")
    whole = F.schema_of_variant(content) == "STRING"
    text = F.when(whole, F.try_variant_get("_v", "$.choices[0].message.content", "string"))
    ok = F.coalesce(whole, F.lit(False))
    fine = col(status_col) == 200

    def tokens(field: str) -> Column:
        return F.when(fine & ok, F.coalesce(F.try_variant_get("_v", f"$.usage.{field}", "long"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

    return df.select(
        "*",
        F.when(fine, F.coalesce(text, F.lit(""))).otherwise(col(body_col)).alias("response_text"),
        (fine & ~ok).alias("malformed"),
        tokens("prompt_tokens").alias("input_tokens"),
        tokens("completion_tokens").alias("output_tokens"),
    ).drop("_v")


def rate_headers(headers: str | Column = "headers") -> Column:
    """The rate-limit headers that are present."""
    return F.map_filter(col(headers), lambda k, _: k.isin(*RATE_HEADERS))


def reset_wait_s(reset: str | Column, now_s: str | Column, jitter: Column | None = None) -> Column:
    """Seconds to pause until the reset epoch, and a jitter in [0, 0.25); none for a missing, non-numeric or non-positive one."""
    at = col(reset).try_cast("double")
    wait = F.greatest(F.lit(0.0), at - col(now_s).cast("double"))
    return F.when(at > 0, wait if jitter is None else wait + 0.25 * jitter).otherwise(F.lit(0.0))


def backoff_envelope_s(attempt: str | Column = "attempt", base: float = 0.5, cap: float = 30.0) -> Column:
    """The longest delay after the attempt just made, counted from 1."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), col(attempt)))


def retry_due_s(seed: int = 0) -> Column:
    """Seconds of the epoch before which an item is not called again after an attempt of the log: the attempt's end, after a 429
    the pause until its reset header, and a back-off; the last two with jitter that hangs on the item and the attempt alone.
    Null where the attempt has no time."""
    end = F.unix_micros("ts") + F.round(F.coalesce("latency_s", F.lit(0.0)) * 1e6).cast("long")
    jitter = lambda kind: unit_hash("job_id", "item_id", "attempt", F.lit(kind), seed=seed)
    pause = reset_wait_s(F.try_element_at("headers", F.lit(RESET_HEADER)), end / 1e6, jitter("reset"))
    pause = F.when(F.col("failure_class") == "throttled", F.coalesce(pause, F.lit(0.0))).otherwise(F.lit(0.0))
    return (end + F.floor((pause + backoff_envelope_s() * jitter("backoff")) * 1e6)) / 1e6


def price(model: str | Column, side: int) -> Column:
    """Dollars per million tokens; unknown models cost what the default does."""
    known = F.create_map(*chain.from_iterable((F.lit(m), F.lit(p[side])) for m, p in PRICES.items()))
    return F.coalesce(F.try_element_at(known, F.coalesce(col(model), F.lit(DEFAULT_MODEL))), F.lit(PRICES[DEFAULT_MODEL][side]))


def cost_nanos(input_tokens: str = "input_tokens", output_tokens: str = "output_tokens", model: str = "model") -> Column:
    """Billionths of a dollar: whole numbers, as prices are whole thousandths a million, so that sums are exact in any order."""

    def nanos(side: int) -> str:
        known = " ".join(f"WHEN '{m}' THEN {round(p[side] * 1000)}" for m, p in PRICES.items())
        return f"(CASE {model} {known} ELSE {round(PRICES[DEFAULT_MODEL][side] * 1000)} END)"

    return F.expr(f"CAST({input_tokens} * {nanos(0)} + {output_tokens} * {nanos(1)} AS BIGINT)")


def cost_usd(input_tokens: str = "input_tokens", output_tokens: str = "output_tokens", model: str = "model") -> Column:
    return cost_nanos(input_tokens, output_tokens, model) / 1e9


def retry_limit(ingested: str | Column, share: float = RETRY_SHARE) -> Column:
    return F.greatest(F.lit(1), F.floor(col(ingested) * F.lit(share))).cast("long")


def iso_utc(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def validate_requests(df: DataFrame) -> DataFrame:
    """df with model and max_tokens filled in, valid and reason (the first fault)."""
    hook = F.col("webhook_url")
    bad_hook = hook.isNotNull() & ~F.coalesce(F.lower(F.try_parse_url(hook, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(hook, F.lit("HOST"))) > 0), F.lit(False))
    reason = (
        F.when(F.col("concurrency").isNotNull() & ~F.col("concurrency").between(1, 256), "concurrency must be 1..256")
        .when(F.col("max_tokens").isNotNull() & ~F.col("max_tokens").between(1, 4096), "max_tokens must be 1..4096")
        .when(bad_hook, "webhook_url must be http(s) with a host")
    )
    return df.withColumns({"reason": reason, "valid": reason.isNull(), "model": F.coalesce("model", F.lit(DEFAULT_MODEL)), "max_tokens": F.coalesce("max_tokens", F.lit(DEFAULT_MAX_TOKENS))})
