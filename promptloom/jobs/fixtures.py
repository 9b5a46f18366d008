"""The driver's tables in the shapes of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.scalar import classify

#: What answers offline, and the share of attempts that get it; the others are answered well.
SHARES = {"error": 0.0, "timeout": 0.05, "429": 0.2, "500": 0.2, "400": 0.05, "malformed": 0.05}
SEED = 7


def shares(**changed: float) -> dict[str, tuple[float, float]]:
    """kind -> the part of [0, 1) that brings it."""
    out, at = {}, 0.0
    for kind, share in (SHARES | changed).items():
        out[kind] = (round(at, 9), round(at + share, 9))
        at += share
    return out


def respond_offline(df: DataFrame, seed: int = SEED, attempt: str = "attempt", chars: Column | None = None, timed: bool = False, **changed: float) -> DataFrame:
    """df (prompts with an attempt) with RESPONSES, for queries and tests without a network: one number in [0, 1), which hangs on
    the seed, the item and the attempt alone, tells the kind of answer. timed: with a latency and rate headers, each call a few
    seconds after it is due; else calls begin when due and take no time. changed: other shares, as p_429=0.5."""
    def u(kind: str) -> str:
        return f"(CAST(conv(substring(md5(concat_ws('|', '{seed}', item_id, {attempt}, '{kind}')), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D)"

    parts = shares(**{k.removeprefix("p_"): v for k, v in changed.items()})
    kind = " ".join(f"WHEN _u >= {lo}D AND _u < {hi}D THEN '{k}'" for k, (lo, hi) in parts.items())
    x = df.withColumn("_u", F.expr(u("kind"))).withColumn("_kind", F.expr(f"CASE {kind} ELSE 'good' END"))
    ok = "_kind IN ('good', 'malformed')"
    half = "greatest(1, max_tokens div 2)"
    x = x.withColumns(
        {
            "http_status": F.expr(f"CASE WHEN {ok} THEN 200 WHEN _kind IN ('429', '500', '400') THEN CAST(_kind AS INT) END"),
            "transport_error": F.expr("CASE _kind WHEN 'error' THEN 'offline' WHEN 'timeout' THEN 'timeout' END"),
            "malformed": F.expr("_kind = 'malformed'"),
            "response_text": F.expr("CASE _kind WHEN 'good' THEN concat('reply to ', item_id) WHEN 'malformed' THEN '' END"),
            "input_tokens": F.when(F.expr(ok), F.greatest(F.lit(1), F.floor((F.length("prompt") if chars is None else chars) / 4))).otherwise(F.lit(0)).cast("long"),
            "output_tokens": F.expr(f"CASE WHEN {ok} THEN least(CAST(max_tokens AS BIGINT), {half} + floor({u('length')} * (max_tokens - {half} + 1))) ELSE 0L END"),
            "latency_s": F.expr(f"round(0.2D + {u('time')}, 6)") if timed else F.lit(0.0),
            "headers": F.lit(None).cast("map<string,string>"),
            "ts": F.expr(("timestamp_micros(CAST(round(due_s * 1000000) AS BIGINT)" + (" + seq % 100003 * 1000" if timed else "") + ")") if "due_s" in df.columns else "CAST(NULL AS TIMESTAMP)"),
        }
    ).drop("_u", "_kind")
    return with_headers(x) if timed else x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: a job for each source."""
    model = F.expr("CASE WHEN doc_id % 50 = 7 THEN 'unlisted' WHEN lang = 'de' THEN 'openai-gpt-oss-20b' WHEN lang = 'es' THEN 'gemma-4-31B-it' WHEN lang = 'fr' THEN 'llama-4-maverick' ELSE 'mistral-3-14B' END")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("doc-"), "doc_id").alias("item_id"), F.col("text").alias("prompt"), model.alias("model"), F.lit(128).alias("max_tokens"))


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: a prompt for each turn of a user, named by conversation and turn; five jobs."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    name = F.concat_ws("-", "conv_id", "turn")
    return c.select(F.concat(F.lit("conv-"), F.col("conv_id") % 5).alias("job_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), name.alias("item_id"), F.col("text").alias("prompt"), F.lit("mistral-3-14B").alias("model"), F.lit(128).alias("max_tokens"))


def event_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a prompt each, in eight jobs."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("job-"), F.col("user_id") % 8).alias("job_id"), F.col("event_id").alias("seq"), F.concat(F.lit("evt-"), "event_id").alias("item_id"), F.col("event_type").alias("prompt"), F.lit("mistral-3-14B").alias("model"), F.lit(128).alias("max_tokens"))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts 1..8 of every prompt by the offline responder, classified; without texts."""
    x = prompts(spark, sf_dir).withColumn("chars", F.length("prompt")).drop("prompt")
    x = x.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return classify(respond_offline(x, chars=F.col("chars")).drop("chars", "response_text").withColumn("latency_s", F.col("attempt") * 0.1))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: an attempt log of eight jobs with a failure storm on days 10 to 13."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.expr("CAST(replace(replace(props, '{\"k\": ', ''), '}', '') AS INT)").alias("k"))
    status = F.expr(
        "CASE WHEN day(ts) BETWEEN 10 AND 13 AND event_type IN ('click', 'view', 'error') THEN 503 WHEN event_type <> 'error' THEN 200 "
        "WHEN k < 40 THEN 429 WHEN k < 70 THEN 500 WHEN k < 85 THEN 502 WHEN k < 92 THEN 400 WHEN k < 95 THEN 408 WHEN k < 97 THEN NULL WHEN k < 98 THEN 418 WHEN k < 99 THEN 402 ELSE 401 END"
    )
    x = e.select(
        F.concat(F.lit("job-"), F.col("user_id") % 8).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("evt-"), "event_id").alias("item_id"),
        F.lit(1).alias("attempt"),
        "ts",
        (F.col("value") / 100).alias("latency_s"),
        status.alias("http_status"),
        ((F.col("event_type") == "signup") & (F.col("k") < 10)).alias("malformed"),
        (F.col("k") + 1).cast("long").alias("input_tokens"),
        (F.col("event_id") % 128 + 1).alias("output_tokens"),
        F.lit(128).alias("max_tokens"),
        F.expr("CASE event_id % 6 WHEN 0 THEN 'mistral-3-14B' WHEN 1 THEN 'openai-gpt-oss-20b' WHEN 2 THEN 'openai-gpt-oss-120b' WHEN 3 THEN 'gemma-4-31B-it' WHEN 4 THEN 'llama-4-maverick' ELSE 'unlisted' END").alias("model"),
    )
    return classify(x)


def with_headers(log: DataFrame) -> DataFrame:
    """Rate headers of 429 and 200 rows."""
    reset = F.when(F.col("seq") % 50 == 0, "soon").otherwise((F.floor(F.unix_micros("ts") / 1_000_000) + F.col("seq") % 7 - 2).cast("string"))
    limited = F.create_map(F.lit("x-ratelimit-limit-requests"), F.lit("120"), F.lit("x-ratelimit-remaining-requests"), F.lit("0"), F.lit("x-ratelimit-reset-requests"), reset, F.lit("x-request-id"), F.col("item_id"))
    left = (800_000_000 - F.col("seq") + 3 * (F.col("seq") % 10)).cast("string")
    minute = F.when(F.day("ts") < 15, "500000").otherwise("750000")
    fine = F.create_map(F.lit("x-ratelimit-remaining-tokens-per-day"), left, F.lit("x-ratelimit-limit-tokens-per-day"), minute, F.lit("server"), F.lit("edge"))
    return log.withColumn("headers", F.when(F.col("http_status") == 429, limited).when(F.col("http_status") == 200, fine))
