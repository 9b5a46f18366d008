"""Cost and capacity planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.scalar import col, cost_nanos, price
from promptloom.schemas import PRICES


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, usd_in double, usd_out double")


def cost_projection(spark: SparkSession, sizes: tuple[int, ...] = (1_000, 10_000, 100_000, 500_000), averages: DataFrame | None = None, avg_in: float = 150, avg_out: float = 200) -> DataFrame:
    """model, items, cost_usd, cheapest first by the cost of the first size. averages (one row: avg_in, avg_out) are measured."""
    m = models(spark)
    m = m.withColumns({"avg_in": F.lit(float(avg_in)), "avg_out": F.lit(float(avg_out))}) if averages is None else m.join(F.broadcast(averages.select("avg_in", "avg_out").limit(1)))
    per = F.col("avg_in") / 1e6 * F.col("usd_in") + F.col("avg_out") / 1e6 * F.col("usd_out")
    x = m.select("model", per.alias("per"), F.explode(F.array(*(F.lit(n) for n in sizes))).alias("items"))
    return x.select("model", F.col("items").cast("long").alias("items"), F.round(F.col("per") * F.col("items"), 6).alias("cost_usd")).orderBy("cost_usd", "model")


def littles_law(rps: str | Column, latency_s: str | Column) -> Column:
    """Requests in flight that saturate a rate."""
    return F.when(col(latency_s) <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(col(rps) * col(latency_s)))).cast("long")


def capacity_plan(rates: DataFrame, rpm: float = 120, tpm: float = 500_000) -> DataFrame:
    """rates (job_id, items, mean_latency_s, concurrency) with floor_hours, tokens_crossover, in_flight, start_guess,
    over_provisioned."""
    rps = F.lit(rpm / 60)
    need = littles_law(rps, "mean_latency_s")
    return rates.select(
        "*",
        F.round(F.col("items") / rpm / 60, 6).alias("floor_hours"),
        F.round(F.lit(tpm / rpm), 6).alias("tokens_crossover"),
        need.alias("in_flight"),
        F.greatest(F.lit(2), F.ceil(rps * 2)).cast("long").alias("start_guess"),
        (F.col("concurrency") > 2 * need).alias("over_provisioned"),
    )


def cost_variance(results: DataFrame, avg_in: float = 150, avg_out: float = 200) -> DataFrame:
    """job_id, model, items, estimated_usd, actual_usd, ratio, tokens_per_item over successes."""
    ok = results.where("status = 'success'").groupBy("job_id", "model").agg(F.count("*").alias("items"), (F.sum(cost_nanos()) / 1e9).alias("actual"), F.avg((F.col("input_tokens") + F.col("output_tokens")).cast("double")).alias("tokens"))
    guess = F.col("items") * (F.lit(avg_in / 1e6) * price("model", 0) + F.lit(avg_out / 1e6) * price("model", 1))
    return ok.select("job_id", "model", "items", F.round(guess, 6).alias("estimated_usd"), F.col("actual").alias("actual_usd"), F.round(F.col("actual") / guess, 6).alias("ratio"), F.col("tokens").alias("tokens_per_item"))


def model_comparison(attempts: DataFrame) -> DataFrame:
    """model, items, usable_share, avg_input, avg_output, capped_share, usd_per_1000: usable models first, then by cost."""
    usable = (F.col("http_status") == 200) & ~F.coalesce(F.col("malformed"), F.lit(False))
    share = F.avg(F.coalesce(usable, F.lit(False)).cast("double"))
    x = attempts.groupBy("model").agg(
        F.count("*").alias("items"),
        share.alias("usable_share"),
        F.avg(F.when(usable, F.col("input_tokens").cast("double"))).alias("avg_input"),
        F.avg(F.when(usable, F.col("output_tokens").cast("double"))).alias("avg_output"),
        F.avg(F.when(usable, (F.col("output_tokens") == F.col("max_tokens")).cast("double"))).alias("capped_share"),
        (F.sum(F.when(usable, cost_nanos())) / F.count_if(F.coalesce(usable, F.lit(False))) / 1e6).alias("usd_per_1000"),
    )
    return x.orderBy(F.desc(F.col("usable_share") > 0), "usd_per_1000", "model")
