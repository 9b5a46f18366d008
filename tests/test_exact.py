"""Exact percentiles by ranks, and result logs that hold a run once."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from promptloom.operators import telemetry
from promptloom.operators.ordered import percentiles
from promptloom.schemas import RESULTS
from promptloom.sources.results import read_results, write_results


@pytest.mark.parametrize("parts", [1, 7])
def test_percentiles_are_sparks(spark, parts):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([1, None]), r.choice([None, round(r.random(), 2), r.random() * 100])) for _ in range(900)] + [("one", 1, 5.0), ("two", 1, 1.0), ("two", 1, 2.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(parts)
    shares = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {(x.k, x.j): x for x in percentiles(df, ["k", "j"], "v", shares).collect()}
    want = df.where("v is not null").groupBy("k", "j").agg(*(F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items())).collect()
    assert len(got) == len(want)
    assert all(abs(got[x.k, x.j][n] - x[n]) < 1e-9 for x in want for n in shares)
    assert percentiles(df.limit(0), ["k", "j"], "v", shares).collect() == []


def test_no_group_is_one_buffer(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("condition"), F.lit("x").alias("outcome"), (F.col("id") / 7).alias("latency_s"))
    plan = telemetry.latency_profile(df)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
    (a, b) = sorted(telemetry.latency_profile(df).collect())
    assert (a.n, a.p50, b.p95) == (500, round(499 / 7, 6), round((1 + 2 * 474.05) / 7, 6))


def results(spark, n, job="j"):
    rows = [(job, i, f"i{i}", "success", "text", 1, 2, 0.5, 1, None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, RESULTS)


def test_a_run_is_in_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_results(spark, path).count() == 0
    for _ in range(2):
        write_results(results(spark, 10), path, "first")
    write_results(results(spark, 5, "k"), path)
    assert sorted((r.job_id, r["count"]) for r in read_results(spark, path).groupBy("job_id").count().collect()) == [("j", 10), ("k", 5)]
    with pytest.raises(ValueError):
        write_results(results(spark, 1), path, "a/b")


def test_a_run_that_broke_off_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "log")
    write_results(results(spark, 4), path, "whole")
    broken = results(spark, 8).repartition(4).withColumn("item_id", F.when(F.col("seq") == 6, F.raise_error(F.lit("killed"))).otherwise(F.col("item_id")))
    with pytest.raises(Exception):  # noqa: B017
        write_results(broken, path, "half")
    # files of a killed driver that got no further than its tasks
    os.makedirs(f"{path}/run=half/job_id=j", exist_ok=True)
    with open(f"{path}/run=half/job_id=j/part-0.txt", "w") as f:
        f.write('{"item_id": "torn", "status": "success"}\n')
    assert read_results(spark, path).count() == 4
    write_results(results(spark, 8), path, "half")
    assert read_results(spark, path).count() == 12 and read_results(spark, path).where("item_id = 'torn'").count() == 0


def test_a_run_without_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    write_results(results(spark, 0), path, "empty")
    assert read_results(spark, path).count() == 0
    write_results(results(spark, 3), path, "more")
    assert read_results(spark, path).count() == 3
