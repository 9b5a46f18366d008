"""Golden values of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import scalar as S

GOLDEN = [
    (200, False, "success", 1), (200, True, "transient", 2), (400, False, "invalid_input", 1), (401, False, "fatal_auth", 1),
    (402, False, "fatal_billing", 1), (403, False, "fatal_auth", 1), (408, False, "transient", 5), (413, False, "invalid_input", 1),
    (422, False, "invalid_input", 1), (429, False, "throttled", 8), (500, False, "transient", 5), (502, False, "transient", 5),
    (503, False, "transient", 5), (504, False, "transient", 5), (418, False, "transient", 5), (None, None, "transient", 5),
]


def test_classify(spark):
    df = spark.createDataFrame(GOLDEN, "http_status int, malformed boolean, want string, most int")
    rows = S.classify(df).collect()
    assert all((r.failure_class, r.max_attempts) == (r.want, r.most) for r in rows) and len(rows) == len(GOLDEN)


def test_unit_hash_is_order_free(spark):
    df = spark.range(100).select(F.concat(F.lit("item-"), "id").alias("item_id"))
    a = {r[0]: r[1] for r in df.select("item_id", S.unit_hash("item_id", F.lit(1))).collect()}
    b = {r[0]: r[1] for r in df.repartition(7).select("item_id", S.unit_hash("item_id", F.lit(1))).collect()}
    assert a == b and all(0 <= x < 1 for x in a.values())
    assert abs(a["item-1"] - 1646652104 / 2**32) < 1e-12


def test_cost_falls_back_to_the_default_model(spark):
    df = spark.createDataFrame([("openai-gpt-oss-20b", 1_000_000, 2_000_000), ("nobody", 1_000_000, 1_000_000), (None, 0, 5_000_000)], "model string, input_tokens long, output_tokens long")
    assert [round(r[0], 6) for r in df.select(S.cost_usd()).collect()] == [0.95, 0.4, 1.0]


def test_backoff_and_reset(spark):
    df = spark.createDataFrame([(1, "110", 100.0), (6, "x", 100.0), (7, "-3", 100.0), (2, "90", 100.0), (3, None, 100.0)], "attempt int, reset string, now double")
    rows = df.select(S.backoff_envelope_s(), S.reset_wait_s("reset", "now")).collect()
    assert [tuple(r) for r in rows] == [(1.0, 10.0), (30.0, 0.0), (30.0, 0.0), (2.0, 0.0), (4.0, 0.0)]


def test_completion_bodies(spark):
    body = '{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3,"completion_tokens":4}}'
    rows = [(200, body), (200, '{"choices":[{"message":{"content":null}}]}'), (200, "nonsense"), (500, "down"), (200, '{"choices":[]}'), (200, None)]
    out = S.parse_completion(spark.createDataFrame(rows, "http_status int, body string")).collect()
    assert [(r.response_text, r.malformed, r.input_tokens, r.output_tokens) for r in out] == [("hi", False, 3, 4), ("", True, 0, 0), ("", True, 0, 0), ("down", False, 0, 0), ("", True, 0, 0), ("", True, 0, 0)]


def test_retry_limit(spark):
    df = spark.createDataFrame([(100,), (3,), (0,)], "n long")
    assert [r[0] for r in df.select(S.retry_limit("n")).collect()] == [20, 1, 1]
