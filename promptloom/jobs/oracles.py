"""SQL with the rows of the queries, for another engine."""

from __future__ import annotations

from promptloom.jobs.fixtures import shares
from promptloom.jobs.queries import FILE_ELEMENTS, FILE_LINES, LOG_START
from promptloom.operators.reporting import METRICS
from promptloom.schemas import BAD_ROW, PRICES, STATUS_CLASSES


def _cases(side: int) -> str:
    return " ".join(f"WHEN {k} THEN {v[side]!r}" for k, v in STATUS_CLASSES.items())


CLASS = f"CASE WHEN http_status = 200 AND malformed THEN 'transient' ELSE CASE http_status {_cases(0)} ELSE 'transient' END END"
MOST = f"CASE WHEN http_status = 200 AND malformed THEN 2 ELSE CASE http_status {_cases(1)} ELSE 5 END END"
PRICE_IN, PRICE_OUT = (f"CASE model {' '.join(f'WHEN {m!r} THEN CAST({p[i]} AS DOUBLE)' for m, p in PRICES.items())} ELSE CAST(0.2 AS DOUBLE) END" for i in (0, 1))
NANOS = f"(input_tokens * CAST(round({PRICE_IN} * 1000) AS BIGINT) + output_tokens * CAST(round({PRICE_OUT} * 1000) AS BIGINT))"

PROMPTS = """prompts AS (
  SELECT source AS job_id, doc_id AS seq, 'doc-' || doc_id AS item_id, text AS prompt, 128 AS max_tokens,
    CASE WHEN doc_id % 50 = 7 THEN 'unlisted' WHEN lang = 'de' THEN 'openai-gpt-oss-20b' WHEN lang = 'es' THEN 'gemma-4-31B-it'
      WHEN lang = 'fr' THEN 'llama-4-maverick' ELSE 'mistral-3-14B' END AS model
  FROM documents)"""


def u(kind: str) -> str:
    return f"(CAST('0x' || substr(md5('7|' || item_id || '|' || attempt || '|{kind}'), 1, 8) AS BIGINT) / 4294967296.0)"


def kinds(column: str) -> str:
    """The kind of answer that a number in [0, 1) brings."""
    return "CASE " + " ".join(f"WHEN {column} >= {lo} AND {column} < {hi} THEN {kind!r}" for kind, (lo, hi) in shares().items()) + " ELSE 'good' END"


DRAWS = f"""{PROMPTS}, d0 AS (SELECT p.*, CAST(unnest(range(1, 9)) AS INTEGER) AS attempt FROM prompts p),
d1 AS (SELECT *, {u('kind')} AS u_k, {u('length')} AS u_l FROM d0),
d2 AS (
  SELECT *, CASE WHEN kind IN ('429', '500', '400') THEN CAST(kind AS INTEGER) WHEN kind IN ('error', 'timeout') THEN NULL ELSE 200 END AS http_status, kind = 'malformed' AS malformed
  FROM (SELECT *, {kinds('u_k')} AS kind FROM d1)),
d3 AS (
  SELECT *, CASE WHEN http_status = 200 THEN greatest(1, length(prompt) // 4) ELSE 0 END AS input_tokens,
    CASE WHEN http_status = 200 THEN least(128, 64 + CAST(floor(u_l * 65) AS BIGINT)) ELSE 0 END AS output_tokens,
    CAST(attempt AS DOUBLE) * 0.1 AS latency_s FROM d2),
draws AS (SELECT *, {CLASS} AS failure_class, {MOST} AS max_attempts FROM d3),
ending AS (SELECT *, failure_class IN ('throttled', 'transient') AS worn FROM draws
  WHERE failure_class NOT IN ('throttled', 'transient') OR attempt >= max_attempts),
outcomes AS (
  SELECT job_id, seq, item_id, model, attempt, http_status, input_tokens, output_tokens, latency_s,
    CASE WHEN failure_class = 'success' THEN 'success' ELSE 'error' END AS status,
    CASE WHEN failure_class = 'success' THEN NULL WHEN worn THEN 'transient_exhausted' ELSE failure_class END AS final_class,
    CASE WHEN failure_class LIKE 'fatal%' THEN 'fatal: HTTP ' || http_status WHEN failure_class <> 'success' THEN 'max attempts exhausted' END AS message
  FROM ending QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY attempt) = 1)"""

ATTEMPTS = f"""e AS (SELECT event_id, ts, user_id, event_type, value, CAST(replace(replace(props, '{{"k": ', ''), '}}', '') AS INT) AS k FROM events),
a0 AS (
  SELECT 'job-' || (user_id % 8) AS job_id, event_id AS seq, 'evt-' || event_id AS item_id, 1 AS attempt, ts, value / 100 AS latency_s,
    CASE WHEN extract(day FROM ts) BETWEEN 10 AND 13 AND event_type IN ('click', 'view', 'error') THEN 503 WHEN event_type <> 'error' THEN 200
      WHEN k < 40 THEN 429 WHEN k < 70 THEN 500 WHEN k < 85 THEN 502 WHEN k < 92 THEN 400 WHEN k < 95 THEN 408 WHEN k < 97 THEN NULL
      WHEN k < 98 THEN 418 WHEN k < 99 THEN 402 ELSE 401 END AS http_status,
    (event_type = 'signup' AND k < 10) AS malformed, CAST(k + 1 AS BIGINT) AS input_tokens, event_id % 128 + 1 AS output_tokens, 128 AS max_tokens,
    CASE event_id % 6 WHEN 0 THEN 'mistral-3-14B' WHEN 1 THEN 'openai-gpt-oss-20b' WHEN 2 THEN 'openai-gpt-oss-120b' WHEN 3 THEN 'gemma-4-31B-it'
      WHEN 4 THEN 'llama-4-maverick' ELSE 'unlisted' END AS model
  FROM e),
attempts AS (SELECT *, {CLASS} AS failure_class, {MOST} AS max_attempts FROM a0)"""

PARTIAL = f"{DRAWS}, partial AS (SELECT * FROM outcomes WHERE seq % 3 <> 0)"
DIRTY = f"""{PARTIAL}, dirty AS (
  SELECT job_id, item_id, status, seq AS log_seq FROM partial
  UNION ALL SELECT job_id, item_id, status, seq + 1000000000 FROM partial WHERE seq % 7 = 0
  UNION ALL SELECT DISTINCT job_id, 'ghost-' || job_id, 'error', 0 FROM partial)"""
JOBS = f"""{DRAWS}, jobs AS (
  SELECT job_id, row_number() OVER (ORDER BY job_id) AS i FROM (SELECT DISTINCT job_id FROM prompts UNION ALL SELECT 'zz-empty')
), jobrows AS (SELECT job_id, i, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL (i) MINUTE AS submitted_at, CAST(i * 10 AS DOUBLE) AS elapsed_s,
  i % 5 = 0 AS running, i % 7 = 3 AS cancelled, i % 11 = 4 AS aborted FROM jobs),
counts AS (
  SELECT p.job_id, count(*) AS ingested, count(*) FILTER (o.status = 'success') AS succeeded, count(*) FILTER (o.status = 'error') AS failed,
    CAST(0 AS BIGINT) AS in_flight, count(*) FILTER (o.status IS NULL) AS pending
  FROM prompts p LEFT JOIN (SELECT * FROM outcomes WHERE seq % 13 <> 5) o USING (item_id) GROUP BY p.job_id),
spend AS (SELECT job_id, sum({NANOS}) / 1e9 AS cost FROM outcomes WHERE status = 'success' AND seq % 13 <> 5 GROUP BY job_id)"""
STATUS = "CASE WHEN cancelled THEN 'cancelled' WHEN aborted THEN 'failed' WHEN coalesce(ingested, 0) = 0 THEN 'succeeded' WHEN failed = 0 THEN 'succeeded' WHEN succeeded = 0 THEN 'failed' ELSE 'partial' END"
def raw_rows(n: str) -> str:
    """The raw lines as rows; n: what names those without an id."""
    return f"""raw AS (SELECT doc_id, {n} AS seq, doc_id % 10 AS k, text FROM documents),
rows AS (SELECT doc_id, seq,
  CASE WHEN k IN (3, 4) THEN 'line-' || seq WHEN k = 2 THEN 'offset-' || seq WHEN k = 6 THEN '' || doc_id WHEN k = 7 THEN 'None' ELSE 'a' || doc_id END AS item_id,
  CASE WHEN k IN (6, 8, 9) THEN text WHEN k = 2 THEN 'p' || doc_id WHEN k = 7 THEN 'p' END AS prompt,
  CASE WHEN k IN (0, 1, 3, 4) OR (k IN (6, 8, 9) AND text IS NULL) THEN 'invalid_input' END AS failure_class,
  CASE WHEN k IN (3, 4) THEN 'malformed JSON line' WHEN k IN (0, 1) OR (k IN (6, 8, 9) AND text IS NULL) THEN '{BAD_ROW.replace("'", "''")}' END AS message
  FROM raw WHERE k <> 5)"""


RAW_ROWS = raw_rows("doc_id")
FILE_ROWS = raw_rows(f"row_number() OVER (PARTITION BY doc_id // {FILE_LINES} ORDER BY doc_id) - 1")
BODY = """bodies AS (SELECT doc_id AS seq, CASE WHEN doc_id % 12 = 11 THEN 500 ELSE 200 END AS http_status, CASE doc_id % 6
  WHEN 0 THEN '{"choices": [{"message": {"content": "t' || doc_id || '"}}], "usage": {"prompt_tokens": ' || doc_id || ', "completion_tokens": 5}}'
  WHEN 1 THEN '{"choices": [{"message": {"content": null, "reasoning_content": "r"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}'
  WHEN 2 THEN '{"usage": {"prompt_tokens": 1}}' WHEN 3 THEN '{"choices": []}' WHEN 4 THEN 'oops'
  ELSE '{"choices": [{"message": {"content": "t' || doc_id || '"}}]}' END AS body FROM documents)"""

_VALUES = ("a", "b", "c", "d", "7", "3", "1.5", "h")
METRIC_ROWS = f"""r AS (SELECT job_id, {STATUS} AS status, coalesce(ingested, 0) AS a, coalesce(succeeded, 0) AS b, coalesce(failed, 0) AS c, coalesce(in_flight, 0) AS d, coalesce(cost, 0) AS h FROM jobrows LEFT JOIN counts USING (job_id) LEFT JOIN spend USING (job_id)),
m(metric, kind, help, pick) AS (VALUES {", ".join(f"('promptloom_{m}', '{kind}', '{text}', {i})" for i, (m, (kind, text, _)) in enumerate(METRICS.items()))}),
metrics AS (SELECT metric, kind, help, job_id, status, CAST(CASE pick {" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_VALUES))} END AS DOUBLE) AS value FROM r, m)"""

ORACLES = {
    "classify_attempts": f"WITH {ATTEMPTS} SELECT job_id, seq, http_status, malformed, failure_class, max_attempts FROM attempts",
    "failure_predicates": f"WITH {ATTEMPTS} SELECT failure_class, failure_class IN ('fatal_auth', 'fatal_billing') AS fatal, failure_class IN ('throttled', 'transient') AS retryable, failure_class IN ('transient', 'fatal_auth', 'fatal_billing') AS breaker_failure, count(*) AS n FROM attempts GROUP BY failure_class",
    "completion_parse": f"""WITH {BODY}, x AS (SELECT *, http_status = 200 AS fine, seq % 6 IN (0, 5) AS ok FROM bodies)
SELECT seq, http_status, CASE WHEN NOT fine THEN body WHEN ok THEN 't' || seq ELSE '' END AS response_text, fine AND NOT ok AS malformed,
  CASE WHEN fine AND seq % 6 = 0 THEN seq ELSE 0 END AS input_tokens, CASE WHEN fine AND seq % 6 = 0 THEN CAST(5 AS BIGINT) ELSE 0 END AS output_tokens FROM x""",
    "rate_headers": f"""WITH {ATTEMPTS} SELECT seq, CAST(CASE http_status WHEN 429 THEN 3 WHEN 200 THEN 2 END AS INTEGER) AS kept,
  CASE http_status WHEN 429 THEN CAST(0 AS BIGINT) END AS remaining_requests,
  CASE http_status WHEN 200 THEN 800000000 - seq + 3 * (seq % 10) END AS remaining_day FROM attempts WHERE http_status IN (200, 429)""",
    "reset_wait": f"""WITH {ATTEMPTS} SELECT seq, round(CASE WHEN seq % 50 = 0 THEN 0.0 ELSE greatest(0.0, floor(epoch_us(ts) / 1e6) + seq % 7 - 2 - epoch_us(ts) / 1e6) END, 6) AS wait_s FROM attempts WHERE http_status = 429""",
    "backoff_bounds": f"WITH {DRAWS} SELECT item_id, attempt, least(30.0, 0.5 * pow(2, attempt)) AS envelope_s, round(least(30.0, 0.5 * pow(2, attempt)) * {u('backoff')}, 6) AS delay_s FROM draws",
    "cost_per_row": f"WITH {DRAWS} SELECT item_id, model, input_tokens, output_tokens, {NANOS} / 1e9 AS cost_usd FROM outcomes WHERE status = 'success'",
    "unit_hash": f"WITH {PROMPTS}, d0 AS (SELECT *, 1 AS attempt FROM prompts) SELECT item_id, round({u('x')}, 9) AS u FROM d0",
    "prompts_validate": "SELECT source AS job_id, doc_id AS seq, 'doc-' || doc_id AS item_id, CASE WHEN text IS NULL THEN 'invalid_input' END AS failure_class, CAST(length(text) AS INTEGER) AS chars FROM documents",
    "read_lines": f"WITH {FILE_ROWS} SELECT doc_id // {FILE_LINES} AS part, item_id, seq, md5(prompt) AS prompt_md5, failure_class, message FROM rows",
    "read_array": f"""WITH {PROMPTS}, x AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS n FROM prompts), bad AS (SELECT *, seq % 17 = 3 OR prompt IS NULL AS bad FROM x)
SELECT job_id, n // {FILE_ELEMENTS} AS part, n % {FILE_ELEMENTS} AS seq, CASE WHEN seq % 17 = 5 THEN 'offset-' || (n % {FILE_ELEMENTS}) ELSE item_id END AS item_id, CASE WHEN NOT bad THEN md5(prompt) END AS prompt_md5,
  CASE WHEN bad THEN 'invalid_input' END AS failure_class, CASE WHEN bad THEN '{BAD_ROW.replace("'", "''")}' END AS message FROM bad""",
    "prompts_cap": f"WITH {PROMPTS} SELECT job_id, seq, item_id FROM prompts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) <= 20",
    "request_validate": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 300 END AS concurrency, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 7 % 5000 END AS max_tokens,
  CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://host.example/x' WHEN 2 THEN 'ftp://host.example' WHEN 3 THEN 'not a url' WHEN 4 THEN 'http://h' ELSE 'HTTPS://host.example' END AS hook, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS model FROM documents),
x AS (SELECT *, CASE WHEN concurrency IS NOT NULL AND concurrency NOT BETWEEN 1 AND 256 THEN 'concurrency must be 1..256' WHEN max_tokens IS NOT NULL AND max_tokens NOT BETWEEN 1 AND 4096 THEN 'max_tokens must be 1..4096'
  WHEN hook IN ('ftp://host.example', 'not a url') THEN 'webhook_url must be http(s) with a host' END AS reason FROM r)
SELECT doc_id, coalesce(model, 'mistral-3-14B') AS model, CAST(coalesce(max_tokens, 128) AS BIGINT) AS max_tokens, reason IS NULL AS valid, reason FROM x""",
    "resume_pending": f"WITH {PARTIAL} SELECT job_id, seq, item_id FROM prompts WHERE item_id NOT IN (SELECT item_id FROM partial)",
    "conservation_audit": f"""WITH {DIRTY}, w AS (SELECT job_id, item_id, count(*) AS e FROM prompts GROUP BY ALL), h AS (SELECT job_id, item_id, count(*) AS f FROM dirty GROUP BY ALL),
v AS (SELECT coalesce(w.job_id, h.job_id) AS job_id, CASE WHEN e IS NULL THEN 'unexpected' WHEN f IS NULL THEN 'missing' WHEN f > 1 OR e > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM w FULL JOIN h ON w.job_id = h.job_id AND w.item_id = h.item_id)
SELECT job_id, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'duplicate') AS duplicate, count(*) FILTER (verdict = 'unexpected') AS unexpected,
  count(*) FILTER (verdict <> 'ok') = 0 AS conserved FROM v GROUP BY job_id""",
    "fatal_cutoff": f"""WITH {ATTEMPTS}, c AS (SELECT job_id, seq AS cutoff_seq, failure_class, http_status FROM attempts WHERE failure_class LIKE 'fatal%' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1),
k AS (SELECT 'job-3' AS job_id, 500 AS cancel_seq)
SELECT a.job_id, a.seq, a.item_id, CASE WHEN seq > cancel_seq THEN 'cancelled' WHEN seq > cutoff_seq THEN c.failure_class END AS failure_class,
  CASE WHEN seq > cancel_seq THEN 'job cancelled before dispatch' WHEN seq > cutoff_seq THEN c.failure_class || ' (HTTP ' || c.http_status || ')' END AS message
FROM attempts a LEFT JOIN c ON a.job_id = c.job_id LEFT JOIN k ON a.job_id = k.job_id""",
    "job_counts": f"WITH {JOBS} SELECT * FROM counts",
    "errors_by_class": f"WITH {DRAWS} SELECT job_id, final_class AS failure_class, count(*) AS errors FROM outcomes WHERE status = 'error' GROUP BY ALL",
    "usage_cost": f"WITH {DRAWS} SELECT job_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, sum({NANOS}) / 1e9 AS cost_usd, avg(CAST(input_tokens + output_tokens AS DOUBLE)) AS avg_tokens FROM outcomes WHERE status = 'success' GROUP BY job_id",
    "final_status": f"WITH {JOBS} SELECT job_id, {STATUS} AS status FROM jobrows LEFT JOIN counts USING (job_id)",
    "progress_timing": f"""WITH {JOBS} SELECT job_id, round((succeeded + failed) / ingested * 100, 1) AS progress_pct, round((succeeded + failed) / elapsed_s, 3) AS throughput_rps,
  CASE WHEN running AND succeeded + failed > 0 THEN round((greatest(0, ingested - succeeded - failed) + pending) / ((succeeded + failed) / elapsed_s), 1) END AS eta_s FROM jobrows JOIN counts USING (job_id)""",
    "job_report": f"""WITH {JOBS}, err AS (SELECT job_id, string_agg(final_class || '=' || n, ',' ORDER BY final_class) AS errors FROM (SELECT job_id, final_class, count(*) AS n FROM outcomes WHERE status = 'error' AND seq % 13 <> 5 GROUP BY ALL) GROUP BY job_id),
made AS (SELECT d.* FROM draws d JOIN outcomes o ON d.item_id = o.item_id AND d.attempt <= o.attempt),
att AS (SELECT job_id, count(*) AS attempts, count(*) FILTER (failure_class = 'throttled') AS throttle_events, count(*) - count(DISTINCT item_id) AS retries_issued,
  sum(CASE WHEN failure_class = 'success' THEN CAST(round(latency_s * 1e6) AS BIGINT) END) / count(*) FILTER (failure_class = 'success') / 1e6 AS w FROM made GROUP BY job_id)
SELECT job_id, CASE WHEN running THEN 'running' ELSE {STATUS} END AS status, coalesce(ingested, 0) AS ingested, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending,
  coalesce(cost, 0) AS cost_usd, coalesce(errors, '') AS errors, coalesce(throttle_events, 0) AS throttle_events, coalesce(retries_issued, 0) AS retries_issued,
  strftime(submitted_at, '%Y-%m-%dT%H:%M:%SZ') AS submitted_at, greatest(0, greatest(1, CAST(floor(coalesce(ingested, 0) * 0.2) AS BIGINT)) - coalesce(retries_issued, 0)) AS retry_budget_remaining, round(coalesce(w, 0), 4) AS observed_mean_latency_s,
  CASE WHEN coalesce(w, 0) <= 0 THEN 1 ELSE greatest(1, CAST(ceil(round((succeeded + failed) / elapsed_s, 3) * w) AS BIGINT)) END AS littles_law_optimal_concurrency
FROM jobrows LEFT JOIN counts USING (job_id) LEFT JOIN spend USING (job_id) LEFT JOIN err USING (job_id) LEFT JOIN att USING (job_id)""",
    "attempt_summary": f"""WITH {DRAWS}, made AS (SELECT d.* FROM draws d JOIN outcomes o ON d.item_id = o.item_id AND d.attempt <= o.attempt), per AS (SELECT job_id, item_id, count(*) AS a, count(*) FILTER (failure_class = 'throttled') AS t, count(*) FILTER (failure_class = 'success') AS g, sum(CASE WHEN failure_class = 'success' THEN CAST(round(latency_s * 1e6) AS BIGINT) END) AS us FROM made GROUP BY ALL)
SELECT job_id, round(sum(us) / sum(g) / 1e6, 9) AS mean_latency_s, CAST(sum(a) AS BIGINT) AS attempts, CAST(sum(t) AS BIGINT) AS throttle_events, CAST(sum(a) - count(*) AS BIGINT) AS retries_issued, count(*) AS items, max(a) AS max_attempts_of_item FROM per GROUP BY job_id""",
    "latency_profile": f"""WITH {ATTEMPTS} SELECT CASE WHEN extract(day FROM ts) BETWEEN 10 AND 13 THEN 'storm' ELSE 'normal' END AS condition, failure_class AS outcome, count(*) AS n, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(avg(latency_s), 6) AS mean FROM attempts GROUP BY ALL""",
    "replay_counts": f"WITH {DIRTY} SELECT job_id, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status <> 'success') AS failed, count(DISTINCT item_id) AS items FROM dirty GROUP BY job_id",
    "latest_result": f"WITH {DIRTY} SELECT job_id, item_id, status, log_seq FROM dirty QUALIFY row_number() OVER (PARTITION BY job_id, item_id ORDER BY (status = 'success') DESC, log_seq DESC) = 1",
    "spend_ledger": f"""WITH {JOBS}, c AS (SELECT job_id, submitted_at, coalesce(cost, 0) * CASE WHEN i % 4 = 1 THEN -1 ELSE 500 END AS cost_usd FROM jobrows LEFT JOIN spend USING (job_id)),
r AS (SELECT *, greatest(0.0, cost_usd) AS spent, sum(greatest(0.0, cost_usd)) OVER (ORDER BY submitted_at, job_id) AS after FROM c)
SELECT job_id, round(after - spent, 6) AS total_before, round(after, 6) AS total_after, round(after - spent, 6) >= 1.0 AS refused FROM r""",
    "metrics_rows": f"WITH {JOBS}, {METRIC_ROWS} SELECT metric, kind, help, job_id, status, value FROM metrics",
    "metrics_text": f"""WITH {JOBS}, {METRIC_ROWS} SELECT metric || '{{job_id="' || job_id || '",status="' || status || '"}} ' || regexp_replace(printf('%.9f', value), '(\\.\\d+?)0+$', '\\1') AS value FROM metrics
UNION ALL SELECT DISTINCT '# HELP ' || metric || ' ' || help FROM m UNION ALL SELECT DISTINCT '# TYPE ' || metric || ' ' || kind FROM m""",
    "cost_projection": f"""WITH {DRAWS}, avgs AS (SELECT avg(CAST(input_tokens AS DOUBLE)) AS i, avg(CAST(output_tokens AS DOUBLE)) AS o FROM outcomes WHERE status = 'success'),
p(model, pi, po) AS (VALUES {", ".join(f"({m!r}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, (a, b) in PRICES.items())}), n(items) AS (VALUES (1000), (10000), (100000), (500000))
SELECT model, CAST(items AS BIGINT) AS items, round((i / 1e6 * pi + o / 1e6 * po) * items, 6) AS cost_usd FROM p, n, avgs""",
    "cost_ranking": f"""WITH {DRAWS}, t AS (SELECT model, sum({NANOS}) / count(*) / 1e6 AS per FROM outcomes WHERE status = 'success' GROUP BY model)
SELECT model, per AS usd_per_1000, row_number() OVER (ORDER BY per, model) AS place FROM t""",
    "cost_variance": f"""WITH {DRAWS}, t AS (SELECT job_id, model, count(*) AS items, sum({NANOS}) / 1e9 AS actual, avg(CAST(input_tokens + output_tokens AS DOUBLE)) AS tokens FROM outcomes WHERE status = 'success' GROUP BY job_id, model)
SELECT job_id, model, items, round(items * (0.00015 * {PRICE_IN} + 0.0002 * {PRICE_OUT}), 6) AS estimated_usd, actual AS actual_usd, round(actual / (items * (0.00015 * {PRICE_IN} + 0.0002 * {PRICE_OUT})), 6) AS ratio, tokens AS tokens_per_item FROM t""",
    "model_comparison": f"""WITH {ATTEMPTS}, x AS (SELECT *, coalesce(http_status = 200 AND NOT malformed, FALSE) AS ok FROM attempts)
SELECT model, count(*) AS items, avg(CAST(ok AS DOUBLE)) AS usable_share, avg(CAST(input_tokens AS DOUBLE)) FILTER (ok) AS avg_input, avg(CAST(output_tokens AS DOUBLE)) FILTER (ok) AS avg_output,
  avg(CAST(output_tokens = max_tokens AS DOUBLE)) FILTER (ok) AS capped_share, sum({NANOS}) FILTER (ok) / count(*) FILTER (ok) / 1e6 AS usd_per_1000 FROM x GROUP BY model""",
    "capacity_plan": f"""WITH {ATTEMPTS}, t AS (SELECT job_id, count(*) AS items, avg(latency_s) AS w, CAST(substr(job_id, 5) AS INTEGER) * 2 + 1 AS concurrency FROM attempts GROUP BY job_id),
l AS (SELECT *, CASE WHEN w <= 0 THEN 1 ELSE greatest(1, CAST(ceil(2.0 * w) AS BIGINT)) END AS need FROM t)
SELECT job_id, items, concurrency, round(items / 120.0 / 60, 6) AS floor_hours, round(500000 / 120.0, 6) AS tokens_crossover, need AS in_flight, CAST(4 AS BIGINT) AS start_guess, concurrency > 2 * need AS over_provisioned FROM l""",
    "attempt_outcomes": f"WITH {DRAWS} SELECT job_id, item_id, attempt, status, final_class, message FROM outcomes",
    "rolling_latency": f"WITH {ATTEMPTS} SELECT job_id, seq, sum(CAST(round(latency_s * 1e6) AS BIGINT)) OVER w / count(*) OVER w / 1e6 AS mean_latency_s FROM attempts WHERE failure_class = 'success' WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq, attempt ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)",
    "rolling_failure_rate": f"""WITH {ATTEMPTS}, x AS (SELECT job_id, seq, sum(CAST(failure_class IN ('transient', 'fatal_auth', 'fatal_billing') AS INT)) OVER w AS f, count(*) OVER w AS n FROM attempts
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq, attempt ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT job_id, seq, f / n AS failure_rate, n >= 10 AND f / n > 0.5 AS trips FROM x""",
    "spend_guard": f"""WITH {DRAWS}, x AS (SELECT job_id, seq, status, row_number() OVER w AS done, sum(CASE WHEN status = 'success' THEN {NANOS} ELSE 0 END) OVER w / 1e9 AS cost, count(*) OVER (PARTITION BY job_id) AS ingested FROM outcomes WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, cost / done * greatest(ingested, done) AS projected FROM x)
SELECT job_id, seq, done, cost AS cost_so_far, projected FROM y WHERE status = 'success' AND done % 10 = 0 AND (cost >= 0.002 OR projected >= 0.002) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1""",
    "quota_compliance": f"""WITH {ATTEMPTS}, x AS (SELECT job_id, count(*) OVER (PARTITION BY job_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 999999 MICROSECONDS FOLLOWING) AS w1,
  count(*) OVER (PARTITION BY job_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 4999999 MICROSECONDS FOLLOWING) AS w5, count(*) OVER (PARTITION BY job_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 9999999 MICROSECONDS FOLLOWING) AS w10 FROM attempts),
y AS (SELECT job_id, 1 AS window_s, w1 AS n FROM x UNION ALL SELECT job_id, 5, w5 FROM x UNION ALL SELECT job_id, 10, w10 FROM x)
SELECT job_id, window_s, CAST(0.01 * window_s + 1.5 AS DOUBLE) AS allowed, count(*) AS checked, max(n) AS most, count(*) FILTER (n > 0.01 * window_s + 1.5) AS violations FROM y GROUP BY ALL""",
    "success_streaks": f"""WITH {ATTEMPTS}, x AS (SELECT job_id, failure_class, CAST(sum(CAST(failure_class = 'throttled' AS INT)) OVER (PARTITION BY job_id ORDER BY ts, seq, attempt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM attempts)
SELECT job_id, streak, count(*) AS successes, count(*) // 50 AS increases FROM x WHERE failure_class = 'success' GROUP BY ALL""",
    "header_drift": f"""WITH {ATTEMPTS}, h AS (SELECT job_id, ts, 800000000 - seq + 3 * (seq % 10) AS l, CASE WHEN extract(day FROM ts) < 15 THEN 500000 ELSE 750000 END AS lim FROM attempts WHERE http_status = 200),
x AS (SELECT *, l > lag(l) OVER (PARTITION BY job_id ORDER BY ts) AS rise FROM h)
SELECT job_id, count(DISTINCT lim) AS limits, min_by(l, ts) AS first_remaining, max_by(l, ts) AS last_remaining, min(l) AS least_remaining, count(*) FILTER (rise) AS rises FROM x GROUP BY job_id""",
    "reset_lag": f"""WITH {ATTEMPTS}, x AS (SELECT job_id, floor(epoch_us(ts) / 1e6) + seq % 7 - 2 - epoch_us(ts) / 1e6 AS lag FROM attempts WHERE http_status = 429 AND seq % 50 <> 0)
SELECT job_id, count(*) AS n, round(quantile_cont(lag, 0.5), 6) AS median, round(min(lag), 6) AS least, round(max(lag), 6) AS most, round(avg(CAST(lag < 0 AS DOUBLE)), 6) AS past_share FROM x GROUP BY job_id""",
    "breaker_openings": f"""WITH {ATTEMPTS}, x AS (SELECT job_id, ts, seq, attempt, sum(CAST(failure_class IN ('transient', 'fatal_auth', 'fatal_billing') AS INT)) OVER w AS f, count(*) OVER w AS n FROM attempts
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq, attempt ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, n >= 10 AND f / n > 0.5 AS trips FROM x)
SELECT job_id, seq, f / n AS failure_rate FROM y QUALIFY trips AND NOT lag(trips) OVER (PARTITION BY job_id ORDER BY ts, seq, attempt)""",
    "merge_outcomes": f"WITH {DRAWS}, {RAW_ROWS} SELECT item_id, seq, failure_class, attempt FROM (SELECT item_id, seq, final_class AS failure_class, attempt FROM outcomes UNION ALL SELECT item_id, seq, failure_class, 1 FROM rows WHERE failure_class IS NOT NULL)",
    "upsert_reports": f"""WITH {JOBS} SELECT job_id, CASE WHEN i % 2 = 0 THEN 'new' ELSE 'old' END AS state, CAST(CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS updated_at FROM jobrows""",
    "all_job_ids": f"WITH {PROMPTS}, {ATTEMPTS} SELECT job_id FROM prompts UNION SELECT job_id FROM attempts",
    "export_filter": f"WITH {JOBS} SELECT o.job_id, item_id, final_class AS failure_class FROM outcomes o JOIN jobrows j ON o.job_id = j.job_id WHERE o.status = 'error' AND NOT running",
    "results_roundtrip": f"WITH {DRAWS}, t AS (SELECT o.*, coalesce(text, '') AS text FROM outcomes o JOIN documents ON doc_id = seq) SELECT job_id, item_id, status, attempt, CASE WHEN status = 'success' THEN input_tokens END AS input_tokens, CASE WHEN status = 'success' THEN md5(text) END AS text_md5, CASE WHEN status <> 'success' THEN final_class END AS failure_class, CASE WHEN status <> 'success' THEN message END AS message, CASE WHEN status <> 'success' THEN http_status END AS http_status FROM t",
    "job_record_json": f"WITH {JOBS} SELECT job_id, ingested, succeeded, failed FROM counts",
    "run_attempts": f"WITH {DRAWS} SELECT item_id, http_status, malformed, input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, failure_class FROM draws WHERE attempt = 1",
    "quota_per_minute": f"WITH {ATTEMPTS} SELECT job_id, date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) FILTER (http_status = 429) AS throttled FROM attempts GROUP BY ALL",
    "stream_status": f"""WITH {DRAWS}, e AS (SELECT job_id, string_agg(k || '=' || c, ',' ORDER BY k) AS errors FROM (SELECT job_id, final_class AS k, count(*) AS c FROM outcomes WHERE status <> 'success' GROUP BY ALL) GROUP BY job_id)
SELECT o.job_id, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status <> 'success') AS failed, CAST(sum(CASE WHEN status = 'success' THEN input_tokens ELSE 0 END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN status = 'success' THEN output_tokens ELSE 0 END) AS BIGINT) AS output_tokens, coalesce(max(errors), '') AS errors FROM outcomes o LEFT JOIN e ON o.job_id = e.job_id GROUP BY o.job_id""",
    "stream_quota": f"WITH {ATTEMPTS} SELECT job_id, date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) FILTER (http_status = 429) AS throttled FROM attempts GROUP BY ALL",
    "stream_dedupe": f"WITH {ATTEMPTS} SELECT job_id, item_id FROM attempts",
    "stream_prompts": f"WITH {FILE_ROWS} SELECT seq, regexp_replace(item_id, '^(offset|line)-.*', '\\1') AS item_id, md5(prompt) AS prompt_md5, failure_class FROM rows",
}


EVENT_PROMPTS = """prompts AS (SELECT 'job-' || (user_id % 8) AS job_id, event_id AS seq, 'evt-' || event_id AS item_id, event_type AS prompt, 128 AS max_tokens, 'mistral-3-14B' AS model FROM events)"""


CONVERSATION_PROMPTS = """prompts AS (SELECT 'conv-' || (conv_id % 5) AS job_id, conv_id * 100 + turn AS seq, conv_id || '-' || turn AS item_id, text AS prompt, 128 AS max_tokens, 'mistral-3-14B' AS model FROM conversations WHERE role = 'user')"""


def _budget(share: float = 0.2, stop: str = "SELECT job_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS why FROM lim", draws: str = DRAWS) -> str:
    """Waves written out: what each one ends, refuses and grants. stop (job_id, kind, why, from w1 and lim): jobs that stop after the
    first attempts, why, and the class of their waiting items; null for the others."""
    out = f"{draws}, lim AS (SELECT job_id, count(*) AS n, greatest(1, CAST(floor(count(*) * {share}) AS BIGINT)) AS lim FROM prompts GROUP BY job_id), used0 AS (SELECT job_id, lim, CAST(0 AS BIGINT) AS used FROM lim), g0 AS (SELECT job_id, item_id FROM prompts)"
    ends = []
    for k in range(1, 9):
        out += f""", w{k} AS (SELECT d.*, failure_class IN ('throttled', 'transient') AS worn FROM draws d JOIN g{k - 1} g ON d.item_id = g.item_id WHERE attempt = {k}){f", stop AS ({stop})" if k == 1 else ""},
r{k} AS (SELECT w.*, u.lim, u.used, s.kind AS stop_kind, s.why, s.kind IS NULL AND u.used + row_number() OVER (PARTITION BY w.job_id ORDER BY seq) <= u.lim AS granted FROM w{k} w JOIN used{k - 1} u ON w.job_id = u.job_id LEFT JOIN stop s ON s.job_id = w.job_id WHERE worn AND attempt < max_attempts),
g{k} AS (SELECT job_id, item_id FROM r{k} WHERE granted), used{k} AS (SELECT u.job_id, u.lim, u.used + count(g.item_id) AS used FROM used{k - 1} u LEFT JOIN g{k} g ON u.job_id = g.job_id GROUP BY u.job_id, u.lim, u.used)"""
        ends.append(f"SELECT job_id, item_id, attempt, CASE WHEN failure_class = 'success' THEN NULL WHEN worn THEN 'transient_exhausted' ELSE failure_class END AS final_class, CASE WHEN failure_class LIKE 'fatal%' THEN 'fatal: HTTP ' || http_status WHEN failure_class <> 'success' THEN 'max attempts exhausted' END AS message, CASE WHEN failure_class <> 'success' THEN http_status END AS http_status FROM w{k} WHERE NOT worn OR attempt >= max_attempts")
        ends.append(f"SELECT job_id, item_id, attempt, coalesce(stop_kind, 'transient_exhausted'), coalesce(why, 'retry budget exhausted'), CASE WHEN stop_kind IS NULL THEN http_status END FROM r{k} WHERE NOT granted")
    return f"WITH {out} {' UNION ALL '.join(ends)}"


def _ended(alias: str) -> str:
    return f"count(*) FILTER (failure_class NOT IN ('throttled', 'transient') OR attempt >= max_attempts) AS {alias}"


ORACLES["score_batch"] = ORACLES["stream_score"] = _budget()
ORACLES["retry_budget"] = f"SELECT job_id, item_id, attempt, final_class, message FROM ({_budget()})"
ORACLES["score_events"] = _budget().replace(PROMPTS, EVENT_PROMPTS)
ORACLES["score_conversations"] = _budget().replace(PROMPTS, CONVERSATION_PROMPTS)
ORACLES["score_capped"] = _budget().replace(PROMPTS, PROMPTS.replace("prompts AS", "every AS") + ", prompts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) <= 20)")
ORACLES["score_cancelled"] = _budget(stop="SELECT job_id, 'cancelled' AS kind, 'job cancelled before dispatch' AS why FROM lim WHERE job_id IN ('src1', 'src3')")
ORACLES["score_guarded"] = _budget(
    stop=f"""SELECT job_id, 'fatal_auth' AS kind, printf('spend guard: cost $%.4f / projected $%.4f >= cap $0.006', cost, projected) AS why
FROM (SELECT job_id, cost, cost / greatest(done, 1) * n AS projected, done FROM (SELECT job_id, n, {_ended("done")}, sum(CASE WHEN failure_class = 'success' THEN {NANOS} ELSE 0 END) / 1e9 AS cost FROM w1 JOIN lim USING (job_id) GROUP BY ALL))
WHERE done > 0 AND (cost >= 0.006 OR projected >= 0.006)"""
)
ORACLES["score_aborted"] = _budget(
    stop="SELECT job_id, min_by(failure_class, seq) AS kind, min_by(failure_class || ' (HTTP ' || http_status || ')', seq) AS why FROM w1 WHERE failure_class LIKE 'fatal%' GROUP BY job_id",
    draws=DRAWS.replace("SELECT *, CASE WHEN kind IN", "SELECT *, CASE WHEN seq % 211 = 3 THEN 401 WHEN kind IN"),
)
ORACLES["score_resumed"] = " UNION ALL ".join("SELECT * FROM (" + _budget().replace(PROMPTS, PROMPTS.replace("FROM documents)", f"FROM documents WHERE {w})")) + ")" for w in ("doc_id % 3 = 1", "doc_id % 3 <> 1"))
ORACLES["spend_guard_cutoff"] = f"WITH b AS ({ORACLES['spend_guard']}), {DRAWS} SELECT o.job_id, o.seq, item_id, CASE WHEN o.seq > b.seq THEN 'fatal_auth' END AS failure_class, CASE WHEN o.seq > b.seq THEN printf('spend guard: cost $%.4f / projected $%.4f >= cap $0.002', cost_so_far, projected) END AS message FROM outcomes o LEFT JOIN b ON o.job_id = b.job_id"
JSON_LINES = f"""{DRAWS}, j AS (SELECT o.job_id, o.status, CASE WHEN status = 'success'
    THEN json_object('item_id', item_id, 'status', status, 'response_text', coalesce(text, ''), 'input_tokens', input_tokens, 'output_tokens', output_tokens, 'latency_s', latency_s, 'attempt', attempt)
    ELSE json_object('item_id', item_id, 'status', status, 'failure_class', final_class, 'message', message, 'attempt', attempt, 'http_status', http_status) END AS j,
  row_number() OVER (ORDER BY o.job_id, seq) AS n, count(*) OVER () AS m FROM outcomes o JOIN documents ON doc_id = seq)"""
ORACLES["export_files"] = f"WITH {JSON_LINES}, {JOBS.removeprefix(DRAWS + ', ')} SELECT CAST(j AS VARCHAR) AS value FROM j JOIN jobrows USING (job_id) WHERE status = 'error' AND NOT running"
ORACLES["export_array"] = f"""WITH {JSON_LINES}
SELECT CASE WHEN n = 1 THEN '[' ELSE ',' END || j || CASE WHEN n = m THEN ']' ELSE '' END AS value FROM j"""
ORACLES["detect_format"] = f"WITH {PROMPTS} SELECT job_id, CASE WHEN min(seq) % 2 = 0 THEN 'array' ELSE 'lines' END AS format FROM prompts GROUP BY job_id"


def _log() -> str:
    """The waves of _budget as a log of attempts with times: each retry when its predecessor's end, back-off and reset allow."""
    waves = _budget().removeprefix("WITH ").split(" SELECT job_id, item_id, attempt, CASE WHEN failure_class = 'success' THEN NULL")[0]
    jitter = lambda kind: f"(CAST('0x' || substr(md5('0|' || p.job_id || '|' || p.item_id || '|' || p.attempt || '|{kind}'), 1, 8) AS BIGINT) / 4294967296.0)"
    end = "(p.ts_us + CAST(round(p.took * 1e6) AS BIGINT))"
    pause = f"CASE WHEN p.http_status = 429 AND p.seq % 50 <> 0 THEN greatest(0.0, floor(p.ts_us / 1e6) + p.seq % 7 - 2 - {end} / 1e6) + 0.25 * {jitter('reset')} ELSE 0.0 END"
    due = f"({end} + CAST(floor(({pause} + least(30.0, 0.5 * pow(2.0, p.attempt)) * {jitter('backoff')}) * 1e6) AS BIGINT)) / 1e6"
    took = f"round(0.2 + {u('time').replace('item_id', 'w.item_id').replace(' attempt', ' w.attempt')}, 6) AS took"
    later = "CAST(round(due_s * 1e6) AS BIGINT) + seq % 100003 * 1000 AS ts_us"
    out = f"{waves}, t1 AS (SELECT *, {later} FROM (SELECT w.*, {took}, CAST({LOG_START} AS DOUBLE) AS due_s FROM w1 w))"
    for k in range(2, 9):
        out += f", t{k} AS (SELECT *, {later} FROM (SELECT w.*, {took}, {due} AS due_s FROM w{k} w JOIN t{k - 1} p ON w.item_id = p.item_id))"
    every = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, 9))
    return f"{out}, attempts AS (SELECT * EXCLUDE (latency_s), took AS latency_s, make_timestamp(ts_us) AS ts FROM ({every}))"


ORACLES["scored_log"] = f"WITH {_log()} SELECT job_id, item_id, attempt, due_s, ts_us, latency_s, http_status, failure_class FROM attempts"
for _name in ("rolling_latency", "quota_compliance", "header_drift", "reset_lag"):
    ORACLES[f"scored_{_name}"] = ORACLES[_name].replace(ATTEMPTS, _log())
