"""Fixed values and schemas of the tables."""

from __future__ import annotations

# Http status -> (failure class, attempts allowed).
STATUS_CLASSES = {
    200: ("success", 1),
    400: ("invalid_input", 1),
    401: ("fatal_auth", 1),
    402: ("fatal_billing", 1),
    403: ("fatal_auth", 1),
    408: ("transient", 5),
    413: ("invalid_input", 1),
    422: ("invalid_input", 1),
    429: ("throttled", 8),
    500: ("transient", 5),
    502: ("transient", 5),
    503: ("transient", 5),
    504: ("transient", 5),
}
# Other statuses and transport failures; malformed bodies with status 200; attempts of an item at most.
OTHER_CLASS, MALFORMED_CLASS = ("transient", 5), ("transient", 2)
MAX_WAVES = 8
# Classes of failed items.
ERROR_CLASSES = ("throttled", "transient", "invalid_input", "fatal_auth", "fatal_billing", "transient_exhausted", "cancelled")
# Model -> dollars per million input and output tokens.
PRICES = {
    "mistral-3-14B": (0.20, 0.20),
    "openai-gpt-oss-20b": (0.05, 0.45),
    "openai-gpt-oss-120b": (0.06, 0.39),
    "gemma-4-31B-it": (0.18, 0.50),
    "llama-4-maverick": (0.20, 0.696),
}
# Defaults of a request.
DEFAULT_MODEL, DEFAULT_MAX_TOKENS = "mistral-3-14B", 128
# Rate headers.
RATE_HEADERS = (
    "x-ratelimit-limit-requests",
    "x-ratelimit-remaining-requests",
    "x-ratelimit-reset-requests",
    "x-ratelimit-limit-tokens-per-minute",
    "x-ratelimit-remaining-tokens-per-minute",
    "x-ratelimit-reset-tokens-per-minute",
    "x-ratelimit-limit-tokens-per-day",
    "x-ratelimit-remaining-tokens-per-day",
    "x-ratelimit-reset-tokens-per-day",
)
# Fixed value: the header that tells when a throttled caller may go on.
RESET_HEADER = "x-ratelimit-reset-requests"
# Fixed value: message of a row without a prompt.
BAD_ROW = "row missing a string 'prompt' field"
# Dollars of a job and of all runs, share of retries.
JOB_SPEND_CAP, LEDGER_CAP, RETRY_SHARE = 0.25, 1.00, 0.20

#: RESPONSES: ts is when the call began, headers what came with the answer. Prompts with RESPONSES, attempt, failure_class and
#: max_attempts are the log that the studies of operators/telemetry.py read.
PROMPTS = "job_id string, seq long, item_id string, prompt string, model string, max_tokens int"
RESPONSES = "http_status int, transport_error string, malformed boolean, response_text string, input_tokens long, output_tokens long, latency_s double, headers map<string,string>, ts timestamp"
RESULTS = "job_id string, seq long, item_id string, status string, response_text string, input_tokens long, output_tokens long, latency_s double, attempt int, failure_class string, message string, http_status int"
