"""From attempts to one outcome per item, and the audit that none is lost."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.scalar import is_fatal, is_retryable, retry_limit
from promptloom.jobs.workdir import work_path
from promptloom.operators.ordered import numbered

KEY = ["job_id", "item_id"]
# Messages of results. A fatal response, one that no attempt is left for, one that the budget has no retry for; the
# reason of a job's abort (class, code); items of a cancelled job.
FATAL_MESSAGE, EXHAUSTED_MESSAGE, BUDGET_MESSAGE = "fatal: HTTP ", "max attempts exhausted", "retry budget exhausted"
ABORTED_MESSAGE, CANCELLED_MESSAGE = "%s (HTTP %d)", "job cancelled before dispatch"


def same(*names: str) -> Column:
    """Whether pairs of columns (a, b, a, b ...) are equal, null to null."""
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names[::2], names[1::2], strict=True)))


def _named(df: DataFrame, *more: str) -> DataFrame:
    """df with its key under other names, and the columns in more."""
    return df.select(F.col("job_id").alias("_job"), F.col("item_id").alias("_item"), *more)


_SAME_KEY = ("job_id", "_job", "item_id", "_item")


ENDS_ITEM = "(failure_class NOT IN ('throttled', 'transient') OR attempt >= max_attempts)"


def ends_item() -> Column:
    """Whether an attempt is its item's last: a success, a class that isn't retried, or the last attempt that its class allows."""
    return F.expr(ENDS_ITEM)


def outcome_columns(exhausted_message: Column | None = None, code: Column | None = None) -> dict[str, Column]:
    """status, final_class and message of a terminal attempt. code: its HTTP status."""
    code = F.col("http_status") if code is None else code
    worn = F.lit(EXHAUSTED_MESSAGE) if exhausted_message is None else exhausted_message
    return {
        "status": F.expr("CASE WHEN failure_class = 'success' THEN 'success' ELSE 'error' END"),
        "final_class": F.expr("CASE WHEN failure_class = 'success' THEN NULL WHEN failure_class IN ('throttled', 'transient') THEN 'transient_exhausted' ELSE failure_class END"),
        "message": F.when(is_fatal(), F.concat(F.lit(FATAL_MESSAGE), F.coalesce(code.cast("string"), F.lit("None")))).when(F.expr("failure_class <> 'success'"), worn),
    }


def attempt_outcomes(classified: DataFrame) -> DataFrame:
    """The first terminal attempt of each item with its outcome; later ones don't count. One aggregation by item; which attempts
    end an item is a condition in it, as a filter would be pushed below whatever made the attempts and be computed twice."""
    rest = [c for c in classified.columns if c not in KEY]
    first = classified.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.when(ends_item(), F.col("attempt"))).alias("r")).where("r is not null")
    return first.select(*KEY, "r.*").withColumns(outcome_columns(code=None if "http_status" in rest else F.lit(None)))


def _cut(df: DataFrame) -> DataFrame:
    """Written and read back: a later wave's plan starts here."""
    path = work_path(df.sparkSession, "wave")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_retry_budget(classified: DataFrame, ingested: DataFrame, waves: int = 8) -> DataFrame:
    """Outcomes when a job may issue only retry_limit(ingested) retries: classified has an item's attempts in advance (attempt
    1..waves); ingested has job_id, n. In each wave the items that want a retry get it in the order of seq while the job's budget
    lasts; the others end as exhausted. Every wave handles only what the last one left, and ranks it by ranges of seq."""
    limits = ingested.select("job_id", retry_limit("n").alias("limit"))
    attempts = _cut(classified)
    going, done = attempts.where("attempt = 1").join(limits, "job_id").withColumn("used", F.lit(0).cast("long")), None
    for wave in range(1, waves + 1):
        going = _cut(going)
        over = going.where(ends_item()).withColumns(outcome_columns())
        wants = going.where(~ends_item())
        ranked = numbered(wants, ["job_id"], F.floor(F.col("seq") / 100_000), ["seq", "item_id"], "rank")
        ranked = _cut(ranked.withColumn("granted", F.col("used") + F.col("rank") <= F.col("limit")))
        refused = ranked.where("not granted").drop("rank", "granted").withColumns(outcome_columns(F.lit(BUDGET_MESSAGE)))
        part = over.unionByName(refused)
        done = part if done is None else done.unionByName(part)
        if wave == waves:
            break
        issued = ranked.where("granted").groupBy("job_id").agg(F.count("*").alias("issued"))
        again = ranked.where("granted").select(*KEY, "limit", "used").join(issued, "job_id").select(*KEY, "limit", (F.col("used") + F.col("issued")).alias("used"))
        going = attempts.where(F.col("attempt") == wave + 1).join(again, KEY)
    return done.drop("limit", "used")


def pending_prompts(prompts: DataFrame, results: DataFrame) -> DataFrame:
    """Prompts without a result: what is left to do after a stop. Null ids are equal to each other."""
    return prompts.join(_named(results), same(*_SAME_KEY), "left_anti")


def reconcile(prompts: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, item_id, expected, found, verdict (ok, missing, duplicate, unexpected). Both sides are counted by item before
    they meet, on the same key. Null ids are equal to each other."""
    want = prompts.groupBy(*KEY).agg(F.count("*").alias("expected"))
    have = _named(results.groupBy(*KEY).agg(F.count("*").alias("found")), "found")
    both = want.join(have, same(*_SAME_KEY), "full_outer").na.fill(0, ["expected", "found"])
    both = both.select(F.coalesce("job_id", "_job").alias("job_id"), F.coalesce("item_id", "_item").alias("item_id"), "expected", "found")
    verdict = F.when(F.col("expected") == 0, "unexpected").when(F.col("found") == 0, "missing").when((F.col("found") > 1) | (F.col("expected") > 1), "duplicate").otherwise("ok")
    return both.withColumn("verdict", verdict)


def conservation(prompts: DataFrame, results: DataFrame) -> DataFrame:
    """One row a job: counts of each verdict, and conserved."""
    r = reconcile(prompts, results)
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "missing", "duplicate", "unexpected")]
    return r.groupBy("job_id").agg(*counts).withColumn("conserved", F.expr("missing + duplicate + unexpected = 0"))


def fatal_cutoffs(attempts: DataFrame) -> DataFrame:
    """job_id, cutoff_seq, failure_class, http_status of each job's first fatal attempt."""
    first = attempts.where(is_fatal()).groupBy("job_id").agg(F.min_by(F.struct("seq", "failure_class", "http_status"), "seq").alias("c"))
    return first.select("job_id", F.col("c.seq").alias("cutoff_seq"), "c.failure_class", "c.http_status")


def apply_cutoffs(items: DataFrame, cutoffs: DataFrame, cancels: DataFrame) -> DataFrame:
    """items (job_id, seq, item_id) with failure_class and message of those not dispatched: after the job's cancel_seq (checked
    first) or after its cut-off: the first fatal attempt, or what abort_reason says. One row a job on the small sides."""
    reason = F.col("abort_reason") if "abort_reason" in cutoffs.columns else F.lit(None).cast("string")
    fatal = cutoffs.select("job_id", "cutoff_seq", F.col("failure_class").alias("_class"), F.coalesce(reason, F.format_string(ABORTED_MESSAGE, "failure_class", "http_status")).alias("_why"))
    x = items.join(cancels.select("job_id", "cancel_seq"), "job_id", "left").join(fatal, "job_id", "left")
    cancelled, aborted = F.col("seq") > F.col("cancel_seq"), F.col("seq") > F.col("cutoff_seq")
    return x.select(
        *items.columns,
        F.when(cancelled, "cancelled").when(aborted, F.col("_class")).alias("failure_class"),
        F.when(cancelled, CANCELLED_MESSAGE).when(aborted, F.col("_why")).alias("message"),
    )


def latest_result(results: DataFrame) -> DataFrame:
    """One row an item of an at-least-once log: a success before an error, then the newest."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(F.col("status") == "success"), F.desc("log_seq"))
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_outcomes(row_errors: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Errors of intake and outcomes of scoring in one table."""
    return outcomes.unionByName(row_errors, allowMissingColumns=True)
