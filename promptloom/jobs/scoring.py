"""The wave driver: prompts to attempts and results, every call paid once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.functions.scalar import classify, cost_nanos, is_fatal, retry_due_s, retry_limit
from promptloom.jobs.responders import Caller
from promptloom.jobs.stops import STOPPED, Stops
from promptloom.operators.ordered import numbered
from promptloom.operators.outcomes import ABORTED_MESSAGE, BUDGET_MESSAGE, CANCELLED_MESSAGE, ENDS_ITEM, EXHAUSTED_MESSAGE, ends_item, outcome_columns, pending_prompts, same
from promptloom.operators.telemetry import spend_reason
from promptloom.schemas import MAX_WAVES

Attempt = Callable[[DataFrame], DataFrame]
#: Waiting rows of a job up to which one window ranks them; more are ranked by ranges of seq. Rows of such a range.
WINDOW_ROWS, RANGE_ROWS = 1_000_000, 100_000
#: Jobs whose rows pass through the driver between steps.
DRIVER_JOBS = 10_000
#: How many times as many first attempts the next slice of a job has.
GROWTH = 10


@dataclass
class Policy:
    """budget_share: retries a job may issue per item. chunk: first attempts of a job that are launched together; every later
    slice has GROWTH times as many, and a job that is stopped launches no further one (0: all at once). max_items: prompts of a
    job that are taken in, in the order of seq (None: all). spend_cap: dollars at which a job is stopped, by its cost or the
    projection of its cost on all items taken in (None: no cap). cancelled: asked after every step (0, 1, ...) for the jobs to
    stop. audit: compare what was taken in with the results, and raise if an item is lost or there twice. start: the seconds of the
    epoch at which first attempts are due (None: at once). waits: no retry before it is due (scalar.retry_due_s)."""

    budget_share: float = 0.20
    chunk: int = 0
    waves: int = MAX_WAVES
    max_items: int | None = None
    spend_cap: float | None = None
    cancelled: Callable[[int], Sequence[str]] | None = None
    audit: bool = True
    start: float | None = None
    waits: bool = True


@dataclass
class Scored:
    results: DataFrame
    attempts: DataFrame
    ingested: DataFrame
    stopped: DataFrame
    paths: list[str] = field(default_factory=list)


class NotConserved(RuntimeError):
    """Items taken in and results differ."""


def _stored(spark: SparkSession, df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write once; a path that is complete already is read instead, so a restart repeats no call."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _made(df: DataFrame, attempt: Attempt, stops: Stops) -> DataFrame:
    """Attempts, classified, in the columns of the log whatever attempt leaves out. Only rows that may be retried keep their prompt.
    Rows that were not called, as their job was stopped, wait, with the attempts that they had."""
    made = attempt(df, stops) if isinstance(attempt, Caller) else attempt(df)
    for name, kind in (("headers", "map<string,string>"), ("ts", "timestamp"), ("stopped", STOPPED)):
        if name not in made.columns:
            made = made.withColumn(name, F.lit(None).cast(kind))
    made = classify(made)
    if isinstance(attempt, Caller):
        left = F.col("stopped").isNotNull()
        made = made.withColumns({"max_attempts": F.when(left, F.col("attempt") + 1).otherwise(F.col("max_attempts")), "attempt": F.when(left, F.greatest(F.lit(1), F.col("attempt") - 1)).otherwise(F.col("attempt"))})
    return made.withColumn("prompt", F.when(~ends_item(), F.col("prompt")))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _slices(prompts: DataFrame, path: str, policy: Policy) -> list[DataFrame]:
    """The prompts that are taken in, in slices that are launched one after another. Ranks are counted once, by ranges of seq."""
    if not policy.chunk and policy.max_items is None:
        return [prompts]
    spark = prompts.sparkSession
    ranked = numbered(prompts, ["job_id"], F.floor(F.col("seq") / RANGE_ROWS), ["seq", "item_id"], "_rank")
    if policy.max_items is not None:
        ranked = ranked.where(F.col("_rank") <= policy.max_items)
    ends, at = [], policy.chunk
    while policy.chunk and at < 1 << 62:
        ends.append(at)
        at += policy.chunk * GROWTH ** len(ends)
    number = sum(((F.col("_rank") > e).cast("int") for e in ends), F.lit(0))
    stored = _stored(spark, ranked.select(*prompts.columns, number.alias("_slice")), f"{path}/slices", "_slice")
    last = stored.agg(F.max("_slice")).first()[0] or 0
    return [stored.where(F.col("_slice") == s).drop("_slice") for s in range(last + 1)]


def _jobs(made: DataFrame, before: DataFrame | None, first: bool, step: int, last: bool, policy: Policy) -> DataFrame:
    """A row a job after a step: n (items taken in), done, nanos (spent), wants (items that wait for a retry), used (retries
    granted so far), grant (how many of those that wait get one), left (retries after that), stop_class and stop_message."""
    x = made.groupBy("job_id").agg(
        F.count("*").alias("rows"),
        F.count_if(ends_item()).alias("ended"),
        F.sum(F.when(F.expr("failure_class = 'success'"), cost_nanos())).alias("paid"),
        F.min_by(F.struct("failure_class", "http_status"), F.when(is_fatal(), F.col("seq"))).alias("fatal"),
        F.max("stopped").alias("halted"),
    )
    if before is None:
        x = x.selectExpr("*", *(f"0L AS {c}" for c in ("n", "done", "nanos", "wants", "used", "grant", "left")), "CAST(NULL AS STRING) AS stop_class", "CAST(NULL AS STRING) AS stop_message")
    else:
        x = before.withColumnRenamed("job_id", "_job").join(x, same("_job", "job_id"), "left").drop("job_id").withColumnRenamed("_job", "job_id")
    rows, ended, spent = (f"coalesce({c}, 0L)" for c in ("rows", "ended", "paid"))
    # the first attempts so far are counted anew; a later wave adds to what was done, as do those that got no retry
    counts = (rows, ended, spent) if first else ("n", f"done + wants - grant + {ended}", f"nanos + {spent}")
    x = x.selectExpr("job_id", *(f"{c} AS {k}" for c, k in zip(counts, ("n", "done", "nanos"), strict=True)), f"{rows} - {ended} AS wants", "used", "fatal", "halted", "stop_class", "stop_message")

    stops: list[tuple[Column, Column, Column]] = []
    jobs = list(policy.cancelled(step)) if policy.cancelled else []
    if jobs:
        stops.append((F.col("job_id").isin(jobs), F.lit("cancelled"), F.lit(CANCELLED_MESSAGE)))
    stops.append((F.col("fatal").isNotNull(), F.col("fatal.failure_class"), F.format_string(ABORTED_MESSAGE, "fatal.failure_class", "fatal.http_status")))
    if policy.spend_cap is not None:
        cost = F.col("nanos") / 1e9
        projected = cost / F.greatest(F.col("done"), F.lit(1)) * F.greatest("n", "done")
        stops.append(((F.col("done") > 0) & ((cost >= policy.spend_cap) | (projected >= policy.spend_cap)), F.lit("fatal_auth"), spend_reason(cost, projected, policy.spend_cap)))
    stops.append((F.col("halted").isNotNull(), F.col("halted.stop_class"), F.col("halted.stop_message")))
    found = F.when(F.expr("stop_class IS NOT NULL"), F.struct("stop_class", "stop_message"))
    for when, kind, text in stops:
        found = found.when(when, F.struct(kind.alias("stop_class"), text.alias("stop_message")))
    x = x.withColumn("_s", found).withColumn("_limit", retry_limit("n", policy.budget_share))
    grant = "0L" if last else "CASE WHEN _s IS NULL THEN least(wants, greatest(0L, _limit - used)) ELSE 0L END"
    left = "0L" if last else f"IF(_s IS NULL, greatest(0L, _limit - used - {grant}), 0L)"
    return x.selectExpr("job_id", "n", "done", "nanos", "wants", f"used + {grant} AS used", f"{grant} AS grant", f"{left} AS left", "_s.stop_class", "_s.stop_message")


def _settled(jobs: DataFrame, path: str, policy: Policy) -> tuple[DataFrame, Row]:
    """The rows of jobs, for good, and of all of them: items that wait, retries granted and left, and the most that wait in a job
    where only some get one. Up to DRIVER_JOBS rows pass through the driver, as they follow from written attempts; more, and any
    in which cancelling may have had a part, are written."""
    spark = jobs.sparkSession
    if not policy.cancelled:
        few = jobs.limit(DRIVER_JOBS + 1).toArrow()
        if few.num_rows <= DRIVER_JOBS:
            rows = few.select(["wants", "grant", "left"]).to_pylist()
            partial = max((r["wants"] for r in rows if 0 < r["grant"] < r["wants"]), default=None)
            return spark.createDataFrame(few, jobs.schema), Row(wants=sum(r["wants"] for r in rows), grants=sum(r["grant"] for r in rows), left=sum(r["left"] for r in rows), partial=partial)
    jobs = _stored(spark, jobs, path)
    return jobs, jobs.selectExpr("sum(wants) AS wants", "sum(grant) AS grants", "sum(left) AS left", "max(IF(grant > 0 AND grant < wants, wants, NULL)) AS partial").first()


def _later(wave: DataFrame, jobs: DataFrame, total: Row, step: int, last: bool, path: str, policy: Policy) -> tuple[DataFrame, Row]:
    """The rows of jobs and their total after a later wave. Where no retry is left and no job can stop, one count tells all."""
    if not total["left"] and policy.spend_cap is None and not policy.cancelled:
        seen = wave.selectExpr(f"count_if(NOT {ENDS_ITEM}) AS wants", "count_if(failure_class IN ('fatal_auth', 'fatal_billing') OR stopped IS NOT NULL) AS fatal").first()
        if not seen["fatal"]:
            return jobs.withColumn("grant", F.lit(0).cast("long")), Row(wants=seen["wants"], grants=0, left=0, partial=None)
    return _settled(_jobs(wave, jobs, False, step, last, policy), f"{path}/jobs/step={step}", policy)


def _refused(worn: bool) -> dict[str, Column]:
    """Columns of items that get no retry: their job was stopped, its retries are used up, or (worn) no wave is left."""
    return {
        "status": F.lit("error"),
        "final_class": F.expr("coalesce(stop_class, 'transient_exhausted')"),
        "message": F.coalesce("stop_message", F.lit(EXHAUSTED_MESSAGE if worn else BUDGET_MESSAGE)),
        "http_status": F.expr("IF(stop_class IS NULL, http_status, NULL)"),
    }


def _checked(taken: DataFrame, results: DataFrame) -> None:
    """Raise unless both have the same items equally often: counts and order-free checksums of the keys of each job."""
    key = "xxhash64(job_id, item_id)"
    sides = taken.selectExpr("job_id", "1L AS side", f"{key} AS key").unionByName(results.selectExpr("job_id", "-1L AS side", f"{key} AS key"))
    sums = [F.expr(x) for x in ("sum(side) AS n", "sum(side * (key & 4294967295L)) AS low", "bit_xor(key) AS xor")]
    odd = [r.job_id for r in sides.groupBy("job_id").agg(*sums).where("n <> 0 OR low <> 0 OR xor <> 0").select("job_id").limit(10).collect()]
    if odd:
        raise NotConserved(f"items taken in and results differ in {', '.join(map(str, odd))}")


def score(prompts: DataFrame, attempt: Attempt, path: str, policy: Policy | None = None) -> Scored:
    """prompts: PROMPTS. attempt(df) makes one attempt for each row of df (prompts, attempt, due_s) and adds RESPONSES; headers and
    ts may be missing. Tables below path: slices, attempts of each wave, and a row a job after a step. What is decided between
    waves follows from these tables alone. The attempts of the result are a log as operators/telemetry.py reads it.

    A retry is due after a back-off and, when it was throttled, after the reset that its headers name. A Caller waits until then,
    and its tasks tell each other of a fatal response or a reached spend cap, so that a wave ends within a few calls: rows that
    were not called end in the class of the stop.

    A wave sees only the rows that the last one left, and the driver holds none of them. A job stops when it is cancelled, at a
    fatal response or when its spending reaches the cap, whichever is seen first after a step: items that wait end in that class
    and later slices are not taken in. Null job_ids are a job of their own. A restart with the same path repeats no call.
    """
    policy = policy or Policy()
    spark, step = prompts.sparkSession, 0
    stops = Stops(f"{path}/stops", policy.spend_cap)
    begin = {"attempt": F.lit(1), "due_s": F.lit(policy.start).cast("double")}
    slices = _slices(prompts, path, policy)
    firsts: list[DataFrame] = []
    taken: list[DataFrame] = []
    jobs, total = None, Row(wants=0, grants=0, left=0, partial=None)
    for s, part in enumerate(slices):
        if jobs is not None:
            halted = jobs.where("stop_class is not null").select(F.col("job_id").alias("_job"))
            part = part.join(halted, same("job_id", "_job"), "left_anti")
        firsts.append(_stored(spark, _made(part.withColumns(begin), attempt, stops), f"{path}/attempts/wave=1-{s}"))
        taken.append(part.select("job_id", "item_id"))
        begun = jobs.select("job_id", *(F.lit(0).cast("long").alias(c) if c in ("wants", "used", "grant", "left") else c for c in jobs.columns[1:])) if jobs is not None else None
        jobs, total = _settled(_jobs(_union(firsts), begun, True, step, policy.waves <= 1, policy), f"{path}/jobs/step={step}", policy)
        step += 1

    wave, attempts, outcomes, ingested = _union(firsts), [*firsts], [], jobs.select("job_id", "n")
    kept = wave.columns
    for k in range(1, policy.waves + 1):
        outcomes.append(wave.where(ends_item()).withColumns(outcome_columns()))
        if k > 1:
            jobs, total = _later(wave, jobs, total, step, k == policy.waves, path, policy)
            step += 1
        if not total["wants"]:
            break
        told = jobs.select(F.col("job_id").alias("_job"), "grant", "stop_class", "stop_message")
        waiting = wave.where(~ends_item()).join(told, same("job_id", "_job")).drop("_job")
        lost = waiting
        if total["grants"]:
            # equal rows aside, ranks are the same whenever they are computed
            order = ("seq", "item_id", F.xxhash64("prompt", "http_status", "response_text", "latency_s"))
            if total["partial"] is None:
                granted = F.col("grant") > 0
            elif total["partial"] <= WINDOW_ROWS:
                waiting = waiting.withColumn("_rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))
                granted = F.col("_rank") <= F.col("grant")
            else:
                waiting = numbered(waiting, ["job_id"], F.floor(F.col("seq") / RANGE_ROWS), order, "_rank")
                granted = F.col("_rank") <= F.col("grant")
            due = retry_due_s() if policy.waits else F.lit(None).cast("double")
            again = waiting.where(granted).select(*prompts.columns, (F.col("attempt") + 1).alias("attempt"), due.alias("due_s"))
            wave = _stored(spark, _made(again, attempt, stops), f"{path}/attempts/wave={k + 1}")
            attempts.append(wave)
            lost = waiting.where(~granted)
        outcomes.append(lost.withColumns(_refused(k == policy.waves)).select(*kept, "status", "final_class", "message"))
        if not total["grants"]:
            break
    good = "IF(status = 'success', {0}, NULL) AS {0}"
    results = _union(outcomes).selectExpr(
        "job_id",
        "seq",
        "item_id",
        "status",
        *(good.format(c) for c in ("response_text", "input_tokens", "output_tokens", "latency_s")),
        "attempt",
        "final_class AS failure_class",
        "message",
        "IF(status = 'success', NULL, http_status) AS http_status",
    )
    if policy.audit:
        _checked(_union(taken), results)
    log = _union(attempts).where("stopped IS NULL").drop("stopped")
    return Scored(results, log, ingested, jobs.where("stop_class is not null").select("job_id", "stop_class", F.col("stop_message").alias("abort_reason")))


def resume(prompts: DataFrame, earlier: DataFrame, attempt: Attempt, path: str, policy: Policy | None = None) -> DataFrame:
    """Results of all prompts: earlier ones as they are, the rest scored."""
    return earlier.unionByName(score(pending_prompts(prompts, earlier), attempt, path, policy).results)
