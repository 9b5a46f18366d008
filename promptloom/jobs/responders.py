"""Responders: who answers prompts. HTTP errors are data, not exceptions."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from queue import Empty, SimpleQueue
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.jobs.stops import STOPPED, Stops
from promptloom.schemas import RESPONSES

NAMES = [c.split()[0] for c in RESPONSES.split(", ")]
#: What a responder may leave out: measured, or none.
OPTIONAL = ("latency_s", "headers", "ts")


class Responder(Protocol):
    """Answers a batch: prompt, model, max_tokens -> the columns of RESPONSES, in the same order of rows; those in OPTIONAL may be
    missing. One is made for each call in flight of a task, so that it may keep a connection."""

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def spaced(max_rps: float, slots: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[int], float]:
    """wait(n) for one of `slots` tasks that share a quota: returns when n calls may be made, and when that is. Calls lie slots /
    max_rps seconds apart; time that was not used is not made up for. A task so makes at most one call more than its share in
    any span of time, or n - 1 where n are made at once."""
    gap, due = slots / max_rps, clock()

    def wait(n: int) -> float:
        nonlocal due
        while (now := clock()) < due:
            sleep(due - now)
        due = max(due, now) + n * gap
        return now

    return wait


def _failed(text: str, n: int) -> pd.DataFrame:
    return pd.DataFrame({"http_status": None, "transport_error": text, "malformed": False, "response_text": None, "input_tokens": 0, "output_tokens": 0}, index=range(n))


class Calls:
    """The calls of one task: up to in_flight at once, none before its rows are due, answers in the order of rows.

    A call that takes longer than deadline_s is given up: its rows fail, its thread is left alone and its responder not used again.
    Rows of a job that is stopped are not called; they come back with `stopped` and no answer."""

    def __init__(
        self,
        make_responder: Callable[[], Responder],
        wait: Callable[[int], float] = lambda n: 0.0,
        batch: int = 1,
        in_flight: int = 1,
        deadline_s: float | None = None,
        stops: Stops | None = None,
        clock: Callable[[], float] = time.time,
        sleep: Callable[[float], None] = time.sleep,
    ):
        self.make, self.wait, self.batch, self.in_flight, self.deadline_s, self.stops, self.clock, self.sleep = make_responder, wait, batch, in_flight, deadline_s, stops, clock, sleep
        self.idle: list[Responder] = []
        self.over: SimpleQueue = SimpleQueue()

    def _answer(self, part: pd.DataFrame) -> pd.DataFrame:
        began, at = self.clock(), time.perf_counter()
        try:
            responder = self.idle.pop() if self.idle else self.make()
            try:
                got = responder(part)
            finally:
                self.idle.append(responder)
            if len(got) != len(part):
                raise ValueError(f"{len(got)} responses for {len(part)} prompts")
            got = got.reset_index(drop=True)
            got = got[[c for c in NAMES if c in got or c not in OPTIONAL]]
        except Exception as e:  # any failure of user code is data
            got = _failed(f"unexpected error: {e}", len(part))
        return self._filled(got, began, time.perf_counter() - at)

    def _filled(self, got: pd.DataFrame, began: float | None, took: float) -> pd.DataFrame:
        ts = pd.NaT if began is None else pd.Timestamp(round(began * 1e6), unit="us", tz="UTC")
        for name, value in zip(OPTIONAL, (took, None, ts), strict=True):
            if name not in got:
                got[name] = [value] * len(got)
        return got.astype("object")[NAMES]

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        """rows with answers, granted_s and stopped."""
        starts = range(0, len(rows), self.batch)
        parts = [rows.iloc[s : s + self.batch].reset_index(drop=True) for s in starts]
        answers: list[pd.DataFrame | None] = [None] * len(parts)
        granted: list[list[float | None]] = [[None] * len(p) for p in parts]
        stopped: list[list[dict | None]] = [[None] * len(p) for p in parts]
        running: dict[int, tuple[float, float]] = {}

        def finish(i: int, got: pd.DataFrame) -> None:
            answers[i] = got
            if self.stops:
                self.stops.seen(parts[i], got)

        def collect(until: int) -> None:
            """Take answers until at most so many calls are running."""
            while len(running) > until:
                limit = min(t for _, t in running.values()) - time.monotonic() if self.deadline_s else None
                try:
                    i, got = self.over.get(timeout=max(0.0, limit) if limit is not None else None)
                    if running.pop(i, None):
                        finish(i, got)
                except Empty:
                    now = time.monotonic()
                    for i in [k for k, (_, t) in running.items() if t <= now]:
                        began, _ = running.pop(i)
                        finish(i, self._filled(_failed(f"no answer in {self.deadline_s} s", len(parts[i])), began, float(self.deadline_s)))

        for i, part in enumerate(parts):
            collect(self.in_flight - 1)
            if self.stops:
                told = [self.stops.told(j) for j in part["job_id"]]
                if any(told):
                    stopped[i] = told
                    if not all(told):  # rows of one call are of several jobs: those that go on are called alone
                        keep = [k for k, t in enumerate(told) if not t]
                        whole = self._filled(_failed("", len(part)).assign(transport_error=None), None, 0.0)
                        self._due(part.iloc[keep])
                        granted_at = self.wait(len(keep))
                        got = self._answer(part.iloc[keep].reset_index(drop=True))
                        for at, k in enumerate(keep):
                            granted[i][k] = granted_at
                            whole.iloc[k] = got.iloc[at]
                        finish(i, whole)
                    else:
                        answers[i] = self._filled(_failed("", len(part)).assign(transport_error=None), None, 0.0)
                    continue
            self._due(part)
            granted[i] = [self.wait(len(part))] * len(part)
            if self.in_flight == 1 and not self.deadline_s:
                finish(i, self._answer(part))
                continue
            running[i] = (self.clock(), time.monotonic() + (self.deadline_s or 0))
            threading.Thread(target=lambda i=i, part=part, over=self.over: over.put((i, self._answer(part))), daemon=True).start()
        collect(0)
        if not parts:
            return rows
        out = pd.concat([rows.reset_index(drop=True), pd.concat(answers, ignore_index=True)], axis=1)
        out["ts"] = pd.to_datetime(out["ts"], utc=True)
        out["granted_s"] = pd.Series([g for x in granted for g in x], dtype="float64")
        out["stopped"] = pd.Series([s for x in stopped for s in x], dtype="object")
        return out

    def _due(self, part: pd.DataFrame) -> None:
        """Sleep until the rows may be called."""
        if "due_s" in part and not part["due_s"].isna().all():
            due = float(part["due_s"].max())
            while (now := self.clock()) < due:
                self.sleep(due - now)


def run_attempts(
    prompts: DataFrame, make_responder: Callable[[], Responder], slots: int, max_rps: float | None = None, batch: int = 1, in_flight: int = 1, deadline_s: float | None = None, stops: Stops | None = None
) -> DataFrame:
    """One attempt for each row (with the columns it has), in `slots` tasks at once with in_flight calls each. What a responder, or
    making one, raises is a transport failure of the rows it was called for, and so is no answer in deadline_s; no row is lost. With
    batch > 1 it gets so many rows at once, which then fail together: for responders that catch what a row raises. Rows with
    due_s (seconds of the epoch) are called in its order, not before it. max_rps is a quota of all tasks.

    stops: where tasks tell each other that a job goes on no further; rows that are not called for it have `stopped`. The caller
    writes the result before it is used, so that no call is made twice; speculation should be off."""
    fields = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes)
    dealt = prompts.repartition(slots)
    dealt = dealt.sortWithinPartitions("due_s") if "due_s" in prompts.columns else dealt

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if stops:
            stops.begin(TaskContext.get())
        calls = Calls(make_responder, spaced(max_rps, slots) if max_rps else lambda n: 0.0, batch, in_flight, deadline_s, stops)
        for b in batches:
            if len(b):
                yield calls.run(b)
        if stops:
            stops.end()

    out = dealt.mapInPandas(run, f"{fields}, {RESPONSES}, granted_s double, stopped {STOPPED}")
    return out if stops else out.drop("stopped")


@dataclass
class Caller:
    """run_attempts as an attempt for score, which gives it the stops of its run."""

    make_responder: Callable[[], Responder]
    slots: int
    max_rps: float | None = None
    batch: int = 1
    in_flight: int = 1
    deadline_s: float | None = None

    def __call__(self, prompts: DataFrame, stops: Stops | None = None) -> DataFrame:
        return run_attempts(prompts, self.make_responder, self.slots, self.max_rps, self.batch, self.in_flight, self.deadline_s, stops).drop("granted_s")
