"""Stops inside a wave: files by which tasks tell each other that a job has come to its end."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from typing import Any

import pandas as pd

from promptloom.schemas import DEFAULT_MODEL, PRICES, STATUS_CLASSES

STOPPED = "struct<stop_class: string, stop_message: string>"
# The class and message with which a fatal response ends a job; the text of a breached spend cap, whose items are
# classed fatal_auth.
FATAL, ABORTED, SPENT = ("fatal_auth", "fatal_billing"), "%s (HTTP %d)", "spend guard: cost $%.4f / projected $%.4f >= cap $%s"


class Stops:
    """A folder of the run that all tasks share (any file system that pyarrow knows by its URI). A job's first fatal response, or
    the outcome at which what all tasks have spent on it reaches the cap, leaves a marker; tasks look for it between calls, at most
    every look_s seconds a job. Spending is told every `every` outcomes of a task, so that a cap is seen after at most so many
    calls of each task beyond it."""

    def __init__(self, folder: str, spend_cap: float | None = None, every: int = 50, look_s: float = 0.2):
        self.folder, self.spend_cap, self.every, self.look_s = folder, spend_cap, every, look_s
        self._clear()

    def _clear(self) -> None:
        self._fs: Any = None
        self._known: dict[Any, dict] = {}
        self._looked: dict[Any, float] = {}
        self._own: dict[Any, list[int]] = {}
        self._task = "0"

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._clear()

    def begin(self, task: Any) -> None:
        """Name the spending of a task by its partition and stage, so that a repeated one replaces what it told before."""
        self._clear()
        if task is not None:
            self._task = f"{task.stageId()}-{task.partitionId()}"

    def end(self) -> None:
        for job in list(self._own):
            self._tell(job)

    def _place(self, job: Any, name: str = "") -> str:
        if self._fs is None:
            from pyarrow import fs

            uri = self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}"
            uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri
            self._fs, self._root = fs.FileSystem.from_uri(uri)
        return f"{self._root}/{hashlib.md5(repr(job).encode()).hexdigest()}" + (f"/{name}" if name else "")

    def _put(self, job: Any, name: str, value: dict) -> None:
        """Whole or not at all: a file of another name is moved to its place."""
        place = self._place(job)
        self._fs.create_dir(place, recursive=True)
        draft = f"{place}/.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(draft) as f:
            f.write(json.dumps(value).encode())
        self._fs.move(draft, f"{place}/{name}")

    def _get(self, place: str) -> dict | None:
        try:
            with self._fs.open_input_stream(place) as f:
                return json.loads(f.read())
        except (FileNotFoundError, ValueError):
            return None

    def told(self, job: Any) -> dict | None:
        """Why the job is stopped, if it is."""
        if job in self._known:
            return self._known[job]
        now = time.monotonic()
        if now - self._looked.get(job, -1e9) >= self.look_s:
            self._looked[job] = now
            if found := self._get(self._place(job, "stop")):
                self._known[job] = found
        return self._known.get(job)

    def stop(self, job: Any, stop_class: str, message: str) -> None:
        if job not in self._known:
            self._known[job] = {"stop_class": stop_class, "stop_message": message}
            self._put(job, "stop", self._known[job])

    def seen(self, rows: pd.DataFrame, answers: pd.DataFrame) -> None:
        """What calls have brought: fatal responses and spending."""
        jobs = rows["job_id"].tolist()
        columns = [answers[c].tolist() for c in ("http_status", "malformed", "input_tokens", "output_tokens")]
        for i, (job, status, bad, given, made) in enumerate(zip(jobs, *columns, strict=True)):
            kind = STATUS_CLASSES.get(status, ("", 0))[0] if status is not None and status == status else ""
            if kind in FATAL:
                self.stop(job, kind, ABORTED % (kind, status))
            if self.spend_cap is not None:
                model = rows["model"].iloc[i] if "model" in rows else DEFAULT_MODEL
                price = PRICES.get(model, PRICES[DEFAULT_MODEL])
                own = self._own.setdefault(job, [0, 0])
                own[0] += 1
                if kind == "success" and not bad:
                    own[1] += int(given) * round(price[0] * 1000) + int(made) * round(price[1] * 1000)
                if own[0] % self.every == 0:
                    self._tell(job)

    def _tell(self, job: Any) -> None:
        done, nanos = self._own[job]
        self._put(job, f"spent-{self._task}", {"done": done, "nanos": nanos})
        from pyarrow import fs

        files = self._fs.get_file_info(fs.FileSelector(self._place(job)))
        told = [t for f in files if f.base_name.startswith("spent-") and (t := self._get(f.path))]
        cost = sum(t["nanos"] for t in told) / 1e9
        if self.spend_cap is not None and cost >= self.spend_cap:
            self.stop(job, "fatal_auth", SPENT % (cost, cost, self.spend_cap))
