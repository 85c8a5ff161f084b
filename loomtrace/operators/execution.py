"""Plans of tasks run over the cluster, and the registry of their attempts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import Conflict, Manifests

RETRIES = 3
TERMINAL = ("succeeded", "failed", "cancelled")


def execute(tasks: DataFrame, run: Callable[[dict], object], key: str = "task_id", done: DataFrame | None = None, retries: int = RETRIES) -> DataFrame:
    """key, status, attempts, result (JSON) and error for every task of which ``done`` knows nothing; each task is claimed once.

    A task that fails is tried again up to ``retries`` times in all and then set aside as ``quarantined``; the others go on. Tasks are
    independent of each other, so a lost executor costs the tasks it held, and what is in flight is bounded by the cluster's cores.
    Of tasks with one key the first by content runs.
    """
    first = tasks.groupBy(key).agg(F.min(F.to_json(F.struct(*tasks.columns))).alias("task"))
    todo = first if done is None else first.join(done.select(key).distinct(), key, "left_anti")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, task in zip(rows[key], rows["task"], strict=True):
                for attempt in range(1, retries + 1):
                    try:
                        row = (name, "succeeded", attempt, json.dumps(run(json.loads(task)), default=str), None)
                        break
                    except Exception as e:  # the policy: a task that fails does not fail the plan
                        row = (name, "quarantined", attempt, None, f"{type(e).__name__}: {e}"[:500])
                out.append(row)
            yield pd.DataFrame(out, columns=[key, "status", "attempts", "result", "error"])

    return todo.mapInPandas(work, f"{key} {dict(tasks.dtypes)[key]}, status string, attempts int, result string, error string")


class AttemptRegistry:
    """Attempts of runs: active under a lease, kept alive, and ended once; the higher epoch of a run wins.

    Each change is a numbered manifest, so of two writers one is told to look again; a change that its epoch or the attempt's
    state does not allow is refused (False).
    """

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self._log, self._clock = Manifests(spark, path), clock

    def get(self, run: str) -> dict | None:
        """The run's attempt, or None; ``alive`` tells whether it is active and its lease runs."""
        held = (self._log.last()[1] or {}).get(run)
        return held and held | {"alive": held["state"] == "active" and held["until"] > self._clock()}

    def _change(self, run: str, make: Callable[[dict | None], dict | None]) -> bool:
        while True:
            number, body = self._log.last()
            body = body or {}
            new = make(body.get(run))
            if new is None:
                return False
            try:
                self._log.publish(number, body | {run: new})
                return True
            except Conflict:
                continue

    def publish_active(self, run: str, attempt: str, epoch: int, seconds: float) -> bool:
        """Become the run's attempt; refused below its epoch, and at its epoch for another attempt or an ended one."""
        def make(held: dict | None) -> dict | None:
            if held and (epoch < held["epoch"] or epoch == held["epoch"] and (held["attempt"] != attempt or held["state"] in TERMINAL)):
                return None
            return {"attempt": attempt, "epoch": epoch, "state": "active", "until": self._clock() + seconds}

        return self._change(run, make)

    def heartbeat(self, run: str, attempt: str, epoch: int, seconds: float) -> bool:
        """Renew the lease of the active attempt."""
        return self._change(run, lambda held: held | {"until": self._clock() + seconds} if self._own(held, attempt, epoch) else None)

    def publish_terminal(self, run: str, attempt: str, epoch: int, state: str) -> bool:
        """End the active attempt; the first end holds."""
        if state not in TERMINAL:
            raise ValueError(f"{state!r} does not end an attempt")
        return self._change(run, lambda held: held | {"state": state} if self._own(held, attempt, epoch) else None)

    @staticmethod
    def _own(held: dict | None, attempt: str, epoch: int) -> bool:
        return held is not None and held["attempt"] == attempt and held["epoch"] == epoch and held["state"] == "active"


class Calls:
    """Calls, errors, rows, bytes and seconds of each interface function, as a summary."""

    def __init__(self) -> None:
        self._held: dict[str, dict] = {}

    def record(self, name: str, seconds: float, rows: int = 0, size: int = 0, failed: bool = False) -> None:
        at = self._held.setdefault(name, {"calls": 0, "errors": 0, "rows": 0, "bytes": 0, "seconds": 0.0, "slowest": 0.0})
        at["calls"] += 1
        at["errors"] += failed
        at["rows"] += rows
        at["bytes"] += size
        at["seconds"] += seconds
        at["slowest"] = max(at["slowest"], seconds)

    def summary(self) -> dict:
        return {name: at | {"mean_seconds": at["seconds"] / at["calls"]} for name, at in sorted(self._held.items())}
