"""Weighted progress of a job's stages, with throttled callbacks, an estimate of the rest, and cancelling."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

#: Keys of the stages that builds and scans report.
STAGES = (
    "vertices_index", "edges_index", "ranks_partition", "ranks_merge", "inbound_partition", "inbound_merge",
    "vertices_targets", "edges", "vertices_neighbors", "ranks", "writing",
)
THROTTLE_S = 0.1


class Cancelled(Exception):
    def __str__(self) -> str:
        return "cancelled"


@dataclass(frozen=True)
class Update:
    stage: str
    label: str
    done: int
    total: int
    overall: float
    elapsed_s: float
    eta_s: float | None
    throughput: float


class Progress:
    def __init__(self, sink: Callable[[Update], None] | None = None, spark=None, tag: str | None = None):
        self.sink, self.spark, self.tag = sink, spark, tag
        self._cancel, self._inside = threading.Event(), threading.Event()
        self._began = self._stage_began = time.monotonic()
        self._key = self._label = ""
        self._base = self._weight = 0.0
        self._done = self._total = 0
        self._last = 0.0
        self._most = 0.0

    def cancel(self) -> None:
        """Ask the job to stop. Spark jobs under the tag are cancelled until the block that started them is left."""
        self._cancel.set()
        if self._inside.is_set():
            threading.Thread(target=self._stop_jobs, daemon=True).start()

    def _stop_jobs(self) -> None:
        while self._inside.is_set():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            time.sleep(0.5)

    @contextmanager
    def jobs(self, spark):
        """Spark jobs of this thread within the block carry a tag of their own, by which ``cancel`` stops them."""
        self.spark, self.tag = spark, self.tag or f"job-{uuid.uuid4().hex}"
        self.check()
        spark.sparkContext.addJobTag(self.tag)
        self._inside.set()
        try:
            yield self
        except Exception:
            self.check()  # an interrupted job is a cancelled one
            raise
        finally:
            self._inside.clear()
            spark.sparkContext.removeJobTag(self.tag)

    @property
    def cancelled(self) -> bool:
        return self._cancel.is_set()

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled

    def stage(self, key: str, label: str, base: float, weight: float, total: int = 1) -> None:
        self.check()
        self._key, self._label, self._base, self._weight, self._total, self._done = key, label, base, weight, max(1, total), 0
        self._stage_began = time.monotonic()
        if self.spark is not None:
            self.spark.sparkContext.setJobDescription(f"{key}: {label}")
        self._emit(True)

    def advance(self, n: int = 1) -> None:
        self._done = min(self._total, self._done + n)
        self._emit(False)

    def finish_stage(self) -> None:
        self._done = self._total
        self._emit(True)

    def _emit(self, force: bool) -> None:
        now = time.monotonic()
        if self.sink is None or not force and now - self._last < THROTTLE_S:
            return
        self._last = now
        self._most = max(self._most, min(1.0, self._base + self._weight * self._done / self._total))
        elapsed = now - self._began
        eta = elapsed * (1 - self._most) / self._most if self._most > 0.01 else None
        rate = self._done / max(1e-9, now - self._stage_began)
        self.sink(Update(self._key, self._label, self._done, self._total, self._most, elapsed, eta, rate))


class OneJob:
    """At most one job at a time; the running one can be cancelled."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), None

    def begin(self, progress: Progress) -> Progress:
        with self._lock:
            if self._running is not None:
                raise RuntimeError("another job is running")
            self._running = progress
            return progress

    def finish(self) -> None:
        with self._lock:
            self._running = None

    def cancel(self) -> bool:
        with self._lock:
            if self._running is None:
                return False
            self._running.cancel()
            return True

    @property
    def running(self) -> bool:
        return self._running is not None
