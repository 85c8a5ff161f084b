"""Bounded admission of events at the ingest client: small batches are published, callers learn what became of theirs.

The client runs on the driver; what it holds is bounded by its capacity. Publishing is a function of a list of events,
such as an append to the event log; an event is durable when the function has returned for its batch.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Sequence
from concurrent.futures import Future

ACCEPTED, FULL, UNAVAILABLE = "accepted", "full", "unavailable"
#: Events of a batch, and seconds that a batch waits for more.
BATCH_EVENTS, BATCH_SECONDS = 256, 0.002


class Admission:
    def __init__(self, publish: Callable[[list], object], capacity: int = 4096, batch: int = BATCH_EVENTS, wait: float = BATCH_SECONDS):
        self._publish, self._capacity, self._batch, self._wait = publish, capacity, batch, wait
        self._waiting: deque[tuple[object, Future]] = deque()
        self._held, self._open = 0, True
        self._changed = threading.Condition()
        self._worker = threading.Thread(target=self._work, daemon=True)
        self._worker.start()

    def _admit(self, events: Sequence) -> tuple[str, list[Future]]:
        with self._changed:
            if not self._open:
                return UNAVAILABLE, []
            if self._held + len(events) > self._capacity:
                return FULL, []
            made = [Future() for _ in events]
            self._waiting.extend(zip(events, made, strict=True))
            self._held += len(events)
            self._changed.notify_all()
            return ACCEPTED, made

    def try_append(self, events: Sequence) -> str:
        """Take all the events or none, without waiting; accepted ones are not yet durable."""
        return self._admit(events)[0]

    def append_durable(self, events: Sequence, timeout: float | None = None) -> str:
        """Take the events and wait until they are published; raises what publishing them raised."""
        state, made = self._admit(events)
        end = None if timeout is None else time.monotonic() + timeout
        for f in made:
            f.result(None if end is None else max(0.0, end - time.monotonic()))
        return state

    def _work(self) -> None:
        while True:
            with self._changed:
                self._changed.wait_for(lambda: self._waiting or not self._open)
                if not self._waiting:
                    return
                if self._open:
                    self._changed.wait_for(lambda: len(self._waiting) >= self._batch or not self._open, self._wait)
                taken = [self._waiting.popleft() for _ in range(min(self._batch, len(self._waiting)))]
            failure = None
            try:
                self._publish([event for event, _ in taken])
            except Exception as e:  # handed to those who wait for these events; later batches go on
                failure = e
            with self._changed:
                self._held -= len(taken)
                self._changed.notify_all()
            for _, f in taken:
                f.set_result(None) if failure is None else f.set_exception(failure)

    def close(self) -> None:
        """Admit no more, publish what was admitted."""
        with self._changed:
            self._open = False
            self._changed.notify_all()
        self._worker.join()
