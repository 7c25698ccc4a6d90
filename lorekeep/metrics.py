"""Counters and durations of stores, repositories and projectors, kept on the driver."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

#: What is counted, and what is timed (in seconds).
COUNTERS = (
    "store.events_appended",
    "store.conflicts",
    "store.commit_races",
    "commands.committed",
    "commands.already_committed",
    "commands.rejected",
    "commands.noop",
    "commands.retries",
    "projector.events_applied",
    "projector.events_parked",
    "projector.rejections",
    "projector.lag",
)
DURATIONS = ("commands.execute", "projector.batch")


@dataclass
class Metrics:
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    seconds: dict[str, list[float]] = field(default_factory=lambda: {k: [] for k in DURATIONS})
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def add(self, name: str, n: int = 1) -> None:
        with self._lock:
            self.counts[name] += n

    def set(self, name: str, n: int) -> None:
        with self._lock:
            self.counts[name] = n

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            with self._lock:
                self.seconds[name].append(time.perf_counter() - began)
