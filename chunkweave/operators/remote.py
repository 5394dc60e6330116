"""Calls of a remote service from many tasks: some in flight in each, one rate over all, and a pause while the service is down.

The rate holds by construction, without a process that hands out turns: calls are made by a fixed number of tasks, and each keeps to its share. Fewer tasks at a
time stay below the rate; so do tasks that run again. Speculative copies of tasks would not, and have to be off.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

Result = TypeVar("Result")


@dataclass(frozen=True)
class Pace:
    """per_second: calls of all tasks together. tasks: how many tasks make calls. in_flight: calls of one task at a time.

    After `failures` failed calls in a row a task waits `cool` seconds and then sends one call to see; more go when it comes back well.
    """

    per_second: float
    tasks: int = 8
    in_flight: int = 8
    failures: int = 5
    cool: float = 30.0


class Caller:
    """The calls of one task."""

    def __init__(self, pace: Pace, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.pace, self.clock, self.sleep = pace, clock, sleep
        self.turn = threading.Lock()
        self.next, self.failed, self.trial = clock(), 0, threading.Lock()

    def wait(self) -> None:
        """Until this task may make its next call."""
        with self.turn:
            at = max(self.clock(), self.next)
            self.next = at + self.pace.tasks / self.pace.per_second
        self.sleep(max(0.0, at - self.clock()))

    def call(self, what: Callable[[], Result]) -> Result:
        if self.failed >= self.pace.failures:
            with self.trial:  # one call at a time while it is in doubt
                if self.failed >= self.pace.failures:
                    self.sleep(self.pace.cool)
                    return self.counted(what)
        return self.counted(what)

    def counted(self, what: Callable[[], Result]) -> Result:
        self.wait()
        try:
            found = what()
        except Exception:
            with self.turn:
                self.failed += 1
            raise
        with self.turn:
            self.failed = 0
        return found

    def all(self, calls: list[Callable[[], Result]]) -> list[Result | Exception]:
        """Results, or the error of a call, in the order of the calls; each of these is to use `call` for what goes to the service."""

        def outcome(call: Callable[[], Result]) -> Result | Exception:
            try:
                return call()
            except Exception as error:  # any failure of a remote service
                return error

        with ThreadPoolExecutor(self.pace.in_flight) as pool:
            return list(pool.map(outcome, calls))
