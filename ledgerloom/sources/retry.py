"""Calls that may fail for a while: which errors pass, how long to wait, and how many calls a second."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
# Errors of a feed's service that pass by themselves.
PASSING = ("RATE_LIMIT_EXCEEDED", "INTERNAL_SERVER_ERROR", "INSTITUTION_DOWN", "INSTITUTION_NOT_RESPONDING", "PLANNED_MAINTENANCE")
RETRIES, FIRST_S, LONGEST_S, GROWTH, JITTER = 3, 1.0, 30.0, 2.0, 0.3
TOKENS, REFILL = 10.0, 5.0


class FeedError(Exception):
    """An error of a feed's service, with its code or HTTP status."""

    def __init__(self, message: str = "", code: str | None = None, status: int | None = None):
        super().__init__(message or code or str(status))
        self.code, self.status = code, status


def passes(error: object, passing: tuple[str, ...] = PASSING) -> bool:
    """Whether it makes sense to try again: by the error's code if it has one, else by its status."""
    if (code := getattr(error, "code", None)) is not None:
        return code in passing
    status = getattr(error, "status", None)
    return status is not None and (status == 429 or 500 <= status < 600)


def wait_s(attempt: int, first: float = FIRST_S, longest: float = LONGEST_S, growth: float = GROWTH, chance: float | None = None) -> float:
    """Seconds to wait after the attempt, from 1 on; chance in [0, 1) spreads the calls of many."""
    base = first * growth ** (attempt - 1)
    return min(base * (1 + JITTER * (random.random() if chance is None else chance)), longest)


def retried(call: Callable[[], T], retries: int = RETRIES, passing: tuple[str, ...] = PASSING, on_retry: Callable[[int, Exception, float], None] | None = None, sleep: Callable[[float], None] = time.sleep, **waits: float) -> T:
    """The call's result; errors that pass are tried again, others are raised at once."""
    for attempt in range(1, retries + 2):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if attempt > retries or not passes(e, passing):
                raise
            pause = wait_s(attempt, **waits)
            if on_retry:
                on_retry(attempt, e, pause)
            sleep(pause)
    raise AssertionError("unreachable")


class RateLimit:
    """A bucket of tokens: each call takes one, and so many come back a second."""

    def __init__(self, tokens: float = TOKENS, refill: float = REFILL, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self._most, self._rate, self._now, self._sleep = tokens, refill, now, sleep
        self._left, self._at = tokens, now()

    def available(self) -> float:
        now = self._now()
        self._left, self._at = min(self._most, self._left + (now - self._at) * self._rate), now
        return self._left

    def take(self) -> None:
        if self.available() < 1:
            self._sleep((1 - self._left) / self._rate)
            self.available()
        self._left -= 1
