"""Retry and restart policies: delays and eligibility, as Columns and in Python."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import duration_ms

# Fixed: errors that are never retried unless a policy says otherwise (wrong argument, missing value, wrong type).
NEVER_RETRIED = ("ValueError", "AttributeError", "TypeError")


def _bounded(initial_ms: int, multiplier: float, attempt: int, max_ms: int) -> float:
    try:
        delay = initial_ms * multiplier ** (attempt - 1)
    except OverflowError:
        return float(max_ms)
    return float(max_ms) if not math.isfinite(delay) else min(delay, max_ms)


def _jittered(delay: int, jitter: bool) -> int:
    return max(1, int(delay * random.uniform(0.8, 1.2))) if jitter else delay


@dataclass(frozen=True)
class RetryPolicy:
    """``max_attempts`` counts the first attempt. Without ``retry_on`` every error but those of ``no_retry_on`` is retried."""

    max_attempts: int = 3
    initial_delay: str = "500ms"
    max_delay: str = "30s"
    multiplier: float = 2.0
    jitter: bool = True
    retry_on: tuple[str, ...] = ()
    no_retry_on: tuple[str, ...] = NEVER_RETRIED

    def validate(self) -> None:
        if self.max_attempts < 1:
            raise ValueError("retry: max_attempts must be at least 1")
        if not math.isfinite(self.multiplier) or self.multiplier <= 0:
            raise ValueError("retry: multiplier must be finite and above 0")
        duration_ms(self.initial_delay)
        duration_ms(self.max_delay)

    def applies_to(self, error: BaseException) -> bool:
        names = {c.__name__ for c in type(error).__mro__}
        if names & set(self.no_retry_on):
            return False
        return not self.retry_on or bool(names & set(self.retry_on))

    def should_retry(self, error: BaseException, attempt: int) -> bool:
        return attempt < self.max_attempts and self.applies_to(error)

    def delay_ms(self, attempt: int) -> int:
        """Wait after the attempt of that number (from 1)."""
        initial, most = duration_ms(self.initial_delay), duration_ms(self.max_delay)
        if initial == 0 or most == 0:
            return 0
        return _jittered(max(1, int(_bounded(initial, self.multiplier, attempt, most))), self.jitter)

    def delay_column(self, attempt: Column) -> Column:
        """``delay_ms`` without jitter."""
        initial, most = duration_ms(self.initial_delay), duration_ms(self.max_delay)
        if initial == 0 or most == 0:
            return F.when(attempt.isNotNull(), F.lit(0).cast("long"))
        return F.greatest(F.lit(1).cast("long"), F.least(F.lit(initial) * F.pow(F.lit(self.multiplier), attempt - 1), F.lit(float(most))).cast("long"))

    def eligible_column(self, attempt: Column, ancestry: Column) -> Column:
        """Whether an error is tried again; ``ancestry``: names of its class and all its superclasses."""
        listed = lambda names: F.arrays_overlap(ancestry, F.array(*map(F.lit, names))) if names else F.lit(False)
        allowed = listed(self.retry_on) if self.retry_on else F.lit(True)
        return (attempt < self.max_attempts) & ~listed(self.no_retry_on) & allowed


@dataclass(frozen=True)
class RestartPolicy:
    """``max_attempts`` 0: no limit."""

    max_attempts: int = 0
    initial_delay: str = "1s"
    max_delay: str = "60s"
    multiplier: float = 2.0
    jitter: bool = False

    def validate(self) -> None:
        if self.max_attempts < 0:
            raise ValueError("restart: max_attempts must be at least 0")
        if not math.isfinite(self.multiplier) or self.multiplier < 1:
            raise ValueError("restart: multiplier must be finite and at least 1")
        if duration_ms(self.initial_delay) <= 0 or duration_ms(self.max_delay) <= 0:
            raise ValueError("restart: delays must be above 0")

    def exhausted(self, attempt: int) -> bool:
        return self.max_attempts > 0 and attempt > self.max_attempts

    def delay_ms(self, attempt: int) -> int:
        return _jittered(max(1, int(_bounded(duration_ms(self.initial_delay), self.multiplier, attempt, duration_ms(self.max_delay)))), self.jitter)

    def delay_column(self, attempt: Column) -> Column:
        """``delay_ms`` without jitter; a power beyond the doubles' range is the longest delay."""
        raw = F.lit(duration_ms(self.initial_delay)) * F.pow(F.lit(self.multiplier), attempt - 1)
        return F.greatest(F.lit(1).cast("long"), F.least(raw, F.lit(float(duration_ms(self.max_delay)))).cast("long"))

    def exhausted_column(self, attempt: Column) -> Column:
        return F.lit(self.max_attempts > 0) & (attempt > self.max_attempts)
