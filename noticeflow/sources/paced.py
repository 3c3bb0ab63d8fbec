"""A paced client for web APIs: waits between requests, backs off, and stops asking after repeated refusals.

It runs on the driver or in the tasks of a data source; what it fetches becomes rows.  The request,
sleep and clock functions are given, so tests need no network and no time.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

#: Seconds between requests, waits before the retries, refusals in a row that open the circuit.
INTERVAL, WAITS, REFUSALS = 12.0, (30.0, 60.0, 120.0, 240.0), 3


@dataclass
class Answer:
    status: int
    body: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    attempts: int = 1


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds from a Retry-After header, a number or a date."""
    if not value:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


class PacedClient:
    def __init__(
        self, get: Callable[[str], Answer], sleep: Callable[[float], None], clock: Callable[[], float],
        interval: float = INTERVAL, waits: Sequence[float] = WAITS, refusals: int = REFUSALS, jitter: float = 0.1, seed: int = 1,
    ):
        self.get, self.sleep, self.clock = get, sleep, clock
        self.interval, self.waits, self.refusals, self.jitter = interval, waits, refusals, jitter
        self.random, self.last, self.refused = random.Random(seed), None, 0

    @property
    def open(self) -> bool:
        """Whether the circuit is open: nothing is asked any more."""
        return self.refused >= self.refusals

    def fetch(self, url: str) -> Answer:
        """The answer after retries; status 0 without a request while the circuit is open."""
        if self.open:
            return Answer(0, "circuit open", attempts=0)
        for n in range(len(self.waits) + 1):
            if self.last is not None and (left := self.last + self.interval - self.clock()) > 0:
                self.sleep(left)
            self.last = self.clock()
            answer = self.get(url)
            answer.attempts = n + 1
            if answer.status == 429:
                self.refused += 1
            elif answer.status < 400:
                self.refused = 0
            if self.open or (answer.status != 429 and answer.status < 500) or n == len(self.waits):
                return answer
            asked = retry_after(answer.headers.get("Retry-After"), self.clock())
            self.sleep(asked if asked is not None else self.waits[n] * (1 + self.jitter * self.random.random()))
        raise AssertionError("unreachable")
