"""State machines of one key: a rate limiter and circuit breakers."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass
class RateLimiter:
    """At most ``most`` events in ``window_ms``; a denied event takes no place."""

    most: int
    window_ms: int
    times: deque = field(default_factory=deque)

    def step(self, ms: int, ok: bool = True) -> str:
        while self.times and ms - self.times[0] >= self.window_ms:
            self.times.popleft()
        if len(self.times) >= self.most:
            return "denied"
        self.times.append(ms)
        return "allowed"

    def dump(self) -> list[int]:
        return list(self.times)

    def load(self, state: list[int]) -> None:
        self.times = deque(state)


@dataclass
class Breaker:
    """Closed, open after ``threshold`` failures in a row or a failure share of ``share``, half open after ``reset_ms``.

    ``threshold`` 1 opens at the first failure.  ``closes`` successes in a row close a
    half-open breaker.  With ``share``, failures are set against successes since the last
    one, so that the first failure after a success can open it.
    """

    threshold: int = 1
    reset_ms: int = 60_000
    closes: int = 1
    share: float | None = None
    state: str = "closed"
    failures: int = 0
    successes: int = 0
    opened: int = 0

    def step(self, ms: int, ok: bool) -> str:
        if self.state == "open":
            if ms - self.opened < self.reset_ms:
                return "rejected"
            self.state, self.successes = "half_open", 0
        if ok:
            self.successes += 1
            self.failures = 0
            if self.state == "half_open" and self.successes >= self.closes:
                self.state = "closed"
            return self.state
        self.failures += 1
        tripped = self.state == "half_open" or (self.failures >= self.threshold if self.share is None else self.failures / (self.failures + self.successes) >= self.share)
        if tripped:
            self.state, self.opened, self.successes = "open", ms, 0
        return self.state

    def dump(self) -> list:
        return [self.state, self.failures, self.successes, self.opened]

    def load(self, state: list) -> None:
        self.state, self.failures, self.successes, self.opened = state
