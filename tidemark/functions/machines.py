"""State machines as folds over one key's events: bounded state, one decision for each event."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class Breaker:
    """Pauses after the last `window` closes together lose more than `most`; it starts anew after each pause."""

    window: int = 10
    most: int = 100
    pause: int = 1800
    closes: list[int] = field(default_factory=list)
    until: int = 0

    def close(self, pnl: int, now: int) -> bool:
        """Whether this close trips it."""
        self.closes = [*self.closes, pnl][-self.window :]
        if sum(self.closes) >= -self.most:
            return False
        self.until, self.closes = max(self.until, now + self.pause), []
        return True

    def paused(self, now: int) -> bool:
        return now < self.until


@dataclass(frozen=True)
class Movers:
    """When a mint on a page of volumes is worth an alert, from what was seen of it before; numbers of polls for all times."""

    least: int = 40
    ratio: int = 3
    top_least: int = 30
    fresh: int = 5
    cooldown: int = 3
    room: int = 2
    span: int = 5

    def poll(self, now: int, page: list[tuple[int, int]], seen: dict[int, tuple], sent: list[int]) -> tuple[list[tuple[int, int, str]], dict[int, tuple], list[int]]:
        """Alerts (mint, v5, reason) of a page of (mint, v5), largest first; what is known of its mints from now on (v5, poll, among the five largest, last alert or None); polls of recent alerts.

        A mint whose volume grew `ratio`-fold since its last poll (no older than `fresh`), or
        that is newly among the five largest; not within `cooldown` polls of its last alert;
        `room` alerts in any `span` polls, the largest first.
        """
        known, candidates = {}, []
        for i, (mint, v5) in enumerate(page):
            before, at, was_top, alerted = seen.get(mint, (None, None, None, None))
            known[mint] = (v5, now, i < 5, alerted)
            if at is None or at < now - self.fresh:
                continue
            if before > 0 and v5 >= self.least and v5 >= self.ratio * before:
                why = "accel"
            elif i < 5 and not was_top and v5 >= self.top_least:
                why = "top5_entry"
            else:
                continue
            if alerted is None or alerted < now - self.cooldown:
                candidates.append((mint, v5, why))
        sent = [p for p in sent if p > now - self.span]
        alerts = candidates[: max(self.room - len(sent), 0)]
        for mint, v5, _ in alerts:
            known[mint] = (v5, now, known[mint][2], now)
        return alerts, known, sent + [now] * len(alerts)

    def memory(self) -> int:
        """Polls after which nothing that was seen matters."""
        return max(self.fresh, self.cooldown, self.span) + 1

    def forgets(self, now: int, at: int, alerted: int | None) -> bool:
        return at < now - self.fresh and (alerted is None or alerted < now - self.cooldown)


@dataclass
class PaperBook:
    """Paper positions in one mint: an entry decided at one price fills at the next, a position ends at its target, its stop or its deadline, and the book then waits."""

    enter: float = 1.05
    target: float = 1.2
    stop: float = 0.9
    hold: int = 60
    wait: int = 10
    state: str = "flat"
    since: int = 0
    entry: float = 0.0
    before: float | None = None

    def observe(self, day: int, price: float) -> tuple[int, int, float, float, str] | None:
        """A closed position (opened, closed, entry, exit, why), if this price closes one."""
        done = None
        if self.state == "pending":
            self.state, self.since, self.entry = "open", day, price
        elif self.state == "open":
            why = "target" if price >= self.target * self.entry else "stop" if price <= self.stop * self.entry else "deadline" if day >= self.since + self.hold else None
            if why:
                done = (self.since, day, self.entry, price, why)
                self.state, self.since = "waiting", day
        elif self.before is not None and price >= self.enter * self.before and (self.state == "flat" or day >= self.since + self.wait):
            self.state = "pending"
        self.before = price
        return done


@dataclass
class Band:
    """A band of a half width in log price, moved to the price once that has been outside for `dwell` days: how often it is moved, and for how many days the price was inside."""

    width: float
    dwell: int
    moves: int = 0
    inside: int = 0
    center: float | None = None
    out_since: int | None = None
    held_since: int | None = None

    def observe(self, day: int, price: float) -> None:
        x = math.log(price)
        if self.held_since is not None:
            self.inside += day - self.held_since
        if self.center is None:
            self.center = x
        self.held_since = None
        if abs(x - self.center) <= self.width:
            self.out_since, self.held_since = None, day
        elif self.out_since is None:
            self.out_since = day
        if self.out_since is not None and day - self.out_since >= self.dwell:
            self.center, self.out_since, self.moves = x, None, self.moves + 1
