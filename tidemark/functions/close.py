"""Counting pairs of days that lie close together, over sorted batches, without making the pairs."""

from __future__ import annotations

import numpy as np


class ClosePairs:
    """Pairs of rows of one key and one series whose days are at most `window` apart, summed over keys by series.

    Rows come sorted by key. Of the key that may go on only its distinct days and their
    counts are kept, so it may have more rows than memory.
    """

    def __init__(self, window: int, series: int):
        self.pairs = np.zeros(series, np.int64)
        self._window, self._series = window, series
        self._kept: tuple | None = None

    def feed(self, keys: list[np.ndarray], series: np.ndarray, days: np.ndarray) -> None:
        if not len(days):
            return
        n = np.ones(len(days), np.int64)
        if self._kept is not None:
            last, s, d, k = self._kept
            keys = [np.concatenate([np.full(len(d), a, x.dtype), x]) for a, x in zip(last, keys, strict=True)]
            series, days, n = np.concatenate([s, series]), np.concatenate([d, days]), np.concatenate([k, n])
        group = np.concatenate([[0], np.cumsum(np.logical_or.reduce([x[1:] != x[:-1] for x in keys]))])
        begin = int(np.searchsorted(group, group[-1]))
        self._count(group[:begin], series[:begin], days[:begin], n[:begin])
        code, low, span = self._codes(0, series[begin:], days[begin:])
        code, k = _summed(code, n[begin:])
        self._kept = ([x[-1] for x in keys], code // span, code % span + low, k)

    def end(self) -> np.ndarray:
        if self._kept is not None:
            _, s, d, k = self._kept
            self._count(np.zeros(len(d), np.int64), s, d, k)
            self._kept = None
        return self.pairs

    def _codes(self, group: np.ndarray | int, series: np.ndarray, days: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Numbers that order rows by series, group and day, those of two groups being farther apart than the window."""
        low = int(days.min())
        span = int(days.max()) - low + self._window + 1
        groups = 1 if isinstance(group, int) else int(group[-1]) + 1
        return (series * groups + group) * span + (days - low), low, groups * span

    def _count(self, group: np.ndarray, series: np.ndarray, days: np.ndarray, n: np.ndarray) -> None:
        if not len(days):
            return
        code, _, wide = self._codes(group, series, days)
        code, k = _summed(code, n)
        upto = np.cumsum(k)
        reach = upto[np.searchsorted(code, code + self._window, "right") - 1]
        found = k * (k - 1) // 2 + k * (reach - upto)
        line = code // wide
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        self.pairs[line[first]] += np.add.reduceat(found, first)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of n of each."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)
