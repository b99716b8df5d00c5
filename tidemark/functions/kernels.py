"""Order-dependent kernels on one series' arrays: what windows cannot express, because the state resets or feeds back."""

from __future__ import annotations

import math

import numpy as np


class Cusum:
    """Two-sided CUSUM of values standardised by the moments of earlier values only; it starts anew after each alarm."""

    def __init__(self, reference: float = 0.5, limit: float = 5.0):
        self._reference, self._limit = reference, limit
        self._n = 0
        self._mean = self._spread = self._high = self._low = 0.0

    def step(self, v: float) -> float:
        sd = math.sqrt(self._spread / (self._n - 1)) if self._n > 1 else 0.0
        z = (v - self._mean) / sd if sd > 0 else 0.0
        self._high, self._low = max(0.0, self._high + z - self._reference), max(0.0, self._low - z - self._reference)
        out = max(self._high, self._low)
        if out > self._limit:
            self._high = self._low = 0.0
        self._n += 1
        delta = v - self._mean
        self._mean += delta / self._n
        self._spread += delta * (v - self._mean)
        return out


class EDetector:
    """Largest Shiryaev-Roberts e-value of 0/1 values against rate p0, betting on the running rate of earlier values."""

    def __init__(self, p0: float = 0.5, cap: float = 1e12):
        self._p0, self._cap, self._n, self._ones, self._value, self.best = p0, cap, 0, 1.0, 0.0, 0.0

    def step(self, v: bool) -> float:
        p = min(max(self._ones / (self._n + 2.0), 0.01), 0.99)
        self._value = min(self._cap, (self._value + 1.0) * (p / self._p0 if v else (1 - p) / (1 - self._p0)))
        self._n, self._ones, self.best = self._n + 1, self._ones + v, max(self.best, self._value)
        return self._value


class RunLengths:
    """Bayesian online change points: normal values of unknown mean and unit variance.

    keep: the run lengths that are kept, the shortest ones; all if None, and the work then
    grows with the square of the series. What is left out of the probability at a step is
    `left_out` at most.
    """

    def __init__(self, hazard: float = 0.01, keep: int | None = None):
        self._hazard, self._keep = hazard, keep
        self._probability, self._total, self._count = np.ones(1), np.zeros(1), np.zeros(1)
        self.left_out = 0.0

    def step(self, v: float) -> int:
        """The most likely run length after v."""
        variance = 1 + 1 / (self._count + 1)
        likelihood = np.exp(-0.5 * (v - self._total / (self._count + 1)) ** 2 / variance) / np.sqrt(2 * np.pi * variance)
        joint = self._probability * likelihood
        whole = np.concatenate([[joint.sum() * self._hazard], joint * (1 - self._hazard)])
        kept = whole[: self._keep]
        self.left_out = max(self.left_out, 1 - kept.sum() / max(whole.sum(), 1e-300))
        self._probability = kept / max(kept.sum(), 1e-300)
        self._total, self._count = np.concatenate([[0.0], self._total + v])[: self._keep], np.concatenate([[0.0], self._count + 1])[: self._keep]
        return int(self._probability.argmax())


class Swings:
    """Swings of a price path that exceed friction, as a share of the last turning point."""

    def __init__(self, friction: float):
        self._friction, self.n = friction, 0
        self._low = self._high = self._up = None

    def step(self, v: float) -> int:
        self._low = v if self._low is None else min(self._low, v)
        self._high = v if self._high is None else max(self._high, v)
        if self._up is not True and v >= self._low * (1 + self._friction):
            self.n, self._up, self._high = self.n + 1, True, v
        elif self._up is not False and v <= self._high * (1 - self._friction):
            self.n, self._up, self._low = self.n + 1, False, v
        return self.n


def hawkes_em(times: np.ndarray, beta: float = 1.0, rounds: int = 50) -> tuple[float, float, float]:
    """Base rate, branching ratio and decay of an exponential Hawkes process, by expectation maximisation."""
    n = len(times)
    span = float(times[-1] - times[0]) if n > 1 else 0.0
    if n < 3 or span <= 0:
        return (0.0, 0.0, beta)
    mu, alpha = n / (2 * span), 0.5
    gaps = np.diff(times)
    for _ in range(rounds):
        excited = weighted = 0.0
        own = 1.0
        a = b = 0.0
        for g in gaps:
            fade = math.exp(-beta * g)
            b = fade * (b + g * (a + 1))
            a = fade * (a + 1)
            rate = mu + alpha * beta * a
            share = alpha * beta * a / rate
            excited += share
            weighted += alpha * beta * b / rate
            own += 1 - share
        mu, alpha = own / span, min(excited / n, 0.999)
        beta = excited / weighted if weighted > 0 else beta
    return mu, alpha, beta


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz): work that hardly depends on a and b."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact binomial interval: its ends are quantiles of beta distributions, found by bisection."""

    def quantile(p: float, a: float, b: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            m = (low + high) / 2
            low, high = (m, high) if incomplete_beta(a, b, m) < p else (low, m)
        return (low + high) / 2

    return 0.0 if k == 0 else quantile(alpha / 2, k, n - k + 1), 1.0 if k == n else quantile(1 - alpha / 2, k + 1, n - k)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p value of a 2x2 table."""
    r, s, k = a + b, c + d, a + c
    log = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(s + 1) - math.lgamma(k - x + 1) - math.lgamma(s - k + x + 1) - (math.lgamma(r + s + 1) - math.lgamma(k + 1) - math.lgamma(r + s - k + 1))
    seen = log(a)
    return min(1.0, sum(math.exp(log(x)) for x in range(max(0, k - s), min(k, r) + 1) if log(x) <= seen + 1e-7))


def sign_test(positive: int, negative: int) -> float:
    """Two-sided p value of as uneven a split of signs."""
    n, k = positive + negative, min(positive, negative)
    return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))
