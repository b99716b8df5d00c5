"""A two-sided Hawkes process with its decay fitted: a simplex search whose every step is one job."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.folds import by_key
from tidemark.sources.code import ship

NAMES = ("mu_buy", "mu_sell", "buy_by_buy", "buy_by_sell", "sell_by_buy", "sell_by_sell", "decay")


def log_likelihoods(batches: Iterator[pd.DataFrame], points: np.ndarray) -> np.ndarray:
    """The log likelihood of sequences at each point (rows: NAMES), summed. Rows (key, t, last, sell) come by key and time, `last` being the key's last t.

    The sequences of a batch move on in step, event by event; one that goes over the end
    of a batch goes on in the next.
    """
    mu, a, beta = points[:, :2], points[:, 2:6].reshape(-1, 2, 2), points[:, 6]
    out = np.zeros(len(points))
    kept = None  # key, time of its last event, excitation (points x 2)
    for b in batches:
        key, t, last, side = (b[c].to_numpy() for c in ("key", "t", "last", "sell"))
        if not len(key):
            continue
        t, last, side = t.astype(float), last.astype(float), side.astype(int)
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        size = np.diff(first, append=len(key))
        before, g = t[first].copy(), np.zeros((len(first), len(points), 2))
        fresh = np.ones(len(first), bool)
        if kept is not None and kept[0] == key[0]:
            before[0], g[0], fresh[0] = kept[1], kept[2], False
        # What the base rates and each event's own excitation are expected to bring until the end.
        out -= (last[first] - t[first])[fresh].sum() * mu.sum(axis=1)
        reach = 1 - np.exp(-np.outer(last - t, beta))
        for s in (0, 1):
            out -= reach[side == s].sum(axis=0) * a[:, :, s].sum(axis=1)
        order = np.argsort(-size, kind="stable")
        first, before, g = first[order], before[order], g[order]
        live = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right")
        for j, k in enumerate(live.tolist()):
            at = first[:k] + j
            decay = np.exp(-np.outer(t[at] - before[:k], beta))
            g[:k] *= decay[:, :, None]
            s = side[at]
            rate = mu[:, s].T + beta * (a[:, s, 0].T * g[:k, :, 0] + a[:, s, 1].T * g[:k, :, 1])
            out += np.log(np.maximum(rate, 1e-300)).sum(axis=0)
            g[np.arange(k), :, s] += 1
            before[:k] = t[at]
        longest = np.flatnonzero(order == len(size) - 1)[0]
        kept = key[-1], before[longest], g[longest].copy()
    return out


def simplex(values: Callable[[np.ndarray], np.ndarray], start: np.ndarray, step: float = 0.5, steps: int = 80, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """The least of a function by Nelder and Mead's search. values takes all points that a step may need at once."""
    n = len(start)
    x = np.vstack([start, start + step * np.eye(n)])
    f = values(x)
    for _ in range(steps):
        order = np.argsort(f, kind="stable")
        x, f = x[order], f[order]
        if f[-1] - f[0] < tolerance:
            break
        middle = x[:-1].mean(axis=0)
        way = middle - x[-1]
        tried = np.stack([middle + way, middle + 2 * way, middle + way / 2, middle - way / 2])
        r, e, outside, inside = got = values(tried)
        if r < f[0]:
            k = 1 if e < r else 0
        elif r < f[-2]:
            k = 0
        else:
            k = 2 if r < f[-1] and outside <= r else 3 if r >= f[-1] and inside < f[-1] else None
        if k is None:
            x[1:] = x[0] + (x[1:] - x[0]) / 2
            f[1:] = values(x[1:])
        else:
            x[-1], f[-1] = tried[k], got[k]
    best = int(np.argmin(f))
    return x[best], float(f[best])


def fit(events: DataFrame, key: str, t: str, sell: str, steps: int = 80) -> tuple[dict[str, float], float, int, int]:
    """Base rates, branching and decay shared by all sequences of two events or more; the log likelihood, events and sequences. sell: 0 or 1. Equal times excite each other in no time at all.

    Events are dealt and sorted once and kept by the executors; a lost one is dealt again.
    """
    spark = events.sparkSession
    ship(spark)
    w = Window.partitionBy("key")
    rows = events.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.col(sell).cast("int").alias("sell"))
    rows = rows.withColumns({"last": F.max("t").over(w), "n": F.count("*").over(w), "lo": F.min("t").over(w)}).where("n >= 2")
    held = by_key(rows.select("key", "t", "last", "lo", "sell"), "key", ["t", "sell"]).persist()
    try:
        n, sequences, span = held.groupBy("key").agg(F.count("*").alias("n"), F.first(F.col("last") - F.col("lo")).alias("span")).agg(F.sum("n"), F.count("*"), F.sum("span")).first()
        if not n:
            raise ValueError("no sequence with two events")

        def minus(logs: np.ndarray) -> np.ndarray:
            points = np.exp(np.clip(logs, -30, 30))

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                got = log_likelihoods(batches, points)
                yield pd.DataFrame({"point": range(len(points)), "value": got})

            got = held.select("key", "t", "last", "sell").mapInPandas(run, "point int, value double").groupBy("point").agg(F.sum("value").alias("value")).collect()
            return -np.array([v for _, v in sorted((r["point"], r["value"]) for r in got)])

        rate = max(n / span / 4, 1e-9) if span else 1.0
        start = np.log([rate, rate, 0.3, 0.1, 0.1, 0.3, max(4 * rate, 1e-6)])
        best, value = simplex(minus, start, steps=steps)
    finally:
        held.unpersist()
    return dict(zip(NAMES, np.exp(best).tolist(), strict=True)), -value, n, sequences
