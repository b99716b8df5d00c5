"""Conditional logit over choice sets: which member of a set was chosen, by its features.

A step is one job for all models: sums over each set first, then sums over the sets, so a
set of any size is added up in parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _exponent(names: list[str], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for n, b in zip(names, beta.tolist(), strict=True):
        out = out + F.col(n) * F.lit(b)
    return F.exp(out)


def _set_sums(rows: DataFrame, key: str, chosen: str, models: dict[str, list[str]], betas: dict[str, np.ndarray]) -> DataFrame:
    out = []
    for i, (name, x) in enumerate(models.items()):
        e = _exponent(x, betas[name])
        out.append(F.sum(e).alias(f"z{i}"))
        out += [F.sum(e * F.col(a)).alias(f"x{i}_{j}") for j, a in enumerate(x)]
        out += [F.sum(e * F.col(a) * F.col(b)).alias(f"xx{i}_{j}_{k}") for j, a in enumerate(x) for k, b in enumerate(x) if k >= j]
        out += [F.sum(F.when(F.col(chosen), F.col(a)).otherwise(0.0)).alias(f"c{i}_{j}") for j, a in enumerate(x)]
    # A set counts where exactly one member was chosen.
    return rows.groupBy(key).agg(F.count_if(chosen).alias("n_chosen"), *out).where("n_chosen = 1")


def evaluate(rows: DataFrame, key: str, chosen: str, models: dict[str, list[str]], betas: dict[str, np.ndarray]) -> tuple[int, dict[str, tuple[float, np.ndarray, np.ndarray]]]:
    """The sets, and for each model its log likelihood, gradient and negative Hessian."""
    sums = [F.count("*")]
    for i, (name, x) in enumerate(models.items()):
        k, z = range(len(x)), F.col(f"z{i}")
        fit = sum((F.col(f"c{i}_{j}") * F.lit(float(b)) for j, b in enumerate(betas[name])), F.lit(0.0)) - F.log(z)
        sums += [F.sum(fit), *(F.sum(F.col(f"c{i}_{j}") - F.col(f"x{i}_{j}") / z) for j in k)]
        sums += [F.sum(F.col(f"xx{i}_{j}_{m}") / z - F.col(f"x{i}_{j}") * F.col(f"x{i}_{m}") / (z * z)) for j in k for m in k if m >= j]
    got = [0.0 if v is None else float(v) for v in _set_sums(rows, key, chosen, models, betas).agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()]
    out, at = {}, 1
    for name, x in models.items():
        n = len(x)
        h = np.zeros((n, n))
        value, gradient = got[at], np.array(got[at + 1 : at + 1 + n])
        at += 1 + n
        for j in range(n):
            for m in range(j, n):
                h[j, m] = h[m, j] = got[at]
                at += 1
        out[name] = value, gradient, h
    return int(got[0]), out


def fit(rows: DataFrame, key: str, chosen: str, models: dict[str, list[str]], rounds: int = 25, ridge: float = 1e-6) -> dict[str, np.ndarray]:
    """Each model's weights by Newton steps, halved while they make it worse."""
    betas = {m: np.zeros(len(x)) for m, x in models.items()}
    _, now = evaluate(rows, key, chosen, models, betas)
    steps = {m: np.linalg.solve(now[m][2] + ridge * np.eye(len(betas[m])), now[m][1]) for m in models}
    for _ in range(rounds):
        tried = {m: betas[m] + steps[m] for m in models}
        _, then = evaluate(rows, key, chosen, models, tried)
        for m in models:
            if then[m][0] >= now[m][0]:
                betas[m], now[m] = tried[m], then[m]
                steps[m] = np.linalg.solve(now[m][2] + ridge * np.eye(len(betas[m])), now[m][1])
            else:
                steps[m] = steps[m] / 2
        if max(np.abs(s).max() for s in steps.values()) < 1e-7:
            break
    return betas
