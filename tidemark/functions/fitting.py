"""Models fitted by aggregates: each step is one pass of sums over the rows, and the driver solves a system as large as the number of columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sums(df: DataFrame, columns: list[Column]) -> np.ndarray:
    row = df.agg(*(F.sum(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return np.array([0.0 if x is None else float(x) for x in row])


def moments(df: DataFrame, names: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and the covariance matrix (of the population) of columns."""
    k = len(names)
    x = [F.col(c).cast("double") for c in names]
    first = _sums(df, [F.lit(1.0), *x])
    n, mean = first[0], first[1:] / max(first[0], 1)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = _sums(df, [(x[i] - mean[i]) * (x[j] - mean[j]) for i, j in pairs]) / max(n, 1)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, second, strict=True):
        cov[i, j] = cov[j, i] = v
    return n, mean, cov


def usable(df: DataFrame, names: list[str], max_corr: float = 0.98) -> list[tuple[str, str]]:
    """Each column and whether it is kept, constant, or a near copy of one kept before."""
    _, _, cov = moments(df, names)
    sd = np.sqrt(np.diag(cov))
    out, kept = [], []
    for i, name in enumerate(names):
        if sd[i] < 1e-9:
            out.append((name, "constant"))
        elif any(abs(cov[i, j] / (sd[i] * sd[j])) >= max_corr for j in kept):
            out.append((name, "duplicate"))
        else:
            kept.append(i)
            out.append((name, "kept"))
    return out


def standardised(df: DataFrame, names: list[str]) -> list[Column]:
    _, mean, cov = moments(df, names)
    sd = np.sqrt(np.diag(cov))
    return [(F.col(c).cast("double") - float(m)) / float(s if s > 0 else 1.0) for c, m, s in zip(names, mean, sd, strict=True)]


def _linear(x: list[Column], beta: np.ndarray) -> Column:
    return sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))


def _matrix(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = values
    return out + np.triu(out, 1).T


def logistic(df: DataFrame, names: list[str], label: str, l2: float = 0.0, weight: str | None = None, rounds: int = 25, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, list[Column]]:
    """Coefficients (first: the intercept, which is not penalised) over standardised columns, the inverse of the penalised Hessian, and the design's columns.

    Newton's steps, each one pass. A label of one class only gives an intercept of its log
    odds with half a row added to both classes.
    """
    x = [F.lit(1.0), *standardised(df, names)]
    k, y, w = len(x), F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    n, ones = _sums(df, [w, w * y])
    beta = np.zeros(k)
    if ones <= 0 or ones >= n:
        beta[0] = math.log((ones + 0.5) / (n - ones + 0.5))
        return beta, np.eye(k), x
    penalty = np.diag([0.0] + [l2] * (k - 1))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_linear(x, beta)))
        got = _sums(df, [w * (y - p) * c for c in x] + [w * p * (1 - p) * x[i] * x[j] for i, j in zip(*np.triu_indices(k), strict=True)])
        hessian = _matrix(got[k:], k) + penalty
        step = np.linalg.solve(hessian, got[:k] - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return beta, np.linalg.inv(hessian), x


def clustered(df: DataFrame, beta: np.ndarray, bread: np.ndarray, x: list[Column], label: str, cluster: str) -> np.ndarray:
    """Standard errors of a logistic fit, robust to clusters: scores are summed by cluster, then their products over clusters."""
    k = len(x)
    residual = F.col(label).cast("double") - 1 / (1 + F.exp(-_linear(x, beta)))
    scores = df.groupBy(cluster).agg(*(F.sum(residual * c).alias(f"u{i}") for i, c in enumerate(x)), F.count("*").alias("rows"))
    got = _sums(scores, [F.lit(1.0), F.col("rows").cast("double"), *(F.col(f"u{i}") * F.col(f"u{j}") for i, j in zip(*np.triu_indices(k), strict=True))])
    groups, n = got[:2]
    scale = groups / max(groups - 1, 1) * (n - 1) / max(n - k, 1)
    return np.sqrt(np.maximum(np.diag(bread @ _matrix(got[2:], k) @ bread) * scale, 0))


def cox(df: DataFrame, names: list[str], time: str, event: str, penalty: float = 0.1, rounds: int = 15, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors of a penalised proportional-hazards fit over standardised columns; ties by Breslow.

    A pass sums by distinct time; the risk sets are running sums over those times, latest first.
    """
    z = standardised(df, names)
    k, e = len(z), F.col(event).cast("double")
    ups = list(zip(*np.triu_indices(k), strict=True))
    n = _sums(df, [F.lit(1.0)])[0]
    beta, hessian = np.zeros(k), np.eye(k)
    later = Window.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(rounds):
        r = F.exp(_linear(z, beta))
        by = df.groupBy(time).agg(F.sum(e).alias("d"), F.sum(r).alias("s"), *(F.sum(e * c).alias(f"d{i}") for i, c in enumerate(z)), *(F.sum(r * c).alias(f"s{i}") for i, c in enumerate(z)), *(F.sum(r * z[i] * z[j]).alias(f"q{i}_{j}") for i, j in ups))
        risk = by.select("d", *(f"d{i}" for i in range(k)), F.sum("s").over(later).alias("s"), *(F.sum(f"s{i}").over(later).alias(f"s{i}") for i in range(k)), *(F.sum(f"q{i}_{j}").over(later).alias(f"q{i}_{j}") for i, j in ups))
        mean = [F.col(f"s{i}") / F.col("s") for i in range(k)]
        got = _sums(risk, [F.col(f"d{i}") - F.col("d") * mean[i] for i in range(k)] + [F.col("d") * (F.col(f"q{i}_{j}") / F.col("s") - mean[i] * mean[j]) for i, j in ups])
        hessian = _matrix(got[k:], k) + penalty * n * np.eye(k)
        step = np.linalg.solve(hessian, got[:k] - penalty * n * beta)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(hessian)))


def partial_pool(effects: DataFrame, effect: str, variance: str, rounds: int = 200, tolerance: float = 1e-7) -> tuple[float, float, float]:
    """Mean, its standard error and the spread between units of a normal-normal model, by expectation maximisation; a round is one pass."""
    t, v = F.col(effect).cast("double"), F.greatest(F.col(variance).cast("double"), F.lit(1e-12))
    n, total, noise = _sums(effects, [F.lit(1.0), t, v])
    if not n:
        return 0.0, math.inf, 0.0
    mu = total / n
    tau2 = max(_sums(effects, [(t - mu) * (t - mu)])[0] / n - noise / n, 1e-9)
    for _ in range(rounds):
        shrunk, left = (tau2 * t + v * mu) / (v + tau2), v * tau2 / (v + tau2)
        s, s2, kept = _sums(effects, [shrunk, shrunk * shrunk, left])
        new, new2 = s / n, max(s2 / n - (s / n) ** 2 + kept / n, 1e-12)
        done = abs(new - mu) < tolerance and abs(new2 - tau2) < tolerance
        mu, tau2 = new, new2
        if done:
            break
    return mu, math.sqrt(1 / _sums(effects, [1 / (v + tau2)])[0]), math.sqrt(tau2)


def boosted(df: DataFrame, names: list[str], label: str, trees: int = 5, depth: int = 2, bins: int = 16, rate: float = 0.3, l2: float = 1.0, least: float = 20.0) -> list[dict[int, tuple | float]]:
    """Histogram gradient boosting of log odds. A tree is {node: (column, edge) or a leaf's value}; node n has children 2n (up to the edge) and 2n + 1.

    A level of a tree is one aggregate: gradients and Hessians by node, column and bin,
    which is what the driver sees; bins are cut at quantiles of each column, to 0.1 %.
    """
    from tidemark.sources.scratch import written

    edges = [sorted(set(e)) for e in df.approxQuantile(names, [i / bins for i in range(1, bins)], 0.001)]
    bin_of = [sum(((F.col(c) > e).cast("int") for e in es), F.lit(0)) for c, es in zip(names, edges, strict=True)]
    rows = written(df.select(*names, F.col(label).cast("double").alias("_y"), *(b.alias(f"_b{i}") for i, b in enumerate(bin_of)), F.lit(0.0).alias("_score")), "boost")
    out = []
    for _ in range(trees):
        tree: dict[int, tuple | float] = {}
        live, p = {1}, 1 / (1 + F.exp(-F.col("_score")))
        for level in range(depth + 1):
            node = _node(tree)
            cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b")) for i in range(len(names))))).alias("c")
            sums = rows.select(node.alias("node"), (F.col("_y") - p).alias("g"), (p * (1 - p)).alias("h"), cells).groupBy("node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for n in sorted(live):
                mine = [r for r in sums if r["node"] == n]
                best = _split(mine, edges, l2, least) if level < depth else None
                g, h = sum(r["g"] for r in mine if r["f"] == 0), sum(r["h"] for r in mine if r["f"] == 0)
                tree[n] = (names[best[1]], edges[best[1]][best[2]]) if best else rate * g / (h + l2)
            live = {2 * n + side for n in live if isinstance(tree[n], tuple) for side in (0, 1)}
            if not live:
                break
        out.append(tree)
        rows = written(rows.withColumn("_score", F.col("_score") + _leaf(tree)), "boost")
    return out


def _split(cells: list, edges: list[list[float]], l2: float, least: float) -> tuple[float, int, int] | None:
    """The largest gain over all columns and edges, with the column's and the edge's number."""
    best = None
    for f, es in enumerate(edges):
        by = {r["b"]: (r["g"], r["h"]) for r in cells if r["f"] == f}
        g, h = sum(x for x, _ in by.values()), sum(x for _, x in by.values())
        left_g = left_h = 0.0
        for e in range(len(es)):
            left_g, left_h = left_g + by.get(e, (0, 0))[0], left_h + by.get(e, (0, 0))[1]
            if min(left_h, h - left_h) * 4 < least:  # a row's Hessian is a quarter at most
                continue
            gain = left_g**2 / (left_h + l2) + (g - left_g) ** 2 / (h - left_h + l2) - g**2 / (h + l2)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, e)
    return best


def _node(tree: dict[int, tuple | float], n: int = 1) -> Column:
    at = tree.get(n)
    return F.when(F.col(at[0]) > at[1], _node(tree, 2 * n + 1)).otherwise(_node(tree, 2 * n)) if isinstance(at, tuple) else F.lit(n)


def _leaf(tree: dict[int, tuple | float], n: int = 1) -> Column:
    at = tree[n]
    return F.when(F.col(at[0]) > at[1], _leaf(tree, 2 * n + 1)).otherwise(_leaf(tree, 2 * n)) if isinstance(at, tuple) else F.lit(float(at))


def boosted_score(trees: list[dict[int, tuple | float]]) -> Column:
    """Log odds of a row."""
    return sum((_leaf(t) for t in trees), F.lit(0.0))


def hodge(edges: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """Shares of a net flow's energy that are a gradient of node potentials, that turn around triangles, and that are neither.

    edges: (a, b, flow from a to b), one for each pair of a graph of venues, which the driver holds.
    """
    flow: dict[tuple[int, int], float] = {}
    for a, b, v in edges:
        if a != b:
            k = (min(a, b), max(a, b))
            flow[k] = flow.get(k, 0.0) + (v if a < b else -v)
    keys = sorted(flow)
    x = np.array([flow[k] for k in keys])
    energy = float(x @ x)
    if not keys or energy == 0:
        return 0.0, 0.0, 0.0
    nodes, place = sorted({n for k in keys for n in k}), {k: i for i, k in enumerate(keys)}
    at = {n: i for i, n in enumerate(nodes)}
    d = np.zeros((len(keys), len(nodes)))
    for i, (a, b) in enumerate(keys):
        d[i, at[a]], d[i, at[b]] = -1, 1
    gradient = d @ np.linalg.lstsq(d, x, rcond=None)[0]
    triangles = [(a, b, c) for a, b in keys for c in nodes if c > b and (b, c) in place and (a, c) in place]
    curl = np.zeros(len(keys))
    if triangles:
        t = np.zeros((len(keys), len(triangles)))
        for j, (a, b, c) in enumerate(triangles):
            t[place[a, b], j] = t[place[b, c], j] = 1
            t[place[a, c], j] = -1
        curl = t @ np.linalg.lstsq(t, x, rcond=None)[0]
    rest = x - gradient - curl
    return float(gradient @ gradient) / energy, float(curl @ curl) / energy, float(rest @ rest) / energy
