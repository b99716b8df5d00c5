"""Online policies over linear models of each arm's reward, with rewards that come late."""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np

POLICIES = ("epsilon", "linucb", "thompson")


def uniforms(name: str, n: int) -> np.ndarray:
    """n numbers in (0, 1) that depend on name alone, so a task run again draws the same."""
    out = b"".join(hashlib.sha256(f"{name}:{i}".encode()).digest() for i in range(-(-n // 8)))
    return (np.frombuffer(out, "<u4")[:n].astype(float) + 0.5) / 4294967296.0


def normals(name: str, n: int) -> np.ndarray:
    u = uniforms(name, 2 * n)
    return np.sqrt(-2 * np.log(u[:n])) * np.cos(2 * math.pi * u[n:])


class LinearArms:
    """A ridge regression for each arm; its inverse matrix is kept by rank-one updates."""

    def __init__(self, arms: int, width: int, ridge: float = 1.0):
        self.inverse = np.stack([np.eye(width) / ridge] * arms)
        self.total = np.zeros((arms, width))
        self.weights = np.zeros((arms, width))

    def learn(self, arm: int, x: np.ndarray, reward: float) -> None:
        v = self.inverse[arm] @ x
        self.inverse[arm] -= np.outer(v, v) / (1.0 + x @ v)
        self.total[arm] += reward * x
        self.weights[arm] = self.inverse[arm] @ self.total[arm]

    def spread(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(np.einsum("i,kij,j->k", x, self.inverse, x), 0.0))


class Bandit:
    """Chooses an arm for each round's context; a reward teaches only from the moment it is known."""

    def __init__(self, policy: str, arms: int, width: int, name: str, epsilon: float = 0.1, alpha: float = 0.5, scale: float = 0.1):
        if policy not in POLICIES:
            raise ValueError(policy)
        self.model = LinearArms(arms, width)
        self.policy, self.name, self.arms = policy, name, arms
        self.epsilon, self.alpha, self.scale = epsilon, alpha, scale
        self.rounds = self.updates = 0
        self.gained = 0.0
        self._waiting: list[tuple] = []

    def choose(self, x: np.ndarray) -> int:
        """The best arm by the policy, the least number on ties; draws are hashes of the bandit's name and the round."""
        mean = self.model.weights @ x
        if self.policy == "epsilon":
            u = uniforms(f"{self.name}:{self.rounds}", 2)
            return int(u[1] * self.arms) if u[0] < self.epsilon else int(np.argmax(mean))
        if self.policy == "linucb":
            return int(np.argmax(mean + self.alpha * self.model.spread(x)))
        return int(np.argmax(mean + self.scale * self.model.spread(x) * normals(f"{self.name}:{self.rounds}", self.arms)))

    def round(self, now: float, x: np.ndarray, rewards: np.ndarray, delays: np.ndarray) -> int:
        """One round: what is known by now is learned in the order in which it became known, then an arm is chosen; its reward is known after its delay."""
        while self._waiting and self._waiting[0][0] <= now:
            _, _, arm, then, reward = heapq.heappop(self._waiting)
            self.model.learn(arm, then, reward)
            self.updates += 1
        arm = self.choose(x)
        heapq.heappush(self._waiting, (now + float(delays[arm]), self.rounds, arm, x, float(rewards[arm])))
        self.rounds += 1
        self.gained += float(rewards[arm])
        return arm


class Desk:
    """All policies over one series of rounds, and what each arm alone would have earned."""

    def __init__(self, key: int, arms: int, context: list[str], now: str = "t"):
        self._key, self._arms, self._context, self._now = key, arms, context, now
        self._bandits = [Bandit(p, arms, len(context), f"{p}:{key}") for p in POLICIES]
        self._alone = np.zeros(arms)

    def feed(self, rows) -> list[tuple]:
        x = rows[self._context].to_numpy(float)
        rewards, delays = (rows[[f"{c}{k}" for k in range(self._arms)]].to_numpy(float) for c in ("reward", "delay"))
        self._alone += rewards.sum(axis=0)
        for now, *r in zip(rows[self._now].tolist(), x, rewards, delays, strict=True):
            for b in self._bandits:
                b.round(now, *r)
        return []

    def end(self) -> list[tuple]:
        return [(self._key, b.policy, b.rounds, b.updates, b.gained, float(self._alone.max())) for b in self._bandits]


def _many_uniforms(names: list[str], n: int) -> np.ndarray:
    """uniforms of each name, one row a name."""
    out = b"".join(hashlib.sha256(f"{name}:{i}".encode()).digest() for name in names for i in range(-(-n // 8)))
    return (np.frombuffer(out, "<u4").reshape(len(names), -1)[:, :n].astype(float) + 0.5) / 4294967296.0


class Desks:
    """What Desk makes of many whole series, round by round for all of them at once."""

    def __init__(self, arms: int, context: list[str], now: str = "t", ridge: float = 1.0, epsilon: float = 0.1, alpha: float = 0.5, scale: float = 0.1):
        self._arms, self._context, self._now, self._ridge = arms, context, now, ridge
        self._epsilon, self._alpha, self._scale = epsilon, alpha, scale

    def results(self, series: list[tuple]) -> list[tuple]:
        """Rows of the result from (key, rows) of each series."""
        series = sorted(series, key=lambda s: -len(s[1]))  # those that still go on are the first ones
        arms, width, keys = self._arms, len(self._context), [k for k, _ in series]
        sizes = np.array([len(x) for _, x in series])
        start, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(series)), sizes)
        number = np.arange(len(owner)) - start[owner]
        column = lambda c: np.concatenate([x[c].to_numpy(float) for _, x in series])
        x, t = np.stack([column(c) for c in self._context], 1), column(self._now)
        rewards, delays = (np.stack([column(f"{c}{k}") for k in range(arms)], 1) for c in ("reward", "delay"))

        # Every reward that could be earned, by the round that would learn it and the order there.
        ready = t[:, None] + delays
        known = np.stack([np.concatenate([np.searchsorted(t[a : a + n], ready[a : a + n, k]) for a, n in zip(start.tolist(), sizes.tolist(), strict=True)]) for k in range(arms)], 1)
        known = np.maximum(known, number[:, None] + 1)
        row, arm = np.nonzero(known < sizes[owner][:, None])
        order = np.lexsort((row, ready[row, arm], owner[row], known[row, arm]))
        row, arm = row[order], arm[order]
        edges = np.searchsorted(known[row, arm], np.arange(sizes[0] + 1))

        line = [(keys[o], n) for o, n in zip(owner.tolist(), number.tolist(), strict=True)]
        explore = _many_uniforms([f"epsilon:{k}:{n}" for k, n in line], 2)
        u = _many_uniforms([f"thompson:{k}:{n}" for k, n in line], 2 * arms)
        drawn = np.sqrt(-2 * np.log(u[:, :arms])) * np.cos(2 * math.pi * u[:, arms:])

        lines = len(POLICIES) * len(keys)
        inverse = np.tile(np.eye(width) / self._ridge, (lines, arms, 1, 1))
        total, weights = np.zeros((lines, arms, width)), np.zeros((lines, arms, width))
        chosen = np.zeros((len(POLICIES), len(owner)), np.int64)
        gained, updates = np.zeros((len(POLICIES), len(keys))), np.zeros((len(POLICIES), len(keys)), np.int64)
        for r in range(sizes[0]):
            some = slice(edges[r], edges[r + 1])
            policy, at = np.nonzero(chosen[:, row[some]] == arm[some])
            if len(at):
                self._learn(policy * len(keys) + owner[row[some]][at], arm[some][at], x[row[some]][at], rewards[row[some], arm[some]][at], inverse, total, weights)
                np.add.at(updates, (policy, owner[row[some]][at]), 1)
            here = int(np.searchsorted(-sizes, -r))  # series with more than r rounds
            now = start[:here] + r
            seen = x[now]
            shape = (len(POLICIES), len(keys), arms)
            mean = (weights.reshape(*shape, width)[:, :here] * seen[None, :, None]).sum(-1)
            by = inverse.reshape(*shape, width, width)[1:, :here]
            spread = np.sqrt(np.maximum(((by * seen[None, :, None, None]).sum(-1) * seen[None, :, None]).sum(-1), 0.0))
            first = np.where(explore[now, 0] < self._epsilon, (explore[now, 1] * arms).astype(np.int64), mean[0].argmax(1))
            chosen[:, now] = [first, (mean[1] + self._alpha * spread[0]).argmax(1), (mean[2] + self._scale * spread[1] * drawn[now]).argmax(1)]
            gained[:, :here] += rewards[now[None], chosen[:, now]]
        alone = np.add.reduceat(rewards, start).max(1)
        return [(k, p, int(sizes[o]), int(updates[i, o]), float(gained[i, o]), float(alone[o])) for o, k in enumerate(keys) for i, p in enumerate(POLICIES)]

    @staticmethod
    def _learn(line: np.ndarray, arm: np.ndarray, x: np.ndarray, reward: np.ndarray, inverse: np.ndarray, total: np.ndarray, weights: np.ndarray) -> None:
        """Rank-one updates as in LinearArms: the first of every line, then the second, and so on."""
        turn = np.arange(len(line)) - np.searchsorted(line, line)
        for j in range(int(turn.max()) + 1):
            s = turn == j
            at, then = (line[s], arm[s]), x[s]
            before = inverse[at]
            v = (before * then[:, None]).sum(-1)
            before -= v[:, :, None] * v[:, None] / (1.0 + (then * v).sum(-1))[:, None, None]
            inverse[at] = before
            total[at] += reward[s][:, None] * then
            weights[at] = (before * total[at][:, None]).sum(-1)
