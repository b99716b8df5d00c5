"""All pairs of a bounded number of weighted texts, compared at once.

The common weight of two texts is a sum over terms of the smaller weight. A term that few
texts have adds to its pairs one by one. A term that many have becomes one 0/1 column for
each of its distinct weights (has the text that weight or more?), valued by the step from
the weight below; the common weights of all pairs are then products of these columns.
"""

from __future__ import annotations

import numpy as np

#: Texts of a term up to which its pairs are added one by one.
FEW = 8
COLUMNS = 1024


class Cell:
    """Texts of a left and a right side (or both); links() compares every left one with every right one."""

    def __init__(self) -> None:
        self.uids: list[int] = []
        self.roots: list[int] = []
        self.sides: list[tuple[bool, bool]] = []
        self.vectors: list[tuple[np.ndarray, np.ndarray]] = []
        self.totals: list[float] = []

    def add(self, uid: int, root: int, left: bool, right: bool, terms: np.ndarray, weights: np.ndarray, total: float) -> None:
        self.uids.append(uid)
        self.roots.append(root)
        self.sides.append((left, right))
        self.vectors.append((terms, weights))
        self.totals.append(total)

    def links(self, threshold: float) -> dict[str, list[int]]:
        """a and b of links of `threshold` or more that join the roots which such links connect, without a cycle."""
        out: dict[str, list[int]] = {"a": [], "b": []}
        _, root = np.unique(self.roots, return_inverse=True)
        if len(root) < 2 or root.max() == 0:
            return out
        left, right = (np.flatnonzero(x) for x in np.array(self.sides).T)
        total = np.array(self.totals)
        both = common(self.vectors, left, right)
        # J = both / (a + b - both)
        similar = both >= threshold / (1 + threshold) * (total[left, None] + total[right])
        similar &= (both > 0) & (root[left, None] != root[right])
        for i, row in zip(left, similar, strict=True):
            partners = right[row]
            for j in partners[np.unique(root[partners], return_index=True)[1]]:
                if root[j] != root[i]:
                    out["a"].append(self.uids[i])
                    out["b"].append(self.uids[j])
                    root[root == root[j]] = root[i]
        return out


def common(vectors: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The common weight of every left and every right text. A vector is distinct terms and their weights."""
    n = len(vectors)
    text = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
    term, weight = (np.concatenate([v[x] for v in vectors]) for x in (0, 1))
    order = np.lexsort((weight, term))
    text, term, weight = text[order], term[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(term))

    pairs = np.zeros(n * n)
    for d in range(2, FEW + 1):
        at = first[size == d]
        for x in range(d) if len(at) else ():
            for y in range(x + 1, d):  # the texts of a term are in order of weight
                np.add.at(pairs, text[at + x] * n + text[at + y], weight[at + x])
    pairs = pairs.reshape(n, n)
    both = pairs[np.ix_(left, right)] + pairs[np.ix_(right, left)].T

    many = np.repeat(size > FEW, size)
    text, term, weight = text[many], term[many], weight[many]
    if not len(term):
        return both
    opens = np.concatenate([[True], term[1:] != term[:-1]])
    steps = opens | np.concatenate([[True], weight[1:] != weight[:-1]])
    column = np.cumsum(steps) - 1
    value = np.diff(weight[steps], prepend=0.0)
    value[opens[steps]] = weight[opens]
    begins = np.maximum.accumulate(np.where(opens, column, 0))  # a text has all columns of the term from there to its own
    ends = column[np.append(np.flatnonzero(opens)[1:], len(term)) - 1][np.cumsum(opens) - 1]
    for lo in range(0, len(value), COLUMNS):
        hi = min(lo + COLUMNS, len(value))
        e = slice(np.searchsorted(ends, lo), np.searchsorted(begins, hi))
        a, z = np.maximum(begins[e], lo), np.minimum(column[e] + 1, hi)
        n_of = np.maximum(z - a, 0)
        has = np.zeros((n, hi - lo))
        within = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        has[np.repeat(text[e], n_of), np.repeat(a - lo, n_of) + within] = 1
        both += (has[left] * value[lo:hi]) @ has[right].T
    return both
