"""Improved consistent weighted sampling of a document's weighted terms, and weighted Jaccard similarity."""

from __future__ import annotations

import numpy as np

from tidemark.llm import hashing as H

BANDS, ROWS = 16, 4

_u = (np.arange(1 << 16) + 0.5) / (1 << 16)
_x = np.concatenate([[0.0], np.geomspace(1e-4, 40, 20000)])
#: Quantiles of Gamma(2, 1), by the distribution function 1 - (1 + x) exp(-x).
_GAMMA = np.interp(_u, 1 - (1 + _x) * np.exp(-_x), _x).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)
_UNIFORM = _u.astype(np.float32)
_ODD = H.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_16, _32, _48, _LOW = np.uint64(16), np.uint64(32), np.uint64(48), np.uint64(0xFFFF)


def band_keys(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of BANDS keys per document. terms and weights of all documents in a row, each document's from starts[i]; none is empty.

    For each of BANDS * ROWS samples a term's r and c are Gamma(2, 1) and beta uniform,
    drawn by its hash; t = floor(ln w / r + beta), and the term of the least
    ln a = ln c - r (t - beta + 1) is the sample, with its t.
    """
    lengths = np.diff(starts, append=len(terms))
    log_w = np.log(weights).astype(np.float32)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    owner = np.repeat(np.arange(len(starts)), lengths)
    for k, odd in enumerate(_ODD):
        z = terms * odd
        z ^= z >> _32
        r = _GAMMA[(z >> _48).astype(np.int64)]
        beta = _UNIFORM[(z >> _32 & _LOW).astype(np.int64)]
        t = np.floor(log_w / r + beta)
        a = _LOG_GAMMA[(z >> _16 & _LOW).astype(np.int64)] - r * (t - beta + 1)
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
        first = hit[np.unique(owner[hit], return_index=True)[1]]
        sample = H.mix(terms[first] + t[first].astype(np.int64).view(np.uint64) * np.uint64(H.WORD_BASE))
        band = k // ROWS
        keys[:, band] = H.mix(keys[:, band] * np.uint64(H.BYTE_BASE) + sample + np.uint64(band + 1))
    return keys


def can_link(weights: np.ndarray, shared: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
    """Which documents may have a similarity of `threshold` or more to any other. shared: the terms that other documents have too; layout as for band_keys.

    The common weight of a pair is at most that of a document's shared terms, and the
    weight of both together at least that of the document. The margin is for rounding.
    """
    return np.add.reduceat(weights * shared, starts) >= threshold * (1 - 1e-6) * np.add.reduceat(weights, starts)


def similarity(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Weighted Jaccard similarity of two documents: sorted distinct terms and their weights (terms that no other document has may be left out), and the weight of all terms."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = a[2] + b[2] - both
    return both / total if total > 0 else 0.0
