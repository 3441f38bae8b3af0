"""Numpy kernels over plain arrays; Spark deals out the rows, these work on one batch."""

from __future__ import annotations

import numpy as np


def unit_rows(x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps)


def soft_weights(tokens: np.ndarray, centroids: np.ndarray, beta: float, floor: float = 1e-8) -> np.ndarray:
    """exp(-beta (1 - cosine)) with rows summing to one; both sides are unit vectors."""
    w = np.exp(-beta * (1.0 - tokens @ centroids.T))
    return w / np.maximum(w.sum(1, keepdims=True), floor)


def nearest(tokens: np.ndarray, centroids: np.ndarray, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Closest centroid of each row by Euclidean distance (first on a tie), and the squared distance. With ``digits``, distances that are equal to so many decimals tie."""
    d = (tokens * tokens).sum(1)[:, None] - 2 * tokens @ centroids.T + (centroids * centroids).sum(1)[None]
    word = d.argmin(1)
    if digits is not None and len(centroids) > 1:
        _settle(tokens, centroids, digits, d, word)
    diff = tokens - centroids[word]
    return word, (diff * diff).sum(1)


def _settle(tokens: np.ndarray, centroids: np.ndarray, digits: int, d: np.ndarray, word: np.ndarray) -> None:
    """Decides ``word`` by rounded distances where several centroids come near enough to the closest, by ``d``, to tie with it; these are taken from the differences, as ``d`` is inexact near zero."""
    slack = 1e-13 * ((tokens * tokens).sum(1) + (centroids * centroids).sum(1).max())[:, None]
    least = np.take_along_axis(d, word[:, None], 1)
    near = np.sqrt(np.maximum(d - slack, 0)) <= np.sqrt(np.maximum(least, 0) + slack) + 10.0**-digits
    open_ = np.flatnonzero(near.sum(1) > 1)
    step = max(1, 4_000_000 // max(1, centroids.size))
    for at in range(0, len(open_), step):
        rows = open_[at : at + step]
        diff = tokens[rows][:, None, :] - centroids[None]
        exact = np.where(near[rows], np.round(np.sqrt((diff * diff).sum(2)), digits), np.inf)
        word[rows] = exact.argmin(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]
    return np.sqrt(np.maximum(d, 0))


#: Largest cost over ``eps`` with which scalings, at most its exponential either way, stay within double precision.
SAFE = 200.0


def _shares(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 1e-8)
    return x / x.sum(1, keepdims=True)


def sinkhorn(p: np.ndarray, q: np.ndarray, cost: np.ndarray, eps: float = 0.05, iterations: int = 50) -> np.ndarray:
    """Entropic transport cost of each pair of rows, plans with ``q`` along the rows and ``p`` along the columns, columns exact at the end.

    The kernel is one matrix for all pairs: an update is a product with it, and a pair holds two
    scalings and no plan. Costs of more than ``SAFE`` times ``eps`` are worked off in the log domain.
    """
    if np.abs(cost).max(initial=0.0) > SAFE * eps:
        return sinkhorn_log(p, q, cost, eps, iterations)
    a, b, kernel = _shares(q), _shares(p), np.exp(-cost / eps)
    u, v = np.ones_like(a), np.ones_like(b)
    for _ in range(iterations):
        u = a / (v @ kernel.T)
        v = b / (u @ kernel)
    return (u * (v @ (kernel * cost).T)).sum(1)


def sinkhorn_log(p: np.ndarray, q: np.ndarray, cost: np.ndarray, eps: float = 0.05, iterations: int = 50) -> np.ndarray:
    """The same with potentials in place of scalings, for any cost; a pair holds a plan, so pairs are worked off some at a time."""
    step = max(1, 4_000_000 // max(1, cost.size))

    def soft_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    out, k = [np.zeros(0)], -cost / eps
    for at in range(0, len(p), step):
        a, b = np.log(_shares(q[at : at + step])), np.log(_shares(p[at : at + step]))
        u, v = np.zeros_like(a), np.zeros_like(b)
        for _ in range(iterations):
            u = a - soft_sum(k[None] + v[:, None, :], 2)
            v = b - soft_sum(k[None] + u[:, :, None], 1)
        plan = np.exp(k[None] + u[:, :, None] + v[:, None, :])
        out.append((plan * cost[None]).sum((1, 2)))
    return np.concatenate(out)


def index_cost(k: int) -> np.ndarray:
    i = np.arange(k)
    return np.abs(i[:, None] - i[None]) / max(1, k - 1)


def pool_2x2(tokens: np.ndarray, side: int) -> np.ndarray:
    """Average of 2 x 2 neighbours of a row-major grid of tokens."""
    return tokens.reshape(side // 2, 2, side // 2, 2, -1).mean((1, 3)).reshape((side // 2) ** 2, -1)


def diverse_words(hist: np.ndarray, weights: np.ndarray, n: int = 6, pool: int = 64, cutoff: float = 0.18, penalty: float = 0.82) -> list[int]:
    """Words of one cell, picked one by one: relative weight minus ``penalty`` times the largest similarity of their token maps to those picked."""
    ranked = np.lexsort((-np.arange(len(hist)), hist))[::-1]
    n = min(max(1, n), len(hist))
    inside = ranked[: min(max(1, pool), len(hist))]
    strong = inside[hist[inside] >= hist[inside[0]] * cutoff]
    if len(strong) >= n:
        inside = strong
    size = np.linalg.norm(weights, axis=0)
    maps = np.where(size > 1e-8, weights / np.maximum(size, 1e-8), 0)
    chosen = [int(inside[0])]
    left = [int(w) for w in inside[1:]]
    while left and len(chosen) < n:
        similar = (maps[:, left].T @ maps[:, chosen]).max(1)
        relative = hist[left] / (hist[chosen[0]] + 1e-8)
        best = int(np.lexsort((-np.array(left), relative, -similar, relative - penalty * similar))[-1])
        chosen.append(left.pop(best))
    return chosen + [int(w) for w in ranked if int(w) not in chosen][: n - len(chosen)]


#: Scores that are held at once, about.
SCORES = 4_000_000


def best_pairs(queries: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int, groups: tuple[np.ndarray, np.ndarray] | None = None, step: int = 1024, digits: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, item (row numbers) and inner product, to ``digits`` decimals, of the ``k`` best items of each query, best first, ties by the smaller id; with ``groups`` of the queries and the items, pairs of one group don't count.

    ``step`` queries meet some items at a time: what is held doesn't grow with both. Of later items only those that reach a query's ``k``-th best so far are looked at again.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    m = min(k, len(items))
    across = max(m, SCORES // step, 1)
    for at in range(0, len(queries) if m else 0, step):
        some = queries[at : at + step].astype(np.float64, copy=False)
        row, column, value = found[0]
        bar = np.full(len(some), -np.inf)
        for start in range(0, len(items), across):
            score = some @ items[start : start + across].astype(np.float64, copy=False).T
            if groups is not None:
                score[groups[0][at : at + step, None] == groups[1][None, start : start + across]] = -np.inf
            if not start:
                bar = -np.partition(-score, m - 1, axis=1)[:, m - 1]
            # All that may reach the m-th best once rounded, ties at the border included.
            r, c = np.nonzero(score >= bar[:, None] - 10.0**-digits)
            v = score[r, c]
            real = np.isfinite(v)
            row, column, value = np.concatenate((row, r[real])), np.concatenate((column, c[real] + start)), np.concatenate((value, np.round(v[real], digits)))
            order = np.lexsort((ids[column], -value, row))
            row, column, value = row[order], column[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row]
            row, column, value, place = (x[place < m] for x in (row, column, value, place))
            bar = np.full(len(some), -np.inf)
            bar[row[place == m - 1]] = value[place == m - 1]
        found.append((row + at, column, value))
    return tuple(np.concatenate(x) for x in zip(*found))
