"""The cutting-stock linear program over length-histogram patterns, solved by column generation."""

from __future__ import annotations

import numpy as np


def _knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity with any number of each size (values[size], -inf where there is none), and the size chosen (0: none)."""
    best, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = values[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], chosen[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, chosen


def _pattern(chosen: np.ndarray, capacity: int, first: int = 0) -> dict[int, int]:
    out = {first: 1} if first else {}
    c = capacity - first
    while c > 0:
        if size := int(chosen[c]):
            out[size] = out.get(size, 0) + 1
            c -= size
        else:
            c -= 1
    return out


def _inverse(patterns: list[dict[int, int]], row: dict[int, int]) -> np.ndarray:
    """Of the basis, by Gauss-Jordan steps on whole rows: threaded BLAS may not be called beside a JVM's forks."""
    m = len(row)
    work = np.zeros((m, 2 * m))
    for j, p in enumerate(patterns):
        for s, k in p.items():
            work[row[s], j] = k
    work[np.arange(m), m + np.arange(m)] = 1
    for j in range(m):
        pivot = j + int(np.abs(work[j:, j]).argmax())
        work[[j, pivot]] = work[[pivot, j]]
        work[j] /= work[j, j]
        others = np.flatnonzero(work[:, j])
        others = others[others != j]
        work[others] -= work[others, j, None] * work[j]
    return np.ascontiguousarray(work[:, m:])


def _greedy(sizes: list[int], need: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """A basis to start from: the largest size left, filled up as far as can be, as often as the demand allows; each pattern uses up
    a size that no later one has, so the basis is triangular and its times are those taken."""
    left, row = need.copy(), {s: i for i, s in enumerate(sizes)}
    patterns: list[dict[int, int] | None] = [None] * len(sizes)
    times, values, chosen = np.zeros(len(sizes)), np.full(capacity + 1, -np.inf), None
    values[sizes] = np.array(sizes) * (1 + 1e-4 * np.array(sizes))
    for first in reversed(sizes):
        while left[row[first]] > 0:
            if chosen is None:
                chosen = _knapsack(values, capacity)[1]
            p = _pattern(chosen, capacity, first)
            t, out = min((left[row[s]] / k, s) for s, k in p.items())
            for s, k in p.items():
                left[row[s]] -= k * t
            patterns[row[out]], times[row[out]] = p, t
            left[row[out]], values[out], chosen = 0, -np.inf, None
    return [p or {s: capacity // s} for p, s in zip(patterns, sizes, strict=True)], times


def solve(demand: dict[int, int], capacity: int, tolerance: float = 0.001, most_pivots: int = 400) -> list[tuple[dict[int, int], float]]:
    """(pattern, times) of the linear program's basis; a pattern is {size: how many}, its sizes at most ``capacity`` together.

    Starts from greedy patterns; a knapsack by dynamic programming prices new patterns. Ends when the number of bins is
    within ``tolerance`` of its lower bound (the total size, or Farley's bound), or after ``most_pivots``: the basis covers
    the demand at any time, so an early end means some more padding and nothing else.
    """
    sizes = sorted(s for s, n in demand.items() if n > 0)
    if not sizes:
        return []
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError("sizes lie between 1 and the capacity")
    m, row = len(sizes), {s: i for i, s in enumerate(sizes)}
    need = np.array([demand[s] for s in sizes], float)
    patterns, x = _greedy(sizes, need, capacity)
    inverse = _inverse(patterns, row)
    bound, pivots = (need * np.array(sizes)).sum() / capacity, 0
    while pivots < most_pivots:
        duals = inverse.sum(axis=0)
        values = np.full(capacity + 1, -np.inf)
        values[sizes] = duals
        best, chosen = _knapsack(values, capacity)
        bound = max(bound, x.sum() / max(best[capacity], 1.0))
        if best[capacity] <= 1 + 1e-9 or x.sum() <= (1 + tolerance) * bound:
            break
        forced = duals + best[capacity - np.array(sizes)]
        moved = False
        for first in [0, *(sizes[i] for i in np.argsort(-forced)[:12])]:
            column = np.zeros(m)
            for s, k in (p := _pattern(chosen, capacity, first)).items():
                column[row[s]] += k
            if (inverse.sum(axis=0) * column).sum() <= 1 + 1e-9:
                continue
            u = (inverse * column).sum(axis=1)
            up = u > 1e-10
            if not up.any():
                continue
            ratio = np.where(up, x / np.where(up, u, 1), np.inf)
            out = int(ratio.argmin())
            step = ratio[out]
            x -= step * u
            x[out] = step
            np.maximum(x, 0, out=x)
            line = inverse[out] / u[out]
            inverse -= np.outer(u, line)
            inverse[out] = line
            patterns[out] = p
            pivots, moved = pivots + 1, True
            if pivots % 300 == 0:  # rounding errors are cleared
                inverse = _inverse(patterns, row)
                x = np.maximum((inverse * need).sum(axis=1), 0)
        if not moved:
            break
    return [(p, float(v)) for p, v in zip(patterns, x, strict=True) if v > 0]


def whole_patterns(demand: dict[int, int], capacity: int, **how) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """The program's patterns rounded down, never past the demand, and the demand they leave."""
    left, out = dict(demand), []
    for p, times in solve(demand, capacity, **how):
        n = min([int(times + 1e-6), *(left[s] // k for s, k in p.items())])
        if n > 0:
            out.append((p, n))
            for s, k in p.items():
                left[s] -= n * k
    return out, {s: n for s, n in left.items() if n}
