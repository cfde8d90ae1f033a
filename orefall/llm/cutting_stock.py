"""Cutting stock: a linear program over patterns of piece sizes, whose columns a knapsack dynamic program prices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern (how many of each size, together at most room) of the largest worth, by dynamic programming over the room."""
    sizes_l = sizes.astype(np.int64)
    value = np.zeros(room + 1 + int(sizes_l.max()))
    value[: int(sizes_l.max())] = -np.inf  # places below zero
    shift = int(sizes_l.max())
    value[shift] = 0.0
    took = np.full(room + 1, -1, dtype=np.int64)
    for w in range(1, room + 1):
        v = value[shift + w - sizes_l] + worth
        c = int(v.argmax())
        if v[c] > value[shift + w - 1]:
            value[shift + w], took[w] = v[c], c
        else:
            value[shift + w] = value[shift + w - 1]
    counts, w = np.zeros(len(sizes), dtype=np.int64), room
    while w > 0:
        if took[w] >= 0:
            counts[took[w]] += 1
            w -= int(sizes_l[took[w]])
        else:
            w -= 1
    return float(value[shift + room]), counts


def fill_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that use up the demand: the largest size that fits comes first, a pattern repeats while the demand lasts."""
    left, out = demand.astype(np.int64).copy(), []
    order = np.argsort(-sizes)
    while left.any():
        counts, free = np.zeros(len(sizes), dtype=np.int64), room
        for c in order:
            k = min(int(left[c]), free // int(sizes[c]))
            if k > 0:
                counts[c], free = k, free - k * int(sizes[c])
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        left -= counts * times
        out.append((counts, times))
    return out


@dataclass
class Plan:
    patterns: list[tuple[np.ndarray, int]]  # how many of each size, and how many sequences
    bound: float  # no plan can have fewer sequences (by the last dual prices)
    columns: int  # columns that were priced


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4, most: int = 400) -> Plan:
    """Patterns that hold exactly the demand of each size in few sequences.

    Revised simplex on the columns met so far: dual prices go to the knapsack, whose pattern enters if it is worth more than
    one sequence. It ends at the optimum, when the objective is within `gap` of the bound, or after `most` columns, where the
    basis is still a feasible plan. The basis is rounded down; what that leaves is filled size by size.
    """
    have = demand > 0
    if not have.any():
        return Plan([], 0.0, 0)
    s, d = sizes[have].astype(np.int64), demand[have].astype(np.float64)
    m = len(s)
    columns = np.diag((room // s).astype(np.float64))
    inverse = np.diag(1.0 / (room // s))
    x = inverse @ d
    bound, priced = float((s * d).sum() / room), 0
    for _ in range(most):
        y = inverse.sum(axis=0)
        if x.sum() <= bound * (1 + gap):
            break
        worth, a = best_pattern(s, y, room)
        priced += 1
        bound = max(bound, float(y @ d) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        move = inverse @ a
        ok = move > 1e-9
        ratio = np.where(ok, x / np.where(ok, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        columns[:, out] = a
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    whole = np.floor(x + 1e-9).astype(np.int64)
    left = demand[have].astype(np.int64)
    patterns = []
    for j in np.argsort(-whole):
        a = columns[:, j].round().astype(np.int64)
        used = a > 0
        times = min(int(whole[j]), int((left[used] // a[used]).min())) if used.any() else 0
        if times > 0:
            patterns.append((a, times))
            left -= a * times
    patterns += fill_patterns(s, left, room)
    full = []
    for a, times in patterns:
        b = np.zeros(len(sizes), dtype=np.int64)
        b[have] = a
        full.append((b, times))
    return Plan(full, bound, priced)
