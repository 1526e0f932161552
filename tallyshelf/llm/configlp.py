"""Configurations of a bin-packing instance over a length histogram.

The configuration linear program asks for the fewest sequences such that every
length is covered as often as it occurs.  Multiplicative weights keep a price for
each length; a knapsack dynamic program finds the configurations of greatest
price.  Lengths covered ahead of the schedule get cheaper, lengths behind dearer.
Any prices bound the program from below: no sequence is worth more than the best
configuration.

The solution is rounded: its configurations that fill their sequence are taken as
often as its whole amounts say, then once each, the fullest and those of few lengths first, up to half of its value; the
program is solved again on what is left, until no more pieces are left than there
are lengths.  This remainder is packed best-fit.  Best-fit alone answers only where
the program's answer is above its bound and best-fit's is smaller.

Everything here works on at most ``capacity`` lengths and their counts, whatever
the number of documents, and is deterministic.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from math import ceil

import numpy as np

#: Rounds of the multiplicative weights, more where value and bound differ by more
#: than the share GAP, and the learning rate; in the sweeps of a round, how far below
#: the best price a configuration may be.
ROUNDS, GAP, RATE, TOLERANCES = (6, 12, 24), 0.005, 0.5, (0.3, 1.0, 1.0)
#: Among configurations that fill a sequence alike, long lengths are preferred:
#: prices are lengths to these powers, in the rounds of the program and in what they leave.
POWER, LAST_POWER = 1.02, 1.1
#: A configuration counts as full if it leaves at most this share of its sequence;
#: the share of a solution's value that is taken before the program is solved again.
SLACK, TAKEN = 1 / 256, 0.5


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for every capacity up to ``capacity`` (items may repeat)
    and the item that a best choice takes (-1: none)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fits[c]
        best[c] = best[c - 1]
        if k:
            worth = prices[:k] + best[c - sizes[:k]]
            i = int(worth.argmax())
            if worth[i] > best[c]:
                best[c], take[c] = worth[i], i
    return best, take


def _fill(sizes: list[int], take: list[int], space: int) -> list[int]:
    out = []
    while space > 0:
        i = take[space]
        if i < 0:
            space -= 1
        else:
            out.append(i)
            space -= sizes[i]
    return out


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], float]:
    """A solution of the program, amounts of configurations (sorted item indices),
    and the best lower bound that its prices prove: of as many rounds as bring both
    within GAP of each other, or of the most."""
    found, bound = [], 0.0
    for rounds in ROUNDS:
        amounts, proved = solve(sizes, counts, capacity, rounds)
        found.append(amounts)
        bound = max(bound, proved)
        if sum(amounts.values()) <= (1 + GAP) * bound:
            break
    return min(found, key=lambda amounts: sum(amounts.values())), bound


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[dict[tuple[int, ...], float], float]:
    """The solution and bound of so many rounds.  Round t may cover each length up to
    the share t / rounds of its count; what the last round leaves is covered at
    prices of its own, each step using up at least one length."""
    amounts: dict[tuple[int, ...], float] = defaultdict(float)
    room = np.zeros(len(sizes)).tolist()
    weight = np.ones(len(sizes))
    listed, share = sizes.tolist(), sizes / capacity
    bound = float((sizes * counts).sum() / capacity)

    def sweep(prices: np.ndarray, tolerance: float) -> bool:
        nonlocal bound
        best, take = knapsack(sizes, prices, capacity)
        if best[capacity] > 0:
            bound = max(bound, float((prices * counts).sum() / best[capacity]))
        steps, moved = take.tolist(), False
        for i in range(len(sizes) - 1, -1, -1):
            if room[i] <= 1e-9 or prices[i] + best[capacity - listed[i]] < (1 - tolerance) * best[capacity]:
                continue
            items = sorted([i, *_fill(listed, steps, capacity - listed[i])])
            need = Counter(items)
            amount = min(room[k] / m for k, m in need.items())
            if amount > 1e-9:
                amounts[tuple(items)] += amount
                moved = True
                for k, m in need.items():
                    room[k] -= amount * m
        return moved

    for _ in range(rounds):
        room = [r + c / rounds for r, c in zip(room, counts.tolist(), strict=True)]
        for tolerance in TOLERANCES:
            behind = np.array(room) * rounds / counts  # in rounds
            weight *= np.exp(RATE * np.clip(behind - 1, -1, 1))
            weight /= weight.mean()
            sweep(np.where(behind > 1e-9, np.clip(weight, 0.05, 20), 0) * share**POWER, tolerance)
    while max(room) > 1e-9 and sweep(np.where(np.array(room) > 1e-9, share**LAST_POWER, 0), 1.0):
        pass
    return amounts, bound


def rounded(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration as lengths, copies) that use every length exactly ``counts`` times."""
    listed, left = sizes.tolist(), counts.astype(np.int64)
    out: dict[tuple[int, ...], int] = defaultdict(int)
    bound = float((sizes * counts).sum() / capacity)
    while left.sum() > len(sizes):
        live = np.flatnonzero(left)
        amounts, proved = fractional(sizes[live], left[live], capacity)
        if not out:
            bound = proved
        full = []
        for items, amount in amounts.items():
            config = tuple(live[list(items)].tolist())
            waste = capacity - sum(listed[k] for k in config)
            if waste <= capacity * SLACK:
                full.append((waste, len(config), -amount, config))
        most, taken = TAKEN * sum(amounts.values()), 0
        for once in (False, True):
            for _, _, minus, config in sorted(full):
                if once and taken >= most:
                    break
                need = Counter(config)
                copies = min(1 if once else int(1e-9 - minus), *(int(left[k]) // m for k, m in need.items()))
                if copies > 0:
                    out[tuple(listed[k] for k in config)] += copies
                    taken += copies
                    for k, m in need.items():
                        left[k] -= copies * m
        if not taken:
            break
    for config, copies in best_fit(listed, left.tolist(), capacity):
        out[config] += copies
    if sum(out.values()) > ceil(bound - 1e-9):
        plain = dict(best_fit(listed, counts.tolist(), capacity))
        if sum(plain.values()) < sum(out.values()):
            return sorted(plain.items())
    return sorted(out.items())


def best_fit(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, many equal sequences at a time."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for size, n in sorted(zip(sizes, counts, strict=True), reverse=True):
        while n > 0:
            space = next((c for c in range(size, capacity) if open_.get(c)), None)
            if space is None:
                m = capacity // size
                config, copies, taken = ((size,) * m, n // m, m) if n >= m else ((size,) * n, 1, n)
                space = capacity
            else:
                old = next(iter(open_[space]))
                there = open_[space].pop(old)
                m = min(space // size, n)
                copies = min(there, n // m)
                if there > copies:
                    open_[space][old] = there - copies
                config, taken = (*old, *(size,) * m), m
            n -= copies * taken
            rest = space - size * taken
            open_[rest][config] = open_[rest].get(config, 0) + copies
    return [x for configs in open_.values() for x in configs.items()]
