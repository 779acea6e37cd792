"""Merging streams (M1-M6): the place of the n-th row of each source in the merged order.

Concatenation and round robin are closed formulas. Smooth weighted round robin repeats itself between exhaustions: the picks of one period are
simulated on the driver and every further place follows by arithmetic, whatever the number of rows. The random strategies follow
one generator per slot, so their picks are simulated, once for each slot in executors, and joined to the rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np

STRATEGIES = ("concat", "round_robin", "weighted_round_robin", "random", "weighted_random")


@dataclass(frozen=True)
class Phase:
    """From place ``start`` on, picks repeat with period ``len(picks)``; source s has had ``had[s]`` rows before."""

    start: int
    had: tuple[int, ...]
    picks: np.ndarray
    length: int  # rows of the phase

    def places(self, source: int, nth: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.picks == source)
        turn, k = np.divmod(nth - self.had[source], len(at))
        return self.start + turn * len(self.picks) + at[k]


def weighted_phases(counts: Sequence[int], weights: Sequence[int]) -> list[Phase]:
    """The phases of smooth weighted round robin over sources of these lengths."""
    n = len(counts)
    current, left = [0] * n, list(counts)
    alive = list(range(n))
    out: list[Phase] = []
    place = 0

    def pick() -> int:
        for i in alive:
            current[i] += weights[i]
        best = max(alive, key=lambda i: current[i])  # the first of equals
        current[best] -= sum(weights[i] for i in alive)
        return best

    while alive:
        had = tuple(c - r for c, r in zip(counts, left))
        seen, picks, dead = {}, [], None
        spare = list(left)
        # simulate until the state comes back or a source that has no rows is picked
        while True:
            state = tuple(current[i] for i in alive)
            if state in seen:
                break
            seen[state] = len(picks)
            i = pick()
            if not spare[i]:
                dead = i
                break
            picks.append(i)
            spare[i] -= 1
        if dead is None:
            lead = seen[state]
            period = np.array(picks[lead:])
            if lead:
                out.append(Phase(place, had, np.array(picks[:lead]), lead))
                for i in picks[:lead]:
                    left[i] -= 1
                place += lead
                had = tuple(c - r for c, r in zip(counts, left))
            share = np.bincount(period, minlength=n)
            turns = min(left[i] // share[i] for i in alive if share[i])
            # whole turns, then on pick by pick until a source turns out to be empty
            for i in alive:
                left[i] -= int(turns * share[i])
            rest = []
            while True:
                i = pick()
                if not left[i]:
                    dead = i
                    break
                rest.append(i)
                left[i] -= 1
            if turns:
                out.append(Phase(place, had, period, int(turns) * len(period)))
                place += int(turns) * len(period)
                had = tuple(c - r - rest.count(i) for i, (c, r) in enumerate(zip(counts, left)))
            if rest:
                out.append(Phase(place, had, np.array(rest), len(rest)))
                place += len(rest)
        else:
            if picks:
                out.append(Phase(place, had, np.array(picks), len(picks)))
                place += len(picks)
                left = spare
        alive.remove(dead)
    return out


@lru_cache(maxsize=64)
def _phases(counts: tuple[int, ...], weights: tuple[int, ...]) -> list[Phase]:
    return weighted_phases(counts, weights)


def weighted_places(counts: Sequence[int], weights: Sequence[int], source: int, nth: np.ndarray) -> np.ndarray:
    """The place of rows ``nth`` of a source."""
    out = np.full(len(nth), -1, np.int64)
    for p in _phases(tuple(counts), tuple(weights)):
        if source in p.picks:
            took = p.length // len(p.picks) * int((p.picks == source).sum())
            k = (nth >= p.had[source]) & (nth < p.had[source] + took)
            out[k] = p.places(source, nth[k])
    return out


def random_picks(counts: Sequence[int], weights: Sequence[int] | None, seed: int) -> Iterator[int]:
    """The source of each place in turn, by ``random.Random(seed)``; a source is found to be empty by a wasted pick."""
    rng, left = random.Random(seed), list(counts)
    alive = list(range(len(counts)))
    while alive:
        if weights is None:
            i = rng.choice(alive)
        else:
            x = rng.randrange(sum(weights[a] for a in alive))
            for i in alive:
                x -= weights[i]
                if x < 0:
                    break
        if left[i]:
            left[i] -= 1
            yield i
        else:
            alive.remove(i)


def schedule(counts: Sequence[int], weights: Sequence[int] | None, seed: int, size: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The random merge in pieces: of each place in turn its source, the number of its row there, and the place itself."""
    picks, had, at = random_picks(counts, weights, seed), np.zeros(len(counts), np.int64), 0
    while got := list(islice(picks, size)):
        source = np.array(got, np.int64)
        nth = np.empty(len(got), np.int64)
        for i in np.unique(source):
            k = np.flatnonzero(source == i)
            nth[k] = had[i] + np.arange(len(k))
            had[i] += len(k)
        yield source, nth, np.arange(at, at + len(got))
        at += len(got)


def places(strategy: str, counts: Sequence[int], weights: Sequence[int], source: int, nth: np.ndarray, seed: int) -> np.ndarray:
    """The place in the merged order of rows ``nth`` of source number ``source``."""
    if strategy == "concat":
        return sum(counts[:source]) + nth
    if strategy == "round_robin":
        # rows of every source that come no later than this one: as many turns as each has, and one more for those before it
        c = np.array(counts)
        return np.minimum(nth[:, None], c[None, :]).sum(axis=1) + (c[None, :source] > nth[:, None]).sum(axis=1)
    if strategy == "weighted_round_robin":
        return weighted_places(counts, weights, source, nth)
    if strategy in ("random", "weighted_random"):
        parts = list(schedule(counts, weights if strategy == "weighted_random" else None, seed))
        return np.concatenate([np.zeros(0, np.int64), *(at[s == source] for s, _, at in parts)])[nth]
    raise ValueError(f"[UnsupportedMixedStrategy] {strategy!r} is none of {', '.join(STRATEGIES)}")
