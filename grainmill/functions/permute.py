"""Keyed bijections of row numbers: an 8-round Feistel network with cycle walking, forwards and backwards, on numpy ``uint64``.

Backwards is what the plans use: each row works out its own place in the shuffled order, so a global shuffle
needs no table of the order and no join, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
WALKS = 10_000
_U = np.uint64
M64 = (1 << 64) - 1
_GOLD = 0x9E3779B97F4A7C15


def mix_seed(*parts: int) -> int:
    """FNV-1a over whole numbers."""
    h = 0xCBF29CE484222325
    for p in parts:
        h = ((h ^ (int(p) & M64)) * 0x100000001B3) & M64
    return h


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _U(_GOLD)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _network(v: np.ndarray, bits: int, seed: np.ndarray | int, back: bool) -> np.ndarray:
    rb = bits - bits // 2
    lm, rm = _U((1 << (bits // 2)) - 1), _U((1 << rb) - 1)
    left, right = v >> _U(rb), v & rm
    seed = _U(seed & M64) if isinstance(seed, int) else seed
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        # the round's number times the constant isn't cut to 64 bits before the xor; its low 64 bits are all that counts
        key = seed ^ _U(((r + 1) * _GOLD) & M64)
        if r % 2 == 0:
            right = (right ^ _mixed(left ^ key)) & rm
        else:
            left = (left ^ _mixed(right ^ key)) & lm
    return (left << _U(rb)) | right


def permute(index: np.ndarray, total: int, seed: np.ndarray | int, back: bool = False) -> np.ndarray:
    """The image of each of ``index`` (in 0..total - 1), or with ``back`` what it is the image of. ``seed`` may differ by row (uint64)."""
    index = np.asarray(index, np.int64)
    if total <= 0:
        raise ValueError("total must be positive")
    if len(index) and (index.min() < 0 or index.max() >= total):
        raise ValueError("an index is out of range")
    if total == 1:
        return np.zeros(len(index), np.int64)
    bits = max(2, (total - 1).bit_length())
    out = _network(index.astype(_U), bits, seed, back)
    for _ in range(WALKS):
        far = np.flatnonzero(out >= total)
        if not len(far):
            return out.astype(np.int64)
        out[far] = _network(out[far], bits, seed if isinstance(seed, int) else seed[far], back)
    raise RuntimeError("[LanceGlobalShuffleCycleWalkLimit] the walk does not come back into range")


def permuted(index: Column, total: int, seed: int, back: bool = False, rounds: Column | None = None) -> Column:
    """``permute`` of a column; with ``rounds`` the seed grows by that column."""
    if total <= 1:
        return index.cast("long")
    if rounds is None:

        @F.pandas_udf("long")
        def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in it:
                yield pd.Series(permute(s.to_numpy(), total, seed, back))

        return run(index.cast("long"))

    @F.pandas_udf("long")
    def run_rounds(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, r in it:
            u = np.unique(r.to_numpy())
            seeds = np.array([(seed + int(x)) & M64 for x in u], _U)
            yield pd.Series(permute(s.to_numpy(), total, seeds[np.searchsorted(u, r.to_numpy())], back))

    return run_rounds(index.cast("long"), rounds.cast("long"))
