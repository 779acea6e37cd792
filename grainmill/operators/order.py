"""Orders: which slot reads a row, and at which place (O1-O12), as columns.

Row-indexed sources compute both from the row's number alone. Unit sources (files, row groups) have a small table of units that
is laid out on the driver and joined to the rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions.permute import M64, mix_seed, permute, permuted
from grainmill.session import small

SLOT, ROUND, POS = "__slot__", "__round__", "__pos__"
CONTROL = (SLOT, ROUND, POS)


@dataclass(frozen=True)
class ChunkShuffle:
    """Windows of ``k`` chunks of ``chunk_size`` rows; rows permuted within a window or in order within each chunk."""

    chunk_size: int = 250_000
    k: int = 8
    row_order: str = "permuted"

    @classmethod
    def of(cls, given: dict | ChunkShuffle | None) -> ChunkShuffle:
        if given is None or isinstance(given, cls):
            return given or cls()
        if not isinstance(given, dict):
            raise ValueError(f"[InvalidLanceChunkShuffle] chunk_shuffle must be a mapping, got {given!r}")
        if unknown := set(given) - {"chunk_size", "k", "row_order"}:
            raise ValueError(f"[InvalidLanceChunkShuffle] unknown keys {sorted(unknown)}")
        return cls(**given)

    def __post_init__(self) -> None:
        for name in ("chunk_size", "k"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                raise ValueError(f"[InvalidLanceChunkShuffle] {name} must be a positive whole number, got {v!r}")
        if self.row_order not in ("permuted", "sequential"):
            raise ValueError(f"[InvalidLanceChunkShuffle] row_order must be permuted or sequential, got {self.row_order!r}")

    def chunks(self, total: int, seed: int, round_: int) -> np.ndarray:
        """The order of the chunks in a round."""
        n = -(-total // self.chunk_size)
        return permute(np.arange(n), n, mix_seed(seed, round_, 0))

    def places(self, rows: np.ndarray, total: int, seed: int, round_: int) -> np.ndarray:
        """The place of each row number in the shuffled order."""
        chunks = -(-total // self.chunk_size)
        nth = lambda c: permute(c, chunks, mix_seed(seed, round_, 0), back=True)  # noqa: E731 - where chunks are; no list of them is needed
        # all chunks are full but the table's last one
        short, late = chunks * self.chunk_size - total, nth(np.array([chunks - 1]))[0]
        begin = lambda k: k * self.chunk_size - np.where(k > late, short, 0)  # noqa: E731 - place of the k-th chunk in shuffled order
        n = nth(rows // self.chunk_size)
        place = begin(n) + rows % self.chunk_size
        if self.row_order == "sequential":
            return place
        window = n // self.k
        first = begin(window * self.k)
        size = begin(np.minimum((window + 1) * self.k, chunks)) - first
        out = place.copy()
        for w in np.unique(window):
            k = window == w
            out[k] = first[k] + permute(place[k] - first[k], int(size[k][0]), mix_seed(seed, round_, 1, int(w)), back=True)
        return out


@dataclass(frozen=True)
class Selection:
    """A window of places, or (``seed`` given) the images of 0..count - 1 under a permutation of ``total``."""

    start: int
    count: int
    total: int
    seed: int | None = None


def round_size(count: int, slot: int, total_slots: int) -> int:
    """How many of ``count`` rows a slot reads in a round."""
    return -(-(count - slot) // total_slots) if slot < count else 0


def shuffled_place(row: Column, total: int, mode: str, seed: int, chunk: ChunkShuffle, rounds: Column) -> Column:
    """The place of row number ``row`` (of ``total``) in the source's order of a round."""
    if mode == "none" or total <= 1:
        return row.cast("long")
    if mode == "global":
        return permuted(row, total, seed, True, rounds)

    @F.pandas_udf("long")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, r in it:
            rows, rnd = s.to_numpy(), r.to_numpy()
            out = np.empty(len(rows), np.int64)
            for x in np.unique(rnd):
                out[rnd == x] = chunk.places(rows[rnd == x], total, seed, int(x))
            yield pd.Series(out)

    return run(row.cast("long"), rounds.cast("long"))


def deal_rows(df: DataFrame, index: str, total: int, select: Selection, mode: str, seed: int, chunk: ChunkShuffle, total_slots: int, rounds: int | range) -> DataFrame:
    """Add slot, round and place to rows numbered by ``index`` (0..total - 1). Rows outside the selection go. No shuffle, no join."""
    rounds = range(rounds) if isinstance(rounds, int) else rounds
    r = F.lit(rounds.start) if len(rounds) == 1 else F.explode(F.sequence(F.lit(rounds.start), F.lit(rounds.stop - 1)))
    df = df.withColumn(ROUND, r)
    if select.seed is None:
        df = df.withColumn("__eff__", shuffled_place(F.col(index), total, mode, seed, chunk, F.col(ROUND)) - select.start)
        df = df.where((F.col("__eff__") >= 0) & (F.col("__eff__") < select.count))
    else:
        df = df.withColumn("__eff__", permuted(F.col(index), select.total, select.seed, True) - select.start)
        df = df.where((F.col("__eff__") >= 0) & (F.col("__eff__") < select.count))
        df = df.withColumn("__eff__", shuffled_place(F.col("__eff__"), select.count, mode, seed, chunk, F.col(ROUND)))
    slot = F.pmod(F.col("__eff__"), F.lit(total_slots))
    per_round = F.greatest(F.lit(0), F.floor((F.lit(select.count - 1) - slot) / total_slots) + 1)
    pos = F.col(ROUND) * per_round + F.floor(F.col("__eff__") / total_slots)
    return df.withColumns({SLOT: slot.cast("int"), POS: pos.cast("long")}).drop("__eff__")


def deal_units(units: list[int], rows_of: dict[int, int], total_slots: int, seed: int, shuffle: bool, rounds: int) -> list[tuple[int, int, int, int]]:
    """``(unit, round, slot, first place)``: units shuffled each round, dealt in turn, the turn going on over rounds."""
    out, n = [], len(units)
    upto = [0] * total_slots
    for r in range(rounds):
        order = list(units)
        if shuffle:
            random.Random(seed + r).shuffle(order)
        for i, u in enumerate(order):
            s = (r * n + i) % total_slots
            out.append((u, r, s, upto[s]))
            upto[s] += rows_of[u]
    return out


def join_units(spark: SparkSession, df: DataFrame, unit: str, row: str, layout: list[tuple[int, int, int, int]]) -> DataFrame:
    """Put the layout of ``deal_units`` on rows that have the number of their unit and their row within it."""
    table = spark.createDataFrame(layout, f"`{unit}` int, {ROUND} int, {SLOT} int, __first__ long")
    return df.join(small(table), unit).withColumn(POS, (F.col("__first__") + F.col(row)).cast("long")).drop("__first__")


def dense(df: DataFrame, by: list[str], keys: list[str], out: str, width: int = 65_536) -> DataFrame:
    """Number the rows of each group of ``by`` from 0 in the order of ``keys``, the first of which is a number, without sorting a group in one task.

    Rows fall into ranges of ``width`` of the first key; the counts of ranges are summed up first and the numbers within ranges added.
    """
    first, *_ = keys
    part = F.floor(F.col(first) / width)
    counts = df.groupBy(*by, part.alias("__part__")).agg(F.count(F.lit(1)).alias("__n__"))
    over = Window.partitionBy(*by).orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before__", F.coalesce(F.sum("__n__").over(over), F.lit(0))).drop("__n__")
    ranked = df.withColumn("__part__", part).join(before, [*by, "__part__"])
    within = F.row_number().over(Window.partitionBy(*by, "__part__").orderBy(*keys))
    return ranked.withColumn(out, (F.col("__before__") + within - 1).cast("long")).drop("__before__", "__part__")
