"""Equal numbers of outputs on every rank (L9, L10): a deterministic plan on counts; Spark's shuffle moves the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.session import small


#: Runs that each task may hold (32 bytes each).
RUNS = 2_000_000


@dataclass(frozen=True)
class RankStatus:
    rank: int
    node_rank: int = 0
    local_rank: int = 0
    available: int = 0
    upstream_done: bool = True


@dataclass(frozen=True)
class Transfer:
    src: int
    dst: int
    count: int


@dataclass
class Plan:
    local_take: dict[int, int]
    dummies: dict[int, int]
    transfers: list[Transfer] = field(default_factory=list)
    finished: bool = False


def check(drop_last: bool, dummy: object, buffer_size: int, chunk_size: int, max_transfer: int, topology: str) -> None:
    if not drop_last and dummy is None:
        raise ValueError("drop_last=False needs a dummy_factory")
    for name, v in (("buffer_size", buffer_size), ("chunk_size", chunk_size), ("max_transfer_per_round", max_transfer)):
        if v <= 0:
            raise ValueError(f"{name} must be > 0, got {v}")
    if buffer_size < chunk_size:
        raise ValueError("buffer_size must be at least chunk_size")
    if topology not in ("node", "none"):
        raise ValueError(f"topology must be node or none, got {topology!r}")


def plan(statuses: Sequence[RankStatus], *, chunk_size: int, max_transfer: int, drop_last: bool, topology: str = "node") -> Plan:
    """Up to ``chunk_size`` steps; in each every rank gets one item, its own if it has any, else from a donor."""
    ranks = {s.rank: s for s in sorted(statuses, key=lambda s: s.rank)}
    left = {r: s.available for r, s in ranks.items()}
    sent = dict.fromkeys(ranks, 0)
    out = Plan(dict.fromkeys(ranks, 0), dict.fromkeys(ranks, 0))
    done = all(s.upstream_done for s in statuses)

    def donor(to: int) -> int | None:
        can = [r for r in ranks if r != to and left[r] > 0 and sent[r] < max_transfer]
        far = lambda r: topology == "node" and ranks[r].node_rank != ranks[to].node_rank
        return min(can, key=lambda r: (far(r), -left[r], r), default=None)

    for _ in range(chunk_size):
        total = sum(left.values())
        if total == 0 or (drop_last and total < len(ranks)):
            out.finished = done
            break
        own = [r for r in ranks if left[r] > 0]
        poor = [r for r in ranks if left[r] <= 0]
        if total < len(ranks):
            for r in own:
                left[r] -= 1
                out.local_take[r] += 1
            for r in poor:
                out.dummies[r] += 1
            if not any(left.values()):
                out.finished = done
                break
            continue
        before = dict(left), dict(sent)
        for r in own:
            left[r] -= 1
        moves = []
        for r in poor:
            d = donor(r)
            if d is None:
                break
            left[d] -= 1
            sent[d] += 1
            moves.append((d, r))
        if len(moves) < len(poor):  # this step can't be made whole
            left, sent = before
            if not (any(out.local_take.values()) or any(out.dummies.values()) or out.transfers):
                raise ValueError("max_transfer_per_round is too small for a single balanced step")
            return out
        for r in own:
            out.local_take[r] += 1
        for d, r in moves:
            if out.transfers and (out.transfers[-1].src, out.transfers[-1].dst) == (d, r):
                out.transfers[-1] = Transfer(d, r, out.transfers[-1].count + 1)
            else:
                out.transfers.append(Transfer(d, r, 1))
    return out


def schedule(counts: dict[int, int], nodes: dict[int, int] | None = None, *, chunk_size: int = 16, max_transfer: int = 16, drop_last: bool = True, topology: str = "node") -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """Plans for whole streams: ``(rank, first, rows, to)`` runs of each rank's stream and where they go, and dummies per rank."""
    nodes = nodes or {}
    left, at = dict(counts), dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int]] = []
    dummies = dict.fromkeys(counts, 0)
    while any(left.values()):
        # as long as all ranks have plenty, whole chunks are their own
        whole = min(left.values()) // chunk_size
        if whole:
            n = whole * chunk_size
            for r in sorted(left):
                runs.append((r, at[r], n, r))
                at[r] += n
                left[r] -= n
            continue
        p = plan([RankStatus(r, nodes.get(r, 0), r, n) for r, n in left.items()], chunk_size=chunk_size, max_transfer=max_transfer, drop_last=drop_last, topology=topology)
        for r, n in p.local_take.items():
            if n:
                runs.append((r, at[r], n, r))
                at[r] += n
                left[r] -= n
        for t in p.transfers:
            runs.append((t.src, at[t.src], t.count, t.dst))
            at[t.src] += t.count
            left[t.src] -= t.count
        for r, n in p.dummies.items():
            dummies[r] += n
        if not (any(p.local_take.values()) or p.transfers or any(p.dummies.values())):
            break
    return runs, dummies


def balance(df: DataFrame, rank: str, pos: str, nodes: dict[int, int] | None = None, ranks: Sequence[int] | None = None, **params) -> tuple[DataFrame, dict[int, int]]:
    """Rows with ``__rank__``, the rank that they go to, and ``__place__``, their place there; rows left over are dropped. Also the dummies that each rank has to add.

    Only counts per rank come to the driver. The runs of a rank lie end to end, so each row finds its own by bisection; if there are very many, they are a table that is joined.
    """
    counts = {r[0]: r[1] for r in df.groupBy(rank).count().collect()}
    counts = {r: counts.get(r, 0) for r in (ranks if ranks is not None else sorted(counts))}
    runs, dummies = schedule(counts, nodes, **params)
    given = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    for r, a, n, to in runs:
        rows.append((r, a, a + n, to, given[to]))
        given[to] += n
    if len(rows) > RUNS:
        table = df.sparkSession.createDataFrame(rows, "__from__ int, __lo__ long, __hi__ long, __rank__ int, __first__ long")
        on = (F.col(rank) == F.col("__from__")) & (F.col(pos) >= F.col("__lo__")) & (F.col(pos) < F.col("__hi__"))
        joined = df.join(small(table), on).withColumn("__place__", F.col("__first__") + F.col(pos) - F.col("__lo__"))
        return joined.drop("__from__", "__lo__", "__hi__", "__first__"), dummies
    of = {r: np.array([x[1:] for x in rows if x[0] == r], np.int64).reshape(-1, 4) for r in counts}

    @F.pandas_udf("__rank__ int, __place__ long")
    def goes(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for s, p in it:
            s, p = s.to_numpy(), p.to_numpy()
            to, at = np.full(len(s), -1, np.int64), np.zeros(len(s), np.int64)
            for r in np.unique(s):
                mine = of.get(int(r))
                k = np.flatnonzero(s == r)
                if mine is None or not len(mine):
                    continue
                i = np.searchsorted(mine[:, 0], p[k], "right") - 1
                ok = (i >= 0) & (p[k] < mine[i, 1])
                to[k[ok]], at[k[ok]] = mine[i[ok], 2], mine[i[ok], 3] + p[k[ok]] - mine[i[ok], 0]
            yield pd.DataFrame({"__rank__": to.astype(np.int32), "__place__": at})

    moved = df.withColumn("__goes__", goes(F.col(rank), F.col(pos))).select(*df.columns, "__goes__.__rank__", "__goes__.__place__")
    return moved.where(F.col("__rank__") >= 0), dummies
