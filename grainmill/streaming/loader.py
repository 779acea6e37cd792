"""The loader (L1-L9): the streams of several workers merged in turn, then stages over the merged stream.

The merge is arithmetic on places, so it is planned like any other stage: the n-th row of worker w comes after the n-th rows of the workers
before it, and workers that are through are passed over. Only the counts of workers come to the driver.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators import balance as balancing
from grainmill.operators import stages
from grainmill.operators.order import POS, ROUND, SLOT
from grainmill.plans import codecs, identity
from grainmill.plans.dataset import Dataset, UnsupportedResumeError


def merged(df: DataFrame, workers: int) -> DataFrame:
    """One stream (slot 0) of the streams of slots 0..workers - 1: first rows of all, then second rows, and so on."""
    counts = {r[0]: r[1] for r in df.groupBy(SLOT).count().collect()}
    n = [counts.get(w, 0) for w in range(workers)]
    place = F.lit(0).cast("long")
    for w, c in enumerate(n):
        before = F.least(F.col(POS), F.lit(c)) + F.when((F.col(SLOT) > w) & (F.col(POS) < c), 1).otherwise(0)
        place = place + before
    return df.withColumn(POS, place.cast("long")).withColumn(SLOT, F.lit(0).cast("int"))


@dataclass(frozen=True)
class Balance:
    """The arguments of a stage that balances ranks."""

    drop_last: bool
    dummy_factory: Callable[[], dict] | None
    buffer_size: int
    chunk_size: int
    max_transfer_per_round: int
    topology: str


@dataclass(frozen=True)
class Loader:
    """Reads a dataset with ``num_workers`` slots of this rank. Arguments are those of a multi-process loader; the ones that tune processes are accepted and have no effect."""

    dataset: Dataset
    num_workers: int = 0
    batch_size: int | None = None
    drop_last: bool = False
    collate_fn: Callable | None = None
    schema: str | T.StructType | None = None
    pin_memory: bool = False
    persistent_workers: bool = False
    prefetch_factor: int | None = None
    multiprocessing_context: object = None
    stages: tuple = ()
    pending: dict | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.dataset, Dataset):
            raise TypeError(f"a Dataset is needed, got {type(self.dataset).__name__}")
        if isinstance(self.num_workers, bool) or not isinstance(self.num_workers, int) or self.num_workers < 0:
            raise ValueError(f"num_workers must be a whole number from 0, got {self.num_workers!r}")
        if self.batch_size is not None and (isinstance(self.batch_size, bool) or not isinstance(self.batch_size, int) or self.batch_size <= 0):
            raise ValueError(f"batch_size must be a positive whole number, got {self.batch_size!r}")
        if self.num_workers == 0 and (self.prefetch_factor is not None or self.persistent_workers):
            raise ValueError("prefetch_factor and persistent_workers need num_workers > 0")
        if self.prefetch_factor is not None and self.prefetch_factor <= 0:
            raise ValueError(f"prefetch_factor must be > 0, got {self.prefetch_factor}")
        if self.batch_size is None and (self.drop_last or self.collate_fn is not None):
            raise ValueError("drop_last and collate_fn need batch_size")

    def _then(self, apply: Callable[[DataFrame], DataFrame]) -> Loader:
        return replace(self, stages=(*self.stages, apply), pending=None)

    def map(self, fn: Callable[[dict], dict] | dict[str, Column | str], schema: str | T.StructType | None = None) -> Loader:
        if isinstance(fn, dict):
            return self._then(lambda df: stages.map_columns(df, fn))
        if schema is None:
            raise ValueError("map of a function needs the schema of its results")
        return self._then(lambda df: stages.map_rows(df, fn, schema))

    def shuffle(self, buffer_size: int, initial: int | None = None, seed: int | None = None) -> Loader:
        stages.check_shuffle(buffer_size, initial)
        own = self.dataset.context.sample_shuffle_seed if seed is None else seed
        return self._then(lambda df: stages.shuffle(df, buffer_size, initial, own, per_slot=False))

    def batch(self, size: int, drop_last: bool = False, collate_fn: Callable | None = None, schema: str | T.StructType | None = None) -> Loader:
        how = {"fn": collate_fn, "schema": schema} if schema is not None else {"collate": collate_fn}
        return self._then(lambda df: stages.batch(df, size, drop_last, **how))

    def unbatch(self, columns: Sequence[str] | None = None) -> Loader:
        return self._then(lambda df: stages.unbatch(df, columns))

    def assemble(self, factory: Callable[[], object], schema: str | T.StructType, drop_last: bool = False) -> Loader:
        return self._then(lambda df: stages.assemble(df, factory, schema, drop_last))

    def balance(
        self, *, drop_last: bool = True, dummy_factory: Callable[[], dict] | None = None, buffer_size: int = 32, chunk_size: int = 16, max_transfer_per_round: int = 16, topology: str = "node"
    ) -> Loader:
        """From here on every rank has as many rows: those of all ranks are planned together, and this one keeps what goes to it. Stages may follow."""
        balancing.check(drop_last, dummy_factory, buffer_size, chunk_size, max_transfer_per_round, topology)
        made = Balance(drop_last, dummy_factory, buffer_size, chunk_size, max_transfer_per_round, topology)
        return self._then(made)

    def _balanced(self, upto: int, how: Balance) -> DataFrame:
        c = self.dataset.context
        if c.mesh is not None:
            raise ValueError("balance needs ranks, not a mesh")
        ranks = range(c.world_size)
        streams = None
        for r in ranks:
            one = replace(self, dataset=self.dataset.at(replace(c, rank=r)), stages=self.stages[:upto], pending=None)
            f = one.frame().withColumn(SLOT, F.lit(r).cast("int"))
            streams = f if streams is None else streams.unionByName(f)
        nodes = {r: r // max(1, c.local_world_size) for r in ranks}
        out = balance(streams, ranks=c.world_size, nodes=nodes, **{f.name: getattr(how, f.name) for f in fields(how)})
        return out.where(F.col(SLOT) == c.rank).withColumn(SLOT, F.lit(0).cast("int"))

    def frame(self, rounds: int = 1) -> DataFrame:
        """The merged stream of this rank after all stages, with its places."""
        d = self.dataset
        last = max((i + 1 for i, s in enumerate(self.stages) if isinstance(s, Balance)), default=0)
        if last:
            f = self._balanced(last - 1, self.stages[last - 1])
            for s in self.stages[last:]:
                f = s(f)
            return f
        workers = max(1, self.num_workers)
        c = replace(d.context, worker_id=0, num_workers=workers)
        f = d.at(c).frame(rounds)
        first = c.slot
        f = f.where((F.col(SLOT) >= first) & (F.col(SLOT) < first + workers)).withColumn(SLOT, F.col(SLOT) - first)
        if self.batch_size is not None:
            how = {"fn": self.collate_fn, "schema": self.schema} if self.schema is not None else {"collate": self.collate_fn}
            f = stages.batch(f, self.batch_size, self.drop_last, **how)
        f = merged(f, workers)
        for s in self.stages:
            f = s(f)
        return f

    def __iter__(self) -> LoaderIterator:
        made = LoaderIterator(self, self.pending)
        object.__setattr__(self, "pending", None)
        object.__setattr__(self, "_last", weakref.ref(made))
        return made

    def _resumable(self) -> None:
        if any(isinstance(s, Balance) for s in self.stages):
            raise UnsupportedResumeError("[UnsupportedResume] balance can't be resumed")

    def identity(self) -> dict:
        """The dataset's, with all that the loader's results depend on."""
        own = {f.name: identity.identity(getattr(self, f.name)) for f in fields(self) if f.name not in ("dataset", "pending")}
        return self.dataset.identity() | {"loader": own}

    def state_dict(self) -> dict:
        """The state of the iteration that is under way; None in it if there is none. A balanced loader has none: what a rank has depends on all others."""
        self._resumable()
        it = getattr(self, "_last", lambda: None)()
        return identity.envelope(self.identity(), None) if it is None or it.ended else it.state_dict()

    def load_state_dict(self, state: dict) -> Loader:
        """The next iteration goes on where the state was taken. Returns the loader."""
        self._resumable()
        object.__setattr__(self, "pending", identity.opened(self.identity(), state))
        return self


class LoaderIterator:
    """One run over a loader's stream."""

    def __init__(self, loader: Loader, state: dict | None) -> None:
        self.loader, self.yielded, self.ended = loader, (state or {}).get("yielded", 0), False
        self._it = self._items()

    def _items(self) -> Iterator[dict]:
        f = self.loader.frame()
        rows = f.where(F.col(POS) >= self.yielded).orderBy(POS).select(*stages.data_columns(f))
        for r in rows.toLocalIterator(prefetchPartitions=True):
            yield codecs.decode(r.asDict(recursive=True))

    def __iter__(self) -> LoaderIterator:
        return self

    def __next__(self) -> dict:
        try:
            row = next(self._it)
        except StopIteration:
            self.ended = True
            raise
        self.yielded += 1
        return row

    def live_state(self) -> dict:
        return {"yielded": self.yielded}

    def state_dict(self) -> dict:
        """Where this run is; None in it if it hasn't begun or is over."""
        self.loader._resumable()
        return identity.envelope(self.loader.identity(), None if self.ended or not self.yielded else self.live_state())


def all_ranks(loaders: Sequence[Loader]) -> DataFrame:
    """The streams of the loaders of all ranks in one frame; the slot is the rank."""
    out = None
    for rank, one in enumerate(loaders):
        f = one.frame().withColumn(SLOT, F.lit(rank).cast("int"))
        out = f if out is None else out.unionByName(f)
    return out


def balance(
    streams: DataFrame, *, ranks: int, nodes: dict[int, int] | None = None, drop_last: bool = True, dummy_factory: Callable[[], dict] | None = None, buffer_size: int = 32, chunk_size: int = 16, max_transfer_per_round: int = 16, topology: str = "node"
) -> DataFrame:
    """Equally many outputs for every rank: spare rows move to ranks that lack some, what is left is dropped or filled up with ``dummy_factory()``.

    ``streams``: the slot is the rank, places are dense. The result's slot is the rank that a row goes to, with a new place there; dummies come last.
    """
    balancing.check(drop_last, dummy_factory, buffer_size, chunk_size, max_transfer_per_round, topology)
    if ranks <= 1:
        return streams
    moved, dummies = balancing.balance(streams, SLOT, POS, nodes, range(ranks), chunk_size=chunk_size, max_transfer=max_transfer_per_round, drop_last=drop_last, topology=topology)
    out = moved.withColumn(SLOT, F.col("__rank__")).withColumn(POS, F.col("__place__")).select(*streams.columns)
    if drop_last or not any(dummies.values()):
        return out
    rows, had = [], {r[0]: r[1] for r in out.groupBy(SLOT).count().collect()}
    for r, n in dummies.items():
        for i in range(n):
            made = dummy_factory() | {SLOT: r, ROUND: 0, POS: had.get(r, 0) + i}
            rows.append(tuple(made.get(c) for c in streams.columns))
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in streams.schema.fields])
    return out.unionByName(streams.sparkSession.createDataFrame(rows, loose))


def state_dict(*_: object) -> dict:
    """A balanced stream can't be resumed: what a rank has depends on all others."""
    raise UnsupportedResumeError("[UnsupportedResume] balance can't be resumed")
