"""The pipeline: one source, selections on it, and a chain of stages, all immutable; compiled to a DataFrame."""

from __future__ import annotations

import os
import warnings
import weakref
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from grainmill.operators import mixing, order, refs, stages, subset
from grainmill.operators.order import POS, ROUND, SLOT, ChunkShuffle, Selection
from grainmill.plans import cache, codecs, identity
from grainmill.plans.context import RuntimeContext
from grainmill.session import attach
from grainmill.sources import files, paths, table

FingerprintProvider = Callable[[], str]


class Consumer(Protocol):
    """A fold over a stream: ``push`` returns exactly False to stop it."""

    def push(self, item: dict) -> object: ...

    def finish(self) -> object: ...


_ACTIVE: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
UNITS = ("tar", "jsonl", "parquet")
TABLES = ("table", "lance", "snapshot")
MODES = {"tar": ("shard_aware", "none"), "jsonl": ("shard_aware", "none"), "parquet": ("chunk_aware", "none"), "table": ("none", "global", "chunk"), "lance": ("none", "global", "chunk")}


@dataclass(frozen=True)
class Stage:
    kind: str
    apply: Callable[[DataFrame, RuntimeContext, bool], DataFrame]  # the last: whether the stream ends after these rounds
    says: object = None


def _placer(strategy: str, counts: dict[int, tuple], weights: tuple, source: int):
    """A UDF from (slot, n) to the place in the merged stream of the n-th row of a source."""

    @F.pandas_udf("long")
    def place(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for slot, pos in it:
            s, p = slot.to_numpy(), pos.to_numpy()
            got = np.empty(len(s), np.int64)
            for x in np.unique(s):
                k = s == x
                got[k] = mixing.places(strategy, counts[int(x)], weights, source, p[k], 0)
            yield pd.Series(got)

    return place


def _scheduled(spark: SparkSession, counts: dict[int, tuple], weights: tuple | None, seed: int) -> DataFrame:
    """``__slot__, __from__, __pos__, __to__``: places of the rows of each source in a random merge; a generator for each slot, run in executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slot in b.column(0).to_pylist():
                for source, nth, at in mixing.schedule(counts[slot], weights, seed + slot):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), slot, np.int32)), pa.array(source.astype(np.int32)), pa.array(nth), pa.array(at)], [SLOT, "__from__", POS, "__to__"])

    slots = spark.createDataFrame([(s,) for s in counts], "slot int").repartition(max(1, len(counts)))
    return slots.mapInArrow(run, f"{SLOT} int, __from__ int, {POS} long, __to__ long")


@dataclass(frozen=True, eq=False)
class Dataset:
    spark: SparkSession
    context: RuntimeContext
    kind: str
    source: object
    options: dict = field(default_factory=dict)
    stages: tuple[Stage, ...] = ()
    resample: bool = False
    filters: tuple[str, ...] = ()
    selection: Selection | None = None
    subset: tuple | None = None  # of a snapshot, taken once its rows are known
    pending: dict | None = None

    # -- construction ------------------------------------------------------------------------------------------------

    @classmethod
    def from_source(cls, kind: str, shards: object = None, context: RuntimeContext | None = None, resample: bool = False, *, spark: SparkSession | None = None, **options) -> Dataset:
        """tar, jsonl, parquet, table (a versioned table; also called lance) or mixed. Metadata are read at once, rows are not."""
        spark = attach(spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
        context = context or RuntimeContext.from_runtime()
        if kind == "mixed":
            return cls._mixed(spark, shards, context, resample, **options)
        if kind not in (*UNITS, "table", "lance"):
            raise ValueError(f"[UnsupportedSourceKind] {kind!r}")
        known = {"tar": {"sidecars", "fields", "key_dot_level"}, "jsonl": {"ref_fields", "schema"}, "parquet": {"min_row_groups_per_chunk", "columns", "use_threads"}}
        extra = known.get(kind, {"columns", "read_batch_size", "chunk_shuffle", "ref_columns", "versions"}) | {"shuffle_mode"}
        if bad := set(options) - extra:
            raise TypeError(f"{kind} has no option {sorted(bad)[0]!r}")
        mode = options.setdefault("shuffle_mode", {"parquet": "chunk_aware", "table": "none", "lance": "none"}.get(kind, "shard_aware"))
        name = "Lance" if kind in TABLES else kind.capitalize()
        if mode not in MODES[kind]:
            raise ValueError(f"[{'Unsupported' if mode in ('global', 'chunk') else 'Invalid'}{name}ShuffleMode] {mode!r}; {kind} has {', '.join(MODES[kind])}")
        if kind in ("table", "lance"):
            return cls._table(spark, kind, shards, context, resample, options)
        at = paths.resolve(shards)
        n = context.total_slots
        if kind == "tar":
            units = files.tar_units(at, n, options.get("sidecars"))
        elif kind == "jsonl":
            units = files.jsonl_units(at, n)
            for _, base in options.get("ref_fields") or ():
                if not isinstance(base, str):
                    raise ValueError("[InvalidRefField] ref_fields are pairs of a field and a folder")
        else:
            if bad := [p for p in at if not (p.endswith(".parquet") or files.files_of(p) != [p])]:
                raise ValueError(f"[InvalidSourceType] not .parquet: {bad[0]}")
            units = files.parquet_units([f for p in at for f in files.files_of(p)], options.get("min_row_groups_per_chunk", 1), n)
        if len(units) < n:
            raise ValueError(f"[InsufficientItemsForSlot] {len(units)} units of {kind} for {n} slots")
        return cls(spark, context, kind, tuple(units), options, (), resample)

    @classmethod
    def _table(cls, spark, kind, shards, context, resample, options) -> Dataset:
        batch = options.get("read_batch_size", 1024)
        if isinstance(batch, bool) or not isinstance(batch, int) or batch < 1:
            raise ValueError(f"[InvalidLanceReadBatchSize] must be a whole number from 1, got {batch!r}")
        if options.get("chunk_shuffle") is not None and options["shuffle_mode"] != "chunk":
            raise ValueError("[InvalidLanceChunkShuffle] chunk_shuffle is for shuffle_mode='chunk'")
        options["chunk_shuffle"] = ChunkShuffle.of(options.get("chunk_shuffle"))
        given = paths.resolve(shards)
        ref = options.get("ref_columns")
        if len(given) == 1 and given[0].endswith(".json"):
            given, own = table.config(given[0])
            ref = own if ref is None else ref
        if ref is not None and not isinstance(ref, dict):
            raise ValueError("[InvalidLanceRefColumns] ref_columns must be a mapping")
        options["ref_columns"] = {k: refs.Ref.of(k, v) for k, v in (ref or {}).items()}
        return cls(spark, context, kind, table.discover(given), options, (), resample)

    @classmethod
    def _mixed(cls, spark, sources, context, resample, strategy="weighted_round_robin", weights=None) -> Dataset:
        if strategy not in mixing.STRATEGIES:
            raise ValueError(f"[UnsupportedMixedStrategy] {strategy!r} is none of {', '.join(mixing.STRATEGIES)}")
        pairs = list(sources.items()) if isinstance(sources, dict) else list(sources or ())
        if not pairs:
            raise ValueError("[EmptyMixedSource] no sources given")
        names = [n for n, _ in pairs]
        if any(not isinstance(n, str) or not n for n in names):
            raise ValueError("[InvalidMixedSourceName] names must be non-empty strings")
        if len(set(names)) != len(names):
            raise ValueError("[DuplicateMixedSourceName] a name is given twice")
        if bad := [n for n, d in pairs if not isinstance(d, Dataset)]:
            raise ValueError(f"[InvalidMixedSourceDataset] {bad[0]} is no Dataset")
        weights = weights or {}
        w = {n: weights.get(n, 1) for n in names}
        if set(weights) - set(names) or any(isinstance(v, bool) or not isinstance(v, int) or v < 1 for v in w.values()):
            raise ValueError(f"[InvalidMixedSourceWeight] weights must be positive whole numbers of known sources, got {weights}")
        if any(d.context.identity() != context.identity() for _, d in pairs):
            raise ValueError("[MixedSourceContextMismatch] all sources must have the context of the mix")
        return cls(spark, context, "mixed", tuple(pairs), {"strategy": strategy, "weights": tuple(w.values())}, (), resample or any(d.resample for _, d in pairs))

    def at(self, context: RuntimeContext) -> Dataset:
        """The same pipeline read by another rank or number of workers."""
        if self.kind in UNITS and len(self.source) < context.total_slots:
            raise ValueError(f"[InsufficientItemsForSlot] {len(self.source)} units of {self.kind} for {context.total_slots} slots")
        source = tuple((n, d.at(context)) for n, d in self.source) if self.kind == "mixed" else self.source
        return replace(self, context=context, source=source, pending=None)

    # -- selections on the source ------------------------------------------------------------------------------------

    @property
    def _tabular(self) -> bool:
        return self.kind in TABLES

    def filter(self, where: str | Sequence[str], index: object = None) -> Dataset:
        """Keep rows that fulfil a SQL predicate, or any of several; repeated calls narrow further. Before any stage, split or sample."""
        if index is not None:
            raise ValueError("[InvalidLanceFilterIndexConfig] predicates are pushed into the scan; there is no index to set up")
        if self.kind == "mixed" or self.kind == "snapshot":
            raise ValueError(f"[UnsupportedFilter] not on {self.kind}")
        if self.stages or self.selection or self.options.get("cut"):
            raise ValueError("[InvalidFilterPlacement] filter comes before stages, split and sample")
        many = [where] if isinstance(where, str) else list(where)
        if not many or any(not isinstance(w, str) or not w.strip() for w in many):
            raise ValueError(f"[InvalidLanceFilter] need one or more predicates, got {where!r}")
        made = replace(self, filters=(*self.filters, " OR ".join(f"({w})" for w in many)), pending=None)
        try:
            made._scan().schema  # noqa: B018 - a bad column is an error at once
        except AnalysisException as e:
            raise ValueError(f"[InvalidLanceFilter] {e}") from e
        return made

    def _unit_rows(self) -> list[int]:
        if self.kind != "parquet":
            return [1] * len(self.source)
        return [u.rows for u in self.source]

    def _total(self) -> int:
        """Rows of a table after its filters."""
        return self._scan().count() if self.filters else self.source.rows

    def split(self, fractions: Sequence[float]) -> tuple[Dataset, ...]:
        """Disjoint parts that cover all: whole units of files, exact ranges of a table's order."""
        self._can_subset()
        if self.kind == "snapshot":
            n = len(subset.shares(fractions))
            return tuple(replace(self, subset=("split", tuple(fractions), i), pending=None) for i in range(n))
        if not self._tabular:
            return tuple(self._with_units(u) for u in subset.split_units(self._unit_rows(), fractions))
        total = self._total()
        c = subset.cuts(total, fractions)
        return tuple(replace(self, selection=Selection(a, b - a, total), pending=None) for a, b in zip(c, c[1:]))

    def sample(self, fraction: float, seed: int = 0) -> Dataset:
        """A part whose members don't change from round to round: units until their weight is reached, or an exact number of rows."""
        self._can_subset()
        f = subset.check_fraction(fraction)
        if self.kind == "snapshot":
            return replace(self, subset=("sample", f, seed), pending=None)
        if not self._tabular:
            return self._with_units(subset.sample_units(self._unit_rows(), f, seed))
        total = self._total()
        return replace(self, selection=Selection(0, round(f * total), total, seed), pending=None)

    def _can_subset(self) -> None:
        if self.kind == "mixed":
            raise ValueError("[UnsupportedSubsetSource] split and sample the sources of a mix")
        if self.selection is not None or self.subset is not None:
            raise ValueError(f"[UnsupportedNested{'Snapshot' if self.kind == 'snapshot' else 'Lance'}Subset] a part can't be divided again")
        if self.stages:
            raise ValueError("[UnsupportedSubsetSource] split and sample come before stages")

    def _with_units(self, keep: list[int]) -> Dataset:
        subset.enough(keep, self.context.total_slots, self.kind)
        return replace(self, source=tuple(self.source[i] for i in keep), options=self.options | {"cut": True}, pending=None)

    # -- stages ------------------------------------------------------------------------------------------------------

    def _then(self, kind: str, apply: Callable[[DataFrame, RuntimeContext, bool], DataFrame], *says: object) -> Dataset:
        return replace(self, stages=(*self.stages, Stage(kind, apply, says)), pending=None)

    def map(self, fn: Callable[[dict], dict] | dict[str, Column | str], schema: str | T.StructType | None = None) -> Dataset:
        """Column expressions by name (stay in the JVM), or a Python function from row to row with the schema of its results."""
        if isinstance(fn, dict):
            return self._then("map", lambda df, *_: stages.map_columns(df, fn), {k: str(v) for k, v in fn.items()})
        if schema is None:
            raise ValueError("map of a function needs the schema of its results")
        return self._then("map", lambda df, *_: stages.map_rows(df, fn, schema), fn, str(schema))

    def select(self, names: Sequence[str]) -> Dataset:
        names = [names] if isinstance(names, str) else list(names)
        return self._then("select", lambda df, *_: stages.select(df, names), names)

    def shuffle(self, buffer_size: int, initial: int | None = None) -> Dataset:
        stages.check_shuffle(buffer_size, initial)
        return self._then("shuffle", lambda df, c, ends: stages.shuffle(df, buffer_size, initial, c.seed, ends=ends), buffer_size, initial)

    def batch(self, size: int, drop_last: bool = False, collate_fn: Callable | None = None, schema: str | T.StructType | None = None) -> Dataset:
        """Lists of consecutive rows. ``collate_fn``: from the list to a row (with ``schema``), or (without) from the array column to columns by name."""
        if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
            raise ValueError(f"batch size must be a positive whole number, got {size!r}")
        how = {"fn": collate_fn, "schema": schema} if schema is not None else {"collate": collate_fn}
        return self._then("batch", lambda df, _, ends: stages.batch(df, size, drop_last or not ends, **how), size, drop_last, collate_fn, str(schema))

    def unbatch(self, columns: Sequence[str] | None = None) -> Dataset:
        return self._then("unbatch", lambda df, *_: stages.unbatch(df, columns), columns)

    def assemble(self, factory: Callable[[], object], schema: str | T.StructType, drop_last: bool = False) -> Dataset:
        return self._then("assemble", lambda df, _, ends: stages.assemble(df, factory, schema, drop_last, ends), factory, str(schema), drop_last)

    def resolve_ref(self, names: str | Sequence[str], resolve_batch_size: int = 1024, hint: str | None = None) -> Dataset:
        """Replace key columns by what the tables of ``ref_columns`` hold for them."""
        names = [names] if isinstance(names, str) else list(names or ())
        if isinstance(resolve_batch_size, bool) or not isinstance(resolve_batch_size, int) or resolve_batch_size < 1:
            raise ValueError(f"[InvalidLanceRefResolveBatchSize] {resolve_batch_size!r}")
        if not names or len(set(names)) != len(names) or not all(isinstance(n, str) and n for n in names):
            raise ValueError(f"[InvalidLanceRefNames] {names!r}")
        known = self.options.get("ref_columns") or {}
        if bad := [n for n in names if n not in known]:
            raise ValueError(f"[UnknownLanceRefColumn] {bad[0]!r}")

        def apply(df: DataFrame, *_: object) -> DataFrame:
            for n in names:
                df = refs.resolve(df, n, refs.ref_table(self.spark, known[n]), known[n].key, known[n].value, [SLOT, POS], hint)
            return df

        return self._then("resolve_ref", apply, names, [[r.uris, r.key, r.value] for r in (known[n] for n in names)])

    # -- compilation -------------------------------------------------------------------------------------------------

    def _scan(self, within: range | None = None) -> DataFrame:
        o = self.options
        if self.kind == "tar":
            df = files.scan_tar(self.spark, self.source, o.get("fields"), o.get("key_dot_level"))
        elif self.kind == "jsonl":
            df = files.scan_jsonl(self.spark, self.source, o.get("schema"))
            for name, base in o.get("ref_fields") or ():
                if name in df.columns:
                    df = refs.tar_members(df, name, base, [files.UNIT, files.ROW])
        elif self.kind == "parquet":
            df = files.scan_parquet(self.spark, self.source, o.get("columns"))
        else:
            df = table.scan(self.spark, self.source, None if self.filters else o.get("columns"), within=within)
        for w in self.filters:
            df = df.where(F.expr(w))
        if self.filters and self._tabular and o.get("columns") is not None:
            df = df.select(*[c for c in df.columns if c in o["columns"] or stages.is_meta(c)])
        return df

    def _dealt(self, rounds: int | range, slot: int | None = None, start: int = 0) -> DataFrame:
        """The source's rows with their places; with ``slot``, for that one and from place ``start`` on at least, reading no more files than it has to."""
        c, o = self.context, self.options
        if self.kind == "mixed":
            return self._merged(rounds)
        if not self._tabular:
            return self._dealt_units(range(rounds) if isinstance(rounds, int) else rounds, slot, start)
        total, at, within = self.source.rows, "__global_index__", None
        sel = self.selection or Selection(0, total, total)
        mode = o.get("shuffle_mode", "none")
        if not self.filters and mode == "none" and sel.seed is None:
            first = sel.start
            if slot is not None and isinstance(rounds, range) and len(rounds) == 1:
                first += max(0, start - rounds.start * order.round_size(sel.count, slot, c.total_slots)) * c.total_slots
            within = range(first, sel.start + sel.count)
        df = self._scan(within)
        if self.filters:
            total, at = (self.selection.total if self.selection else df.count()), "__nth__"
            df = order.dense(df, [], ["__global_index__"], at)
            sel = self.selection or Selection(0, total, total)
        df = order.deal_rows(df, at, total, sel, mode, c.seed, o.get("chunk_shuffle") or ChunkShuffle(), c.total_slots, rounds)
        return df.drop("__nth__")

    def _dealt_units(self, rounds: range, slot: int | None, start: int) -> DataFrame:
        c, o = self.context, self.options
        every = range(len(self.source))

        def deal(rows: dict[int, int]) -> list[tuple[int, int, int, int]]:
            return [x for x in order.deal_units(list(every), rows, c.total_slots, c.seed, o["shuffle_mode"] != "none", rounds.stop) if slot is None or x[2] == slot]

        def scan(units: list[int]) -> DataFrame:
            df = replace(self, source=tuple(self.source[u] for u in units))._scan()
            return order.dense(df, [files.UNIT], [files.ROW], "__nth__").drop(files.ROW).withColumnRenamed("__nth__", files.ROW) if self.filters else df

        need = sorted({u for u, *_ in deal(dict.fromkeys(every, 0))})
        df = scan(need)
        if self.filters:
            got = {r[0]: r[1] for r in df.groupBy(files.UNIT).count().collect()}
        else:
            got = files.counted(self.spark, self.kind, [self.source[u] for u in need], o.get("key_dot_level"))
        rows = {u: 0 for u in every} | {u: got.get(i, 0) for i, u in enumerate(need)}
        layout = [x for x in deal(rows) if x[1] in rounds and x[3] + rows[x[0]] > start]
        used = sorted({u for u, *_ in layout}) or need[:1]
        if used != need:
            df = scan(used)
        place = {u: i for i, u in enumerate(used)}
        return order.join_units(self.spark, df, files.UNIT, files.ROW, [(place[u], *rest) for u, *rest in layout]).drop(files.UNIT, files.ROW)

    def _merged(self, rounds: int) -> DataFrame:
        o, seed = self.options, self.context.seed
        frames = [d.frame(rounds) for _, d in self.source]
        counts: dict[int, list[int]] = {}
        for i, f in enumerate(frames):
            for slot, n in f.groupBy(SLOT).count().collect():
                counts.setdefault(slot, [0] * len(frames))[i] = n
        known = {s: tuple(v) for s, v in counts.items()}
        drawn = _scheduled(self.spark, known, o["weights"] if o["strategy"] == "weighted_random" else None, seed) if "random" in o["strategy"] else None
        out = None
        for i, ((name, _), f) in enumerate(zip(self.source, frames)):

            if drawn is not None:
                columns = f.columns
                f = f.join(drawn.where(F.col("__from__") == i).drop("__from__"), [SLOT, POS]).withColumn(POS, F.col("__to__")).select(*columns)
            else:
                place = _placer(o["strategy"], known, o["weights"], i)
                f = f.withColumn(POS, place(F.col(SLOT), F.col(POS)))
            f = f.withColumn("__source__", F.lit(name))
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    def frame(self, rounds: int | range = 1, *, ends: bool = True, slot: int | None = None, start: int = 0) -> DataFrame:
        """All slots' streams: data, metadata and ``__slot__, __round__, __pos__``, places dense in each slot and running on over rounds.

        ``ends``: whether the stream ends after these rounds; if not, rows that a stage could only give out with those that follow are left out.
        ``slot``: only this one is needed, and its rows from place ``start`` on; files without any are not read. A range of rounds is for stages that go row by row.
        """
        if (rounds if isinstance(rounds, int) else len(rounds)) < 1:
            raise ValueError("rounds must be at least 1")
        if self.kind == "snapshot":
            return self._snapshot().frame(rounds, ends=ends, slot=slot, start=start)
        df = self._dealt(rounds, slot, start if self._row_by_row else 0)
        for s in self.stages:
            df = s.apply(df, self.context, ends)
        return df

    @property
    def _row_by_row(self) -> bool:
        """Whether every stage makes one row of one row, so that places stay as the source has them."""
        return self.kind != "mixed" and all(s.kind in ("map", "select", "resolve_ref") for s in self.stages)

    def dataframe(self, rounds: int = 1) -> DataFrame:
        """The data without the control columns, in no particular order."""
        f = self.frame(rounds)
        return f.select(*stages.data_columns(f))

    # -- snapshot ----------------------------------------------------------------------------------------------------

    def snapshot(self, fingerprint_provider: Callable[[], str] | None = None, config: cache.CacheConfig | None = None) -> Dataset:
        """Materialise what comes up to here, once, slot by slot; lazily, and found again by the identity of the pipeline."""
        if self.resample:
            raise ValueError("[InfiniteSnapshotSource] a repeated source has no end to materialise")
        if self.pending is not None:
            raise UnsupportedResumeError("[SnapshotResumeUnsupported] a pipeline with a state to resume can't be materialised")
        if fingerprint_provider is not None:
            if not callable(fingerprint_provider):
                raise ValueError("[InvalidFingerprintProvider] must be callable")
            said = fingerprint_provider()
            if not isinstance(said, str) or not said:
                raise ValueError("[InvalidSnapshotFingerprint] must be a non-empty string")
            made = {"kind": "snapshot", "provided": said, "slots": self.context.total_slots, "epoch": self.context.epoch}
        else:
            made = {"kind": "snapshot", "identity": self.identity(), "slots": self.context.total_slots, "epoch": self.context.epoch}
        return replace(self, kind="snapshot", source=(self, cache.SourceFingerprint(made), config), options={"shuffle_mode": "none", "chunk_shuffle": None}, stages=(), filters=(), selection=None, pending=None)

    def _snapshot(self) -> Dataset:
        upstream, print_, config = self.source

        def build(folder: Path) -> None:
            f = upstream.frame()
            names = set(f.columns)
            for old, new in (("__key__", "__source_key__"), ("__file__", "__source_file__")):
                if old in names:
                    if new in names:
                        raise ValueError(f"[SnapshotSourceMetadataConflict] both {old} and {new} are there")
                    f = f.withColumnRenamed(old, new)
            f = f.drop("__local_index__", "__global_index__", ROUND)
            if not stages.data_columns(f):
                f = f.withColumn("__empty__", F.lit(None).cast("boolean"))
            f.repartition(F.col(SLOT)).sortWithinPartitions(SLOT, POS).drop(POS).write.mode("overwrite").partitionBy(SLOT).parquet(f"file://{folder}/rows")
            if not list((folder / "rows").rglob("*.parquet")):
                f.drop(POS, SLOT).limit(0).coalesce(1).write.mode("overwrite").parquet(f"file://{folder}/rows")

        named = self.spark.conf.get("spark.checkpoint.dir", None)
        if config is None and named and "://" not in paths.local(named) and not os.environ.get("GRAINMILL_CACHE_DIR"):
            config = cache.CacheConfig(os.path.join(paths.local(named), "grainmill-cache"))  # the folder that all executors share
        e = cache.CacheManager(config).ensure(print_, "snapshot", 1, {"slots": upstream.context.total_slots}, build)
        slot_of = lambda p: int(p.parent.name.partition("=")[2] or 0)
        parts = sorted(e.path.rglob("*.parquet"), key=lambda p: (slot_of(p), p.name))
        rows = [sum(n) for n in files.footers([str(p) for p in parts])]
        src = table.TableSource((table.Table("snapshot", 1, tuple(table.Part(str(p), n) for p, n in zip(parts, rows))),))
        made = Dataset(self.spark, self.context, "table", src, {"shuffle_mode": "none", "chunk_shuffle": ChunkShuffle()}, self.stages, self.resample)
        if self.subset and self.subset[0] == "split":
            c = subset.cuts(src.rows, self.subset[1])
            i = self.subset[2]
            return replace(made, selection=Selection(c[i], c[i + 1] - c[i], src.rows))
        if self.subset:
            return replace(made, selection=Selection(0, round(self.subset[1] * src.rows), src.rows, self.subset[2]))
        return made

    # -- iteration, folds, resumption --------------------------------------------------------------------------------

    def identity(self) -> dict:
        src: object
        if self.kind == "mixed":
            src = [[n, d.identity()] for n, d in self.source]
        elif self.kind == "snapshot":
            src = self.source[1].value
        elif self._tabular:
            src = self.source.fingerprint()
        else:
            src = [[u.logical or paths.logical([u.path])[0], u.first, u.rows] for u in self.source]
        o = {k: (v if k != "sidecars" else [n for n, _ in v or ()]) for k, v in self.options.items()}
        return {
            "context": self.context.identity(), "kind": self.kind, "source": identity.identity(src), "options": identity.identity(o), "resample": self.resample,
            "filters": list(self.filters), "selection": identity.identity(self.selection), "subset": identity.identity(self.subset),
            "stages": [[s.kind, identity.identity(s.says)] for s in self.stages],
        }

    def state_dict(self) -> dict:
        """The state of the iteration that is under way; None in it if there is none."""
        it = _ACTIVE.get(self)
        it = it() if it is not None else None
        return identity.envelope(self.identity(), None) if it is None or not it.active else it.state_dict()

    def load_state_dict(self, state: dict) -> Dataset:
        """The next iteration of this dataset goes on where the state was taken; with a state of an ended iteration it starts over. Returns the dataset."""
        object.__setattr__(self, "pending", identity.opened(self.identity(), state))
        return self

    def __iter__(self) -> DatasetIterator:
        if (it := _ACTIVE.get(self)) is not None and (it := it()) is not None and it.active:
            warnings.warn("an earlier iteration of this dataset is still active", stacklevel=2)
        made = DatasetIterator(self, self.pending)
        object.__setattr__(self, "pending", None)
        _ACTIVE[self] = weakref.ref(made)
        return made

    def rows(self, rounds: int | range = 1, start: int = 0, *, ends: bool = True) -> Iterator[dict]:
        """The rows of this context's slot in order, from place ``start`` on."""
        f = self.frame(rounds, ends=ends, slot=self.context.slot, start=start)
        mine = f.where((F.col(SLOT) == self.context.slot) & (F.col(POS) >= start)).orderBy(POS)
        for r in mine.select(*stages.data_columns(f)).toLocalIterator(prefetchPartitions=True):
            yield codecs.decode(r.asDict(recursive=True))

    def _any(self) -> bool:
        """Whether the source has a row for this slot at all."""
        if self.kind == "snapshot":
            return self._snapshot()._any()
        return self._dealt(1, self.context.slot).where(F.col(SLOT) == self.context.slot).limit(1).count() > 0

    def consume(self, factory: Callable[[], object]) -> object:
        """Fold the stream: ``push(item)`` until it returns exactly False, then the result of ``finish()``."""
        c = factory()
        for item in self:
            if c.push(item) is False:
                break
        return c.finish()

    def aggregate(self, *exprs: Column, rounds: int = 1) -> DataFrame:
        """A fold that doesn't depend on the order, as an aggregate over all slots."""
        return self.frame(rounds).agg(*exprs)


class UnsupportedResumeError(identity.UnsupportedResume):
    pass


class DatasetIterator:
    """One run over a slot's stream; knows how many items it has given out, and which round the source is in."""

    def __init__(self, dataset: Dataset, state: dict | None) -> None:
        self.dataset, self.active = dataset, True
        self._own = dataset.identity
        self._begin(state)

    def _begin(self, state: dict | None) -> None:
        self.yielded, self.round, self.ended = (state or {}).get("yielded", 0), (state or {}).get("round", 0), False
        self._it = self._items()

    def _items(self) -> Iterator[dict]:
        d = self.dataset
        if not d.resample:
            yield from d.rows(1, self.yielded)
        elif d._row_by_row:
            # a round after the other; a row of the source is read once
            while True:
                first = self.yielded
                yield from d.rows(range(self.round, self.round + 1), first)
                if self.yielded == first and not d._any():
                    return
                self.round += 1
        else:
            # stages reach over rounds: twice as many rounds each time, from where the last ended, so that no more than twice the rows are read
            while True:
                first = self.yielded
                yield from d.rows(self.round + 1, first, ends=False)
                if self.yielded == first and not d._any():
                    return
                self.round = 2 * self.round + 1

    def __iter__(self) -> DatasetIterator:
        return self

    def __next__(self) -> dict:
        try:
            row = next(self._it)
        except StopIteration:
            self.active, self.ended = False, True
            raise
        self.yielded += 1
        return row

    def live_state(self) -> dict:
        """Where this run is, without the identity of its pipeline."""
        return {"yielded": self.yielded, "round": self.round}

    def state_dict(self) -> dict:
        """Where this run is; None in it if it hasn't begun or is over."""
        return identity.envelope(self._own(), None if self.ended or not self.yielded else self.live_state())

    def load_state_dict(self, state: dict) -> None:
        """Go on from a state, or from a ``live_state``."""
        if isinstance(state, dict) and {"version", "identity", "state"} <= state.keys():
            state = identity.opened(self._own(), state)
            if state is None:
                raise identity.ResumeStateError("[InvalidResumeState] an iterator can't go on from a state of None")
        if not isinstance(state, dict) or "identity" in state or not isinstance(state.get("yielded"), int) or state["yielded"] < 0:
            raise identity.ResumeStateError("[InvalidResumeState] the state must say how many items were given out")
        self.active = True
        self._begin(state)


__all__ = ["Dataset", "DatasetIterator", "Stage", "UnsupportedResumeError"]
