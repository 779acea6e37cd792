"""Stages over ordered streams (P1, P2, T1-T5): map, select, bounded shuffle, batch, unbatch, assemble.

A stream is a frame with ``__slot__`` and ``__pos__``; order is data, never a partition's. Python is entered only for functions of the user.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators.order import CONTROL, POS, ROUND, SLOT, dense

ITEMS = "items"


def is_meta(name: str) -> bool:
    return len(name) > 4 and name.startswith("__") and name.endswith("__")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in CONTROL]


def control(df: DataFrame) -> list[str]:
    return [c for c in CONTROL if c in df.columns]


def fields(schema: str | T.StructType) -> list[T.StructField]:
    return list((T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields)


def map_columns(df: DataFrame, exprs: dict[str, Column | str]) -> DataFrame:
    """New or replaced columns from expressions: stays in the JVM."""
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in exprs.items()})


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """A Python function from row to row, called in Arrow batches; the rows' places are kept apart from it. Arrays in its results become envelopes."""
    keep, out = control(df), fields(schema)
    types = T.StructType([*(df.schema[c] for c in keep), *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from grainmill.plans.codecs import encode

        want = to_arrow_schema(types)
        for b in batches:
            rows = []
            for row in b.to_pylist():
                held = {c: row.pop(c) for c in keep}
                made = fn(row)
                if not isinstance(made, dict):
                    raise TypeError(f"map must return a dict, got {type(made).__name__}")
                rows.append(held | encode(made))
            cols = [pa.array([r.get(f.name) for r in rows], f.type) for f in want]
            yield pa.RecordBatch.from_arrays(cols, schema=want)

    return df.mapInArrow(run, types)


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns and all ``__x__`` ones, in the frame's order; names that aren't there are passed over."""
    return df.select(*[c for c in df.columns if c in names or is_meta(c)])


def reservoir(count: int, buffer_size: int, initial: int | None, seed: int, ends: bool = True) -> Iterator[int]:
    """The order in which a bounded shuffle buffer gives out rows 0..count - 1: it depends on the count and the seed alone.

    Without ``ends`` rows go on after these, and the order stops where they are needed. The buffer is all that is held.
    """
    rng, held, at = random.Random(seed), [], 0
    start = min(buffer_size, initial or buffer_size)
    while at < count or held:
        for _ in range(2):
            if at >= count and not ends and (len(held) < buffer_size or _ == 0):
                return
            if at < count and (len(held) < buffer_size or _ == 0):
                held.append(at)
                at += 1
        # the end of input is only noticed by a read that fails
        if len(held) >= start or (ends and at >= count):
            i = rng.randrange(len(held))
            held[i], held[-1] = held[-1], held[i]
            yield held.pop()


def check_shuffle(buffer_size: int, initial: int | None) -> None:
    if buffer_size <= 0:
        raise ValueError(f"buffer_size must be > 0, got {buffer_size}")
    if initial is not None and initial <= 0:
        raise ValueError(f"initial must be > 0, got {initial}")


def shuffle(df: DataFrame, buffer_size: int, initial: int | None, seed: int, per_slot: bool = True, ends: bool = True) -> DataFrame:
    """Bounded shuffle of each slot's stream: places are simulated, slot by slot in executors, and joined back; rows aren't buffered."""
    check_shuffle(buffer_size, initial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                order, to = reservoir(n, buffer_size, initial, seed + (s if per_slot else 0), ends), 0
                while got := list(islice(order, 65_536)):
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(got), pa.int32()), pa.array(got, pa.int64()), pa.array(range(to, to + len(got)), pa.int64())], [SLOT, POS, "__to__"])
                    to += len(got)

    counts = df.groupBy(F.col(SLOT).cast("int").alias(SLOT)).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.repartition(df.sparkSession.sparkContext.defaultParallelism, SLOT)
    moved = counts.mapInArrow(run, f"{SLOT} int, {POS} long, __to__ long")
    # by a number of parts that is not put together again: rows pack tightly when shuffled, and by those bytes a task's sort would get many of them
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(parts, SLOT, POS).join(moved.repartition(parts, SLOT, POS), [SLOT, POS]).withColumn(POS, F.col("__to__")).drop("__to__")
    return out.select(*df.columns)


def batch(df: DataFrame, size: int, drop_last: bool = False, collate: Callable[[Column], dict[str, Column]] | None = None, fn: Callable[[list[dict]], dict] | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """Groups of ``size`` consecutive rows. One column ``items`` (array of structs); or what ``collate`` makes of that column; or what ``fn`` makes of the list.

    Places are dense, so a group is ``pos // size``: one shuffle, of the rows, and no window.
    """
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ValueError(f"batch size must be a positive whole number, got {size!r}")
    data = data_columns(df)
    key = F.floor(F.col(POS) / size).cast("long").alias("__batch__")
    g = df.groupBy(F.col(SLOT), key).agg(F.min(ROUND).alias(ROUND), F.array_sort(F.collect_list(F.struct(POS, F.struct(*data).alias("r")))).alias("s"))
    if drop_last:
        g = g.where(F.size("s") == size)
    g = g.withColumn(ITEMS, F.transform("s", lambda x: x["r"])).withColumnRenamed("__batch__", POS).drop("s").select(SLOT, ROUND, POS, ITEMS)
    if collate is not None:
        return g.select(SLOT, ROUND, POS, *[c.alias(n) for n, c in collate(F.col(ITEMS)).items()])
    return g if fn is None else map_rows(g, lambda row: fn(row[ITEMS]), schema)


def unbatch(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Elements of ``items`` as rows again; or rows of list ``columns`` that must be equally long (default: all list columns, which must be all columns)."""
    data = data_columns(df)
    if columns is None and data == [ITEMS]:
        out = df.select(*control(df), F.posexplode(ITEMS).alias("__i__", "__x__"))
        kind = df.schema[ITEMS].dataType.elementType
        cols = [F.col(f"__x__.`{n}`").alias(n) for n in kind.names] if isinstance(kind, T.StructType) else [F.col("__x__").alias("value")]
    else:
        columns = list(columns or data)
        lists = [c for c in columns if isinstance(df.schema[c].dataType, T.ArrayType)]
        if lists != columns or set(columns) != set(data):
            raise TypeError("unbatch needs lists, all of the row's columns")
        first, *rest = columns
        same = F.lit(True)
        for c in rest:
            same = same & (F.size(c) == F.size(first))
        ok = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("unbatch: lists of a row differ in length")).cast("boolean"))
        out = df.where(ok).select(*control(df), F.posexplode(F.arrays_zip(*columns)).alias("__i__", "__x__"))
        cols = [F.col(f"__x__.`{n}`").alias(n) for n in columns]
    out = out.select(SLOT, ROUND, POS, "__i__", *cols)
    return dense(out, [SLOT], [POS, "__i__"], "__new__").drop(POS, "__i__").withColumnRenamed("__new__", POS).select(SLOT, ROUND, POS, *[c for c in out.columns if c not in (*CONTROL, "__i__")])


def assemble(df: DataFrame, factory: Callable[[], object], schema: str | T.StructType, drop_last: bool = False, ends: bool = True) -> DataFrame:
    """A state machine over each slot's stream: ``push(row)`` and, at the end, ``finish(drop_last=...)`` give rows.

    Slots are brought together and sorted by place by Spark, which spills; the machine then runs over them in Arrow batches, so a slot need not fit in memory.
    """
    types = T.StructType([T.StructField(SLOT, T.IntegerType()), T.StructField(ROUND, T.IntegerType()), T.StructField(POS, T.LongType()), *fields(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(types)
        slot, round_, machine, n = None, 0, None, 0
        made: list[dict] = []

        def take(rows) -> None:
            nonlocal n
            for r in rows or ():
                made.append({SLOT: slot, ROUND: round_, POS: n, **r})
                n += 1

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in made], f.type) for f in want], schema=want)
            made.clear()
            return b

        for b in batches:
            for row in b.to_pylist():
                s, round_ = row.pop(SLOT), row.pop(ROUND)
                row.pop(POS)
                if s != slot:
                    if machine is not None and ends:
                        take(machine.finish(drop_last=drop_last))
                    slot, machine, n = s, factory(), 0
                take(machine.push(row))
            if made:
                yield flush()
        if machine is not None and ends:
            take(machine.finish(drop_last=drop_last))
        if made:
            yield flush()

    return df.repartition(SLOT).sortWithinPartitions(SLOT, POS).mapInArrow(run, types)
