"""Shards from frames: Parquet files, JSONL files and tars, one a unit, written in executors to a folder that all of them share.

Rows are brought together by unit and sorted by Spark, which spills; a task streams its units to their files one after the other. A file is
written aside and renamed, so a task that runs twice leaves one whole file. Rows of a unit come in the order of ``order``.
"""

from __future__ import annotations

import io
import os
import tarfile
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.session import attach
from grainmill.sources.paths import local

_U, _O = "__u__", "__o__"
#: Bytes of rows (in Arrow) to a row group of a Parquet file.
GROUP_BYTES = 1 << 27


class _Parquet:
    def __init__(self, f: BinaryIO, schema: pa.Schema) -> None:
        self.out, self.held, self.size, self.schema = pq.ParquetWriter(f, schema), [], 0, schema

    def add(self, b: pa.RecordBatch) -> None:
        self.held.append(b)
        self.size += b.nbytes
        if self.size >= GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            t = pa.Table.from_batches(self.held, self.schema)
            self.out.write_table(t, len(t))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()


class _Lines:
    def __init__(self, f: BinaryIO, schema: pa.Schema) -> None:
        self.out = f

    def add(self, b: pa.RecordBatch) -> None:
        self.out.write("".join(f"{x}\n" for x in b.column(0).to_pylist()).encode())

    def close(self) -> None:
        pass


class _Tar:
    """Members ``<first column>.<name of another column>``."""

    def __init__(self, f: BinaryIO, schema: pa.Schema) -> None:
        self.out, self.names = tarfile.open(fileobj=f, mode="w"), schema.names[1:]

    def add(self, b: pa.RecordBatch) -> None:
        for key, *values in zip(*(c.to_pylist() for c in b.columns)):
            for name, v in zip(self.names, values):
                if v is not None:
                    info = tarfile.TarInfo(f"{key}.{name}")
                    info.size = len(v)
                    self.out.addfile(info, io.BytesIO(v))

    def close(self) -> None:
        self.out.close()


def _written(df: DataFrame, make: type, path: Callable[[int], str], names: list[str] | None = None) -> list[str]:
    """The files of the units of ``df`` (``_U``, ``_O``, columns; ``names``: what ``make`` is to call these), in the order of units."""
    attach(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = at = aside = f = out = None
        done: list[str] = []

        def finish() -> None:
            if out is not None:
                out.close()
                f.close()
                os.replace(aside, at)
                done.append(at)

        for b in batches:
            units = b.column(0).to_numpy(zero_copy_only=False)
            edge = np.append(np.append(0, np.flatnonzero(units[1:] != units[:-1]) + 1), len(units)) if len(units) else [0]
            b = pa.RecordBatch.from_arrays(b.columns[2:], names or b.schema.names[2:])
            for x, y in zip(edge, edge[1:]):
                if out is None or units[x] != unit:
                    finish()
                    unit = units[x]
                    at = path(unit)
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    aside = f"{at}.{uuid.uuid4().hex}"
                    f = open(aside, "wb")
                    out = make(f, b.schema)
                out.add(b.slice(x, y - x))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(done)], ["path"])
                done = []
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    placed = df.repartition(_U).sortWithinPartitions(_U, _O)
    return sorted(r[0] for r in placed.mapInArrow(run, "path string").collect())


def parquet_files(df: DataFrame, unit: Column, order: Column, folder: str) -> list[str]:
    """A Parquet file for each unit (a whole number), in the order of units."""
    at = local(folder)
    return _written(df.select(unit.cast("long").alias(_U), order.alias(_O), *df.columns), _Parquet, lambda u: os.path.join(at, f"{_U}={u:08d}", "part-0.parquet"))


def jsonl_files(df: DataFrame, unit: Column, order: Column, folder: str) -> list[str]:
    """A JSONL file for each unit."""
    at = local(folder)
    lines = df.select(unit.cast("long").alias(_U), order.alias(_O), F.to_json(F.struct(*df.columns)).alias("line"))
    return _written(lines, _Lines, lambda u: os.path.join(at, f"{u:08d}.jsonl"))


def tar_files(df: DataFrame, unit: Column, order: Column, key: Column, fields: dict[str, Column], folder: str) -> list[str]:
    """A tar for each unit, members ``<key>.<field>`` (binary); null fields are left out."""
    at = local(folder)
    rows = df.select(unit.cast("long").alias(_U), order.alias(_O), key.cast("string").alias("k"), *[v.cast("binary").alias(f"f{i}") for i, v in enumerate(fields.values())])
    return _written(rows, _Tar, lambda u: os.path.join(at, f"{u:08d}.tar"), ["k", *fields])
