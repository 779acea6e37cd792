"""Iterators over single shards without Spark (S21), with the metadata columns of the scans."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow.parquet as pq

from grainmill.sources import files
from grainmill.sources.paths import local


def iter_tar(path: str, level: int | None = None) -> Iterator[dict]:
    for i, (key, fields) in enumerate(files.tar_samples(path, files.key_level() if level is None else level)):
        yield {**fields, "__key__": key, "__shard__": path, "__index_in_shard__": i}


def iter_jsonls(paths: Sequence[str]) -> Iterator[dict]:
    for path in paths:
        with open(local(path), "rb") as f:
            for i, line in enumerate(f):
                try:
                    row = json.loads(line)
                except ValueError as e:
                    raise ValueError(f"[InvalidJsonLine] {path} line {i + 1}: {e}") from e
                if not isinstance(row, dict):
                    raise ValueError(f"[InvalidJsonLine] {path} line {i + 1} is no object")
                yield {**row, "__file__": path, "__index_in_file__": i}


def parquet_batch_size(given: int | None = None) -> int:
    raw = os.environ.get("GRAINMILL_PARQUET_BATCH_SIZE", "65536") if given is None else given
    size = int(raw) if isinstance(raw, str) and raw.strip().isdigit() else raw
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise ValueError(f"[InvalidParquetBatchSize] must be a whole number from 1, got {raw!r}")
    return size


def iter_parquet(path: str, columns: Sequence[str] | None = None, row_group: int | None = None, batch_size: int | None = None) -> Iterator[dict]:
    """Rows of a file, or of one of its row groups. They are read ``batch_size`` at a time: the argument, else GRAINMILL_PARQUET_BATCH_SIZE, else 65,536."""
    batch_size = parquet_batch_size(batch_size)
    with pq.ParquetFile(local(path)) as f:
        i = sum(f.metadata.row_group(g).num_rows for g in range(row_group or 0))
        for b in f.iter_batches(batch_size, row_groups=None if row_group is None else [row_group], columns=None if columns is None else list(columns)):
            for row in b.to_pylist():
                yield {**row, "__file__": path, "__index_in_file__": i, "__key__": f"{path}:{i}"}
                i += 1


def iter_parquets(paths: Sequence[str], columns: Sequence[str] | None = None) -> Iterator[dict]:
    for p in paths:
        yield from iter_parquet(p, columns)
