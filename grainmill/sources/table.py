"""Versioned Parquet tables with global row numbers (S12-S15, X8): the counterpart of a versioned columnar dataset.

A table is a folder; each version is a small JSON list of part files and their row counts under ``_versions``, written last, so a
reader pins a version when it is discovered and never sees half a write. A plain Parquet file or folder is a table of one version.
Row numbers come from the files' own row index and the counts, so no pass over the data is needed.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import small
from grainmill.sources.files import files_of, footers
from grainmill.sources.paths import local, read_from


@dataclass(frozen=True)
class Part:
    path: str
    rows: int


@dataclass(frozen=True)
class Table:
    uri: str
    version: int
    parts: tuple[Part, ...]
    offset: int = 0

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)


@dataclass(frozen=True)
class TableSource:
    """Tables one after the other in one space of row numbers."""

    tables: tuple[Table, ...]
    refs: dict = field(default_factory=dict, hash=False)

    @property
    def rows(self) -> int:
        return sum(t.rows for t in self.tables)

    def fingerprint(self) -> str:
        made = [[t.uri, t.version, t.offset, [[os.path.basename(p.path), p.rows] for p in t.parts]] for t in self.tables]
        return hashlib.sha256(json.dumps(made, sort_keys=True).encode()).hexdigest()


def versions(uri: str) -> list[int]:
    at = os.path.join(local(uri), "_versions")
    return sorted(int(f[:-5]) for f in os.listdir(at) if f.endswith(".json")) if os.path.isdir(at) else []


def write(df: DataFrame, uri: str, mode: str = "overwrite", max_rows_per_file: int | None = None) -> int:
    """Write ``df`` as a new version (with ``append``: after the rows of the last) and return its number."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, got {mode!r}")
    at = local(uri)
    known = versions(uri)
    before = [vars(p) for p in open_table(uri).parts] if mode == "append" and known else []
    data = os.path.join(at, f"data-{uuid.uuid4().hex}")
    w = df.write
    if max_rows_per_file:
        w = w.option("maxRecordsPerFile", max_rows_per_file)
    w.parquet(data)
    files = files_of(data)
    parts = before + [{"path": os.path.relpath(f, at), "rows": sum(n)} for f, n in zip(files, footers(files) if files else [])]
    number = (known[-1] if known else 0) + 1
    os.makedirs(os.path.join(at, "_versions"), exist_ok=True)
    final = os.path.join(at, "_versions", f"{number}.json")
    with open(final + ".tmp", "w") as f:
        json.dump({"parts": [{"path": os.path.relpath(os.path.join(at, p["path"]), at), "rows": p["rows"]} for p in parts]}, f)
    os.rename(final + ".tmp", final)
    return number


def open_table(uri: str, version: int | None = None, offset: int = 0) -> Table:
    at, known = local(uri), versions(uri)
    if known:
        v = known[-1] if version is None else version
        if v not in known:
            raise ValueError(f"[EmptyLanceSource] {uri} has no version {v}")
        with open(os.path.join(at, "_versions", f"{v}.json")) as f:
            parts = tuple(Part(os.path.normpath(os.path.join(at, p["path"])), p["rows"]) for p in json.load(f)["parts"])
        return Table(uri, v, parts, offset)
    if not os.path.exists(at):
        raise FileNotFoundError(uri)
    files = files_of(uri)
    return Table(uri, 1, tuple(Part(f, sum(n)) for f, n in zip(files, footers(files) if files else [])), offset)


def config(path: str) -> tuple[list[str], dict]:
    """``main_uri``, ``shards`` or ``uri`` (in this order) and ``ref_columns`` of a JSON file; relative addresses start from it."""
    try:
        with open(local(path)) as f:
            made = json.load(f)
    except FileNotFoundError:
        raise ValueError(f"[MissingLanceConfig] {path} is not there") from None
    except json.JSONDecodeError as e:
        raise ValueError(f"[InvalidLanceConfig] {path} is not JSON: {e}") from None
    if not isinstance(made, dict):
        raise ValueError(f"[InvalidLanceConfig] {path} must hold an object")
    main = next((made[k] for k in ("main_uri", "shards", "uri") if made.get(k)), None)
    main = [main] if isinstance(main, str) else main
    if not isinstance(main, list) or not main or not all(isinstance(x, str) and x for x in main):
        raise ValueError(f"[InvalidLanceConfig] {path} needs main_uri, shards or uri")
    root = os.path.dirname(os.path.abspath(local(path)))
    full = lambda x: x if "://" in x or os.path.isabs(x) else os.path.join(root, x)
    refs = made.get("ref_columns") or {}
    if not isinstance(refs, dict):
        raise ValueError(f"[InvalidLanceConfig] ref_columns of {path} must be an object")
    fixed = {}
    for name, spec in refs.items():
        spec = dict(spec) if isinstance(spec, dict) else spec
        if isinstance(spec, dict) and "uri" in spec:
            u = spec["uri"]
            spec["uri"] = full(u) if isinstance(u, str) else [full(x) for x in u]
        fixed[name] = spec
    return [full(x) for x in main], fixed


def discover(uris: Sequence[str], refs: dict | None = None) -> TableSource:
    """Pin the versions of all tables and lay their rows end to end."""
    out, at = [], 0
    for uri in uris:
        t = open_table(uri, offset=at)
        out.append(t)
        at += t.rows
    if not out:
        raise ValueError("[EmptyLanceSource] no table given")
    return TableSource(tuple(out), refs or {})


def scan(spark: SparkSession, source: TableSource, columns: Sequence[str] | None = None, meta: bool = True, within: range | None = None) -> DataFrame:
    """Rows with ``__file__, __local_index__, __global_index__, __key__``. The table of files (a row each) is broadcast if it is short.

    ``within``: only files that hold a row of this range of ``__global_index__`` are read.
    """
    rows, paths = [], []
    for t in source.tables:
        before = 0
        for p in t.parts:
            at = before + t.offset
            if within is None or (at < within.stop and at + p.rows > within.start):
                rows.append((os.path.abspath(local(p.path)), t.uri, before, t.offset))
                paths.append(p.path)
            before += p.rows
    if not paths and within is not None:
        return scan(spark, source, columns, meta).where("false")
    if not paths:
        raise ValueError("[EmptyLanceSource] the tables have no files")
    df = spark.read.parquet(*dict.fromkeys(paths))
    data = [c for c in (df.columns if columns is None else columns)]
    if len(rows) == 1:  # one file: literals instead of a join
        at = F.col("_metadata.row_index")
        df = df.select(*[df[c] for c in data], F.lit(rows[0][1]).alias("__file__"), (at + rows[0][2]).alias("__local_index__"), (at + rows[0][2] + rows[0][3]).alias("__global_index__"))
    else:
        df = df.select(*[df[c] for c in data], read_from().alias("__at__"), F.col("_metadata.row_index").alias("__i__"))
        files = spark.createDataFrame(rows, "__path__ string, __file__ string, __before__ long, __offset__ long")
        df = df.join(small(files), F.col("__at__") == F.col("__path__"))
        df = df.withColumn("__local_index__", F.col("__before__") + F.col("__i__")).withColumn("__global_index__", F.col("__local_index__") + F.col("__offset__"))
        df = df.drop("__at__", "__path__", "__i__", "__before__", "__offset__")
    df = df.withColumn("__key__", F.concat_ws(":", "__file__", F.col("__local_index__").cast("string")))
    return df if meta else df.select(*data)


def take(spark: SparkSession, source: TableSource, indexes: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows by global index, in the order asked for (``__order__``), repeats included."""
    if bad := [i for i in indexes if not 0 <= i < source.rows]:
        raise IndexError(f"row {bad[0]} is not in 0..{source.rows - 1}")
    asked = spark.createDataFrame(list(enumerate(indexes)), "__order__ long, __global_index__ long")
    return scan(spark, source, columns).join(small(asked), "__global_index__")
