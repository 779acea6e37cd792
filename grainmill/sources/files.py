"""Scans of Parquet, JSONL and tar shards (S3-S11, S18, S21, S22).

Each gives a frame of rows with their unit (``__unit__``) and row in it (``__row__``), and the table of units. Parquet is Spark's own
reader, with file and row number from ``_metadata``. JSONL and tar shards are read where they lie: a task has some units, one after the
other, whose lines or members are streamed through Arrow; JSON is then parsed by Spark.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tarfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.session import attach, small
from grainmill.sources.paths import local, logical, read_from

UNIT, ROW = "__unit__", "__row__"
FOOTER_THREADS = 16
#: Tasks for each core over file units, and units of a task where there are more units than that.
WAVES, UNITS_A_TASK = 4, 256


@dataclass(frozen=True)
class Unit:
    """A piece of a source that is read in order by one slot: row groups of a file, lines of a file, or a tar."""

    path: str
    first: int = 0
    rows: int | None = None  # None: known only once it has been read
    byte: int = 0
    logical: str = ""
    source: int = 0
    sidecars: tuple[tuple[str, str], ...] = ()
    groups: tuple[int, ...] = ()


def footers(paths: Sequence[str]) -> list[list[int]]:
    """Rows of each row group of each file."""

    def one(p: str) -> list[int]:
        m = pq.read_metadata(local(p)) if "://" not in local(p) else pq.ParquetFile(p).metadata
        return [m.row_group(i).num_rows for i in range(m.num_row_groups)]

    with ThreadPoolExecutor(min(FOOTER_THREADS, len(paths), os.cpu_count() or 1)) as pool:
        return list(pool.map(one, paths))


def files_of(path: str) -> list[str]:
    """A Parquet table's part files in order of name, or the file itself."""
    at = local(path)
    if os.path.isdir(at):
        return sorted(os.path.join(at, f) for f in os.listdir(at) if f.endswith(".parquet") and not f.startswith((".", "_")))
    return [path]


def parquet_units(paths: Sequence[str], groups_per_chunk: int, total_slots: int) -> list[Unit]:
    """Runs of ``groups_per_chunk`` row groups, a file's tail kept; single groups if those are fewer than slots."""
    if isinstance(groups_per_chunk, bool) or not isinstance(groups_per_chunk, int) or groups_per_chunk < 1:
        raise ValueError(f"[InvalidParquetChunkConfig] min_row_groups_per_chunk must be a whole number from 1, got {groups_per_chunk!r}")
    sizes = footers(paths)

    def plan(n: int) -> list[Unit]:
        out = []
        for p, groups in zip(paths, sizes):
            first = 0
            for g in range(0, len(groups), n):
                rows = sum(groups[g : g + n])
                out.append(Unit(p, first, rows, groups=tuple(range(g, min(g + n, len(groups))))))
                first += rows
        return out

    units = plan(groups_per_chunk)
    return plan(1) if len(units) < total_slots and groups_per_chunk > 1 else units


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file:" + os.path.abspath(path)


def read_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files as a frame. Spark lists many paths in a job of a task a path (up to 10,000); here it has ``WAVES`` tasks a core."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    had, most = spark.conf.get(name), WAVES * spark.sparkContext.defaultParallelism
    if int(had) <= most:
        return spark.read.parquet(*paths)
    spark.conf.set(name, str(most))
    try:
        return spark.read.parquet(*paths)
    finally:
        spark.conf.set(name, had)


def scan_parquet(spark: SparkSession, units: Sequence[Unit], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of the units with ``__file__, __index_in_file__, __key__``. Rows outside the units (after split or sample) are left out."""
    paths = list(dict.fromkeys(u.path for u in units))
    df = read_parquet(spark, paths)
    data = df.columns if columns is None else [c for c in columns]
    df = df.select(*[df[c] for c in data], read_from().alias("__at__"), F.col("_metadata.row_index").alias("__index_in_file__"))
    rows = [(i, os.path.abspath(local(u.path)) if "://" not in local(u.path) else u.path, u.path, u.first, u.first + (u.rows or 0)) for i, u in enumerate(units)]
    table = spark.createDataFrame(rows, f"{UNIT} int, __path__ string, __file__ string, __from__ long, __to__ long")
    on = (F.col("__at__") == F.col("__path__")) & (F.col("__index_in_file__") >= F.col("__from__")) & (F.col("__index_in_file__") < F.col("__to__"))
    df = df.join(small(table), on).withColumn(ROW, F.col("__index_in_file__") - F.col("__from__"))
    return df.withColumn("__key__", F.concat_ws(":", "__file__", F.col("__index_in_file__").cast("string"))).drop("__at__", "__path__", "__from__", "__to__")


def _blocks(path: str) -> Iterator[tuple[int, np.ndarray]]:
    """Where each block of a file begins, and where its newlines are in the file."""
    at = 0
    with open(local(path), "rb") as f:
        while block := f.read(1 << 22):
            yield at + len(block), at + np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
            at += len(block)


def _lines(path: str) -> int:
    """How many lines a file has; the last need not end with a newline."""
    n, end, last = 0, 0, -1
    for end, ends in _blocks(path):
        n += len(ends)
        last = int(ends[-1]) if len(ends) else last
    return n + (end > last + 1)


def _starts(path: str, each: int) -> list[int]:
    """Where every ``each``-th line of a file begins."""
    out, n, end = [0], 0, 0
    for end, ends in _blocks(path):
        k = n + 1 + np.arange(len(ends))  # the number of the line after each newline
        out += (ends[k % each == 0] + 1).tolist()
        n += len(ends)
    return [x for x in out if x < end]


def jsonl_units(paths: Sequence[str], total_slots: int) -> list[Unit]:
    """A unit a file, or, if there are fewer files than slots, ranges of lines; nothing is copied."""
    if bad := [p for p in paths if not p.endswith(".jsonl")]:
        raise ValueError(f"[InvalidSourceType] not .jsonl: {bad[0]}")
    names = logical(paths)
    whole = [Unit(p, 0, None, 0, n, i) for i, (p, n) in enumerate(zip(paths, names))]
    if len(paths) >= total_slots:
        return whole
    lines = [_lines(p) for p in paths]
    total = sum(lines)
    if not total:
        return whole
    out = []
    for i, (p, name, n) in enumerate(zip(paths, names, lines)):
        if not n:
            out.append(Unit(p, 0, 0, 0, name, i))
            continue
        each = max(1, -(-n // max(1, round(n / total * total_slots))))
        out += [Unit(p, k * each, min(each, n - k * each), at, name, i) for k, at in enumerate(_starts(p, each))]
    return out


def _unit_rows(spark: SparkSession, units: Sequence[Unit], read: Callable[[int, Unit], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``read`` gives for each unit. A task has its own units only, several where there are many, so that neither tasks nor what is sent to them grow with the square of the units."""
    sc = attach(spark).sparkContext
    n = min(len(units), max(WAVES * sc.defaultParallelism, -(-len(units) // UNITS_A_TASK)))
    edge = [len(units) * k // max(n, 1) for k in range(n + 1)]
    parts = [(bytearray(pickle.dumps((x, units[x:y]))),) for x, y in zip(edge, edge[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0):
                first, mine = pickle.loads(part.as_py())
                for i, u in enumerate(mine, first):
                    yield from read(i, u)

    return spark.createDataFrame(sc.parallelize(parts, max(n, 1)), "part binary").mapInArrow(run, schema)


def read_lines(i: int, u: Unit, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The lines of a unit, a block of the file at a time, split by Arrow."""
    n = 0

    def out(body: bytes) -> pa.RecordBatch:
        nonlocal n
        text = pa.array([body.removesuffix(b"\n")], pa.large_binary()).cast(pa.large_string())
        lines = pc.utf8_rtrim(pc.split_pattern(text, "\n").flatten(), "\r\n").cast(pa.string())
        lines = lines if u.rows is None else lines.slice(0, u.rows - n)
        n += len(lines)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(lines), i, np.int32)), pa.array(np.arange(n - len(lines), n)), lines], [UNIT, ROW, "line"])

    with open(local(u.path), "rb") as f:
        f.seek(u.byte)
        held: list[bytes] = []
        while u.rows is None or n < u.rows:
            block = f.read(size)
            if not block:
                if held:
                    yield out(b"".join(held))
                return
            cut = block.rfind(b"\n") + 1
            if cut:
                yield out(b"".join([*held, block[:cut]]))
                held = []
            if cut < len(block):
                held.append(block[cut:])


def scan_jsonl(spark: SparkSession, units: Sequence[Unit], schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of JSON lines with ``__file__`` (logical path), ``__index_in_file__`` and ``__key__``; a line that isn't an object is an error."""
    if schema is None:
        schema = spark.read.json(sorted({_uri(u.path) for u in units})).schema
        if "_corrupt_record" in schema.names:
            schema = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    digest = hashlib.sha256("\n".join(sorted({f"{u.source}:{u.logical}" for u in units})).encode()).hexdigest()[:16]
    lines = _unit_rows(spark, units, read_lines, f"{UNIT} int, {ROW} long, line string")
    full = T.StructType([*st.fields, T.StructField("__bad__", T.StringType())])
    info = spark.createDataFrame([(i, u.logical, u.source, u.first, u.path) for i, u in enumerate(units)], f"{UNIT} int, __file__ string, __src__ int, __first__ long, __path__ string")
    df = lines.join(small(info), UNIT).withColumn("j", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad__"}))
    at = F.col("__first__") + F.col(ROW)
    wrong = F.concat(F.lit("[InvalidJsonLine] "), F.col("__path__"), F.lit(" line "), (at + 1).cast("string"))
    ok = F.col("j").isNotNull() & F.col("j.__bad__").isNull() & F.trim("line").startswith("{")
    df = df.withColumn("__ok__", F.when(ok, F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))).where("__ok__")
    own = {"__file__", "__index_in_file__", "__key__"} <= set(st.names)
    meta = [] if own else [F.col("__file__"), at.alias("__index_in_file__"), F.concat_ws(":", F.lit(digest), F.col("__src__").cast("string"), at.cast("string")).alias("__key__")]
    return df.select(UNIT, ROW, *[F.col(f"j.`{n}`").alias(n) for n in st.names if own or n not in ("__file__", "__index_in_file__", "__key__")], *meta)


def tar_units(paths: Sequence[str], total_slots: int, sidecars: Sequence[tuple[str, Callable[[str], str]]] | None = None) -> list[Unit]:
    if bad := [p for p in paths if not p.endswith(".tar")]:
        raise ValueError(f"[InvalidSourceType] not .tar: {bad[0]}")
    if len(paths) < total_slots:
        raise ValueError(f"[InsufficientTarShards] {len(paths)} tars for {total_slots} slots")
    return [Unit(p, 0, None, 0, p, i, tuple((name, str(find(p))) for name, find in sidecars or ())) for i, p in enumerate(paths)]


def key_level() -> int:
    """How many dot-separated parts of a member's base name are its key."""
    raw = os.environ.get("GRAINMILL_TAR_KEY_DOT_LEVEL", "1")
    if not raw.isdigit() or int(raw) < 1:
        raise ValueError(f"[InvalidTarKeyDotLevel] must be a whole number from 1, got {raw!r}")
    return int(raw)


def tar_samples(path: str, level: int = 1) -> Iterator[tuple[str, dict[str, bytes]]]:
    """Consecutive members of equal key as one sample: key, field -> content."""
    key, fields = None, {}
    with tarfile.open(local(path), "r|*") as tar:
        for m in tar:
            base = os.path.basename(m.name)
            if not m.isfile() or (base.startswith("__") and base.endswith("__")) or "." not in base:
                continue
            parts = base.split(".")
            k, field = ".".join(parts[:level]), ".".join(parts[level:])
            if not field:
                raise ValueError(f"[InvalidSampleKey] {m.name} in {path} has no field beyond {level} parts of key")
            if k != key:
                if key is not None:
                    yield key, fields
                key, fields = k, {}
            if field in fields:
                raise ValueError(f"[InvalidSampleKey] field {field!r} of {k!r} is in {path} twice")
            fields[field] = tar.extractfile(m).read()
    if key is not None:
        yield key, fields


def _with_sidecars(u: Unit, level: int) -> Iterator[tuple[str, dict[str, bytes]]]:
    """The main tar's samples with those of its sidecars, position by position."""
    others = [(name, tar_samples(p, level)) for name, p in u.sidecars]
    end = object()
    for key, fields in tar_samples(u.path, level):
        for name, it in others:
            got = next(it, end)
            if got is end:
                raise ValueError(f"[SidecarLengthMismatch] sidecar {name!r} of {u.path} ends before {key!r}")
            if got[0] != key:
                raise ValueError(f"[SidecarKeyMismatch] sidecar {name!r} of {u.path} has {got[0]!r} where {key!r} is due")
            own = {f: v for f, v in got[1].items() if not (f.startswith("__") and f.endswith("__"))}
            if clash := own.keys() & fields.keys():
                raise ValueError(f"[SidecarFieldConflict] sidecar {name!r} of {u.path} repeats {sorted(clash)}")
            fields = fields | own
        yield key, fields
    for name, it in others:
        if next(it, end) is not end:
            raise ValueError(f"[SidecarLengthMismatch] sidecar {name!r} of {u.path} goes on after its end")


def scan_tar(spark: SparkSession, units: Sequence[Unit], fields: Sequence[str] | None = None, level: int | None = None) -> DataFrame:
    """Samples of tars with ``__key__, __shard__, __index_in_shard__``; each of ``fields`` as a BINARY column, or all in a map ``fields``."""
    level = key_level() if level is None else level
    typed = [f"`{f}` binary" for f in fields] if fields is not None else ["fields map<string,binary>"]

    def read(i: int, u: Unit) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, dict[str, bytes]]] = []
        n = size = 0

        def out() -> pa.RecordBatch:
            k = len(rows)
            cols = [pa.array([i] * k, pa.int32()), pa.array(range(n - k, n), pa.int64())]
            if fields is None:
                cols.append(pa.array([list(f.items()) for _, f in rows], pa.map_(pa.string(), pa.binary())))
            else:
                cols += [pa.array([f.get(c) for _, f in rows], pa.binary()) for c in fields]
            cols += [pa.array([x for x, _ in rows], pa.string()), pa.array([u.path] * k, pa.string()), pa.array(range(n - k, n), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, [UNIT, ROW, *(fields if fields is not None else ["fields"]), "__key__", "__shard__", "__index_in_shard__"])

        for key, f in _with_sidecars(u, level):
            rows.append((key, f))
            n += 1
            size += sum(map(len, f.values()))
            if size > 1 << 25 or len(rows) == 4096:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return _unit_rows(spark, units, read, ", ".join([f"{UNIT} int, {ROW} long", *typed, "__key__ string, __shard__ string, __index_in_shard__ long"]))


def _tar_rows(u: Unit, level: int) -> int:
    """Samples of a tar, from its headers alone."""
    n, key = 0, None
    with tarfile.open(local(u.path), "r:*") as tar:
        for m in tar:
            base = os.path.basename(m.name)
            if m.isfile() and not (base.startswith("__") and base.endswith("__")) and "." in base:
                k = ".".join(base.split(".")[:level])
                n, key = n + (k != key), k
    return n


def counted(spark: SparkSession, kind: str, units: Sequence[Unit], level: int | None = None) -> dict[int, int]:
    """Rows of each unit: from the plan where known, else by counting lines or headers where the files lie; no content is parsed."""
    if all(u.rows is not None for u in units):
        return {i: u.rows for i, u in enumerate(units)}
    level = (key_level() if level is None else level) if kind == "tar" else 0

    def count(i: int, u: Unit) -> Iterator[pa.RecordBatch]:
        n = _tar_rows(u, level) if kind == "tar" else _lines(u.path) if u.rows is None else u.rows
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64())], [UNIT, ROW])

    return {r[0]: r[1] for r in _unit_rows(spark, units, count, f"{UNIT} int, {ROW} long").collect()}
