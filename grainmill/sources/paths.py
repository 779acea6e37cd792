"""Shard specifications: ``a::b``, one numeric range in braces, globs."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = re.compile(r"(.*)\{(\d+)\.\.(\d+)\}(.*)", re.S)


def _ranged(spec: str) -> list[str]:
    m = _RANGE.fullmatch(spec)
    if not m:
        return [spec]
    head, a, b, tail = m.groups()
    lo, hi = int(a), int(b)
    numbers = range(lo, hi + 1) if lo <= hi else range(lo, hi - 1, -1)
    return [f"{head}{str(n).zfill(max(len(a), len(b)))}{tail}" for n in numbers]


def resolve(shards: str | os.PathLike | Sequence[str | os.PathLike]) -> list[str]:
    """All paths that a specification names. A glob that matches nothing stays as it is; nothing at all is an error."""
    given = [shards] if isinstance(shards, (str, os.PathLike)) else list(shards)
    out: list[str] = []
    for spec in given:
        for piece in filter(None, (x.strip() for x in os.fspath(spec).split("::"))):
            for path in _ranged(piece):
                found = sorted(glob.glob(path)) if re.search(r"[*?\[]", path) else []
                out += found or [path]
    if not out:
        raise ValueError("the shard specification names no path")
    return [p if "://" in p else str(Path(p)) for p in out]


def local(path: str) -> str:
    """A path that this process can open, for ``file:`` addresses and plain paths."""
    return path[7:] if path.startswith("file:///") else path[5:] if path.startswith("file:/") else path


def read_from() -> Column:
    """The path of the file that a row was read from, as ``local`` gives it: Spark has it as an address, in which spaces and the like are escaped."""
    at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return F.url_decode(F.regexp_replace(at, "\\+", "%2B"))  # a plus stands for itself


def logical(paths: Sequence[str]) -> list[str]:
    """Paths relative to their common folder: the same wherever the data are mounted."""
    if len(paths) == 1:
        return [os.path.basename(paths[0])]
    root = os.path.commonpath([os.path.dirname(os.path.abspath(p)) for p in paths])
    return [os.path.relpath(os.path.abspath(p), root) for p in paths]
