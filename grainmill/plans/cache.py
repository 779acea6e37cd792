"""Artifacts that are built once and found again by what they were made from (X2-X8)."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from grainmill.sources.paths import logical

SCHEMA = 1
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def canonical(x: object) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(x: object) -> str:
    return hashlib.sha256(canonical(x).encode()).hexdigest()


@dataclass(frozen=True)
class SourceFingerprint:
    """What an artifact was made from, and its digest."""

    manifest: dict
    value: str = ""

    def __post_init__(self) -> None:
        if not isinstance(self.manifest, dict):
            raise ValueError("[InvalidSourceManifest] the manifest must be a mapping")
        own = digest(self.manifest)
        if self.value and self.value != own:
            raise ValueError("[InvalidSourceFingerprint] the digest isn't that of the manifest")
        object.__setattr__(self, "value", own)


def fingerprint_files(paths: Sequence[str], mode: str = "metadata") -> SourceFingerprint:
    """Local files by their place under their common folder, with size and time, or their content."""
    if not paths:
        raise ValueError("[EmptyCacheSource] no files given")
    if mode not in ("metadata", "content"):
        raise ValueError(f"[InvalidCacheFingerprintMode] {mode!r} is neither metadata nor content")
    out = []
    for p, name in zip(paths, logical(paths)):
        st = os.stat(p)
        e: dict = {"path": name, "size": st.st_size}
        if mode == "metadata":
            e["mtime_ns"] = st.st_mtime_ns
        else:
            with open(p, "rb") as f:
                e["sha256"] = hashlib.file_digest(f, "sha256").hexdigest()
        out.append(e)
    return SourceFingerprint({"kind": "files", "mode": mode, "files": out})


@dataclass(frozen=True)
class CacheConfig:
    """Root: argument, else GRAINMILL_CACHE_DIR, else XDG_CACHE_HOME, else ~/.cache."""

    root: str = ""
    fingerprint_mode: str = ""
    wait_timeout: float = -1.0
    poll_interval: float = 0.25

    def __post_init__(self) -> None:
        env = os.environ
        root = self.root or env.get("GRAINMILL_CACHE_DIR") or os.path.join(env.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "grainmill")
        mode = self.fingerprint_mode or env.get("GRAINMILL_CACHE_FINGERPRINT_MODE", "metadata")
        if mode not in ("metadata", "content"):
            raise ValueError(f"[InvalidCacheFingerprintMode] {mode!r} is neither metadata nor content")
        wait = float(env.get("GRAINMILL_CACHE_WAIT_TIMEOUT_SECONDS", 1800)) if self.wait_timeout == -1.0 else self.wait_timeout
        if not wait > 0:
            raise ValueError(f"[InvalidCacheWaitTimeout] must be > 0, got {wait}")
        if not self.poll_interval > 0:
            raise ValueError(f"[InvalidCachePollInterval] must be > 0, got {self.poll_interval}")
        for k, v in (("root", root), ("fingerprint_mode", mode), ("wait_timeout", wait)):
            object.__setattr__(self, k, v)


@dataclass(frozen=True)
class CacheEntryInfo:
    path: Path
    kind: str
    format_version: int
    source: str
    parameters: dict
    files: dict[str, int]


class CacheManager:
    """One writer per artifact, under a lock; built aside, checked, then renamed into place. Waiters poll until a deadline."""

    def __init__(self, config: CacheConfig | None = None) -> None:
        self.config = config or CacheConfig()
        self.root = Path(self.config.root)

    def _place(self, source: SourceFingerprint, kind: str, version: int, parameters: dict) -> Path:
        if not isinstance(kind, str) or not _NAME.fullmatch(kind):
            raise ValueError(f"[InvalidCacheKind] {kind!r}")
        if isinstance(version, bool) or not isinstance(version, int) or version < 1:
            raise ValueError(f"[InvalidCacheFormatVersion] {version!r}")
        return self.root / kind / f"{source.value[:32]}-{digest([version, parameters])[:16]}"

    def find(self, source: SourceFingerprint, kind: str, version: int, parameters: dict) -> CacheEntryInfo | None:
        """The artifact if it is whole: its manifest fits and each file has its size."""
        at = self._place(source, kind, version, parameters)
        e = self._read(at)
        if e is None or (e.kind, e.format_version, e.parameters) != (kind, version, json.loads(canonical(parameters))):
            return None
        if e.source != source.value:
            raise RuntimeError("[CacheSourceFingerprintCollision] two sources share a place")
        return e

    @staticmethod
    def _read(at: Path) -> CacheEntryInfo | None:
        try:
            m = json.loads((at / "manifest.json").read_text())
            if m["schema"] != SCHEMA:
                return None
            e = CacheEntryInfo(at, m["kind"], m["format_version"], m["source"], m["parameters"], m["files"])
            return e if all((at / f).stat().st_size == n for f, n in e.files.items()) else None
        except (OSError, ValueError, KeyError, TypeError):
            return None

    @contextlib.contextmanager
    def _lease(self, at: Path) -> Iterator[None]:
        at.parent.mkdir(parents=True, exist_ok=True)
        end = time.monotonic() + self.config.wait_timeout
        with open(at.parent / f".{at.name}.lock", "w") as f:
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() > end:
                        raise TimeoutError(f"[CacheBuildTimeout] another build of {at.name} has not ended") from None
                    time.sleep(self.config.poll_interval)
            yield

    def ensure(self, source: SourceFingerprint, kind: str, version: int, parameters: dict, build: Callable[[Path], None], parts: Sequence[str] | None = None) -> CacheEntryInfo:
        """Find the artifact or build it. With ``parts``, ``build(folder, part)`` is called for each and finished parts survive a crash."""
        at = self._place(source, kind, version, parameters)
        if parts is not None:
            if bad := [p for p in parts if not isinstance(p, str) or not _NAME.fullmatch(p)]:
                raise ValueError(f"[InvalidCachePartName] {bad[0]!r}")
            if len(set(parts)) != len(parts):
                raise ValueError("[DuplicateCachePartName] parts must be distinct")
        if e := self.find(source, kind, version, parameters):
            return e
        with self._lease(at):
            if e := self.find(source, kind, version, parameters):
                return e
            tmp = at.parent / (f".{at.name}.parts" if parts is not None else f".{at.name}.{uuid.uuid4().hex}")
            try:
                tmp.mkdir(exist_ok=True)
                if parts is None:
                    build(tmp)
                for p in parts or ():
                    if not (tmp / p / ".done").exists():
                        shutil.rmtree(tmp / p, ignore_errors=True)
                        (tmp / p).mkdir()
                        build(tmp / p, p)
                        (tmp / p / ".done").touch()
                files = {str(f.relative_to(tmp)): f.stat().st_size for f in sorted(tmp.rglob("*")) if f.is_file()}
                if not files:
                    raise RuntimeError("[InvalidCacheBuildResult] the build left no file")
                (tmp / "manifest.json").write_text(canonical({"schema": SCHEMA, "kind": kind, "format_version": version, "source": source.value, "manifest": source.manifest, "parameters": parameters, "files": files}))
                shutil.rmtree(at, ignore_errors=True)  # a broken one
                os.rename(tmp, at)
            except BaseException:
                if parts is None:
                    shutil.rmtree(tmp, ignore_errors=True)
                raise
            e = self._read(at)
            if e is None:
                raise RuntimeError(f"[InvalidPublishedCache] {at} isn't whole")
            return e

    def entries(self, source: str | None = None, kind: str | None = None) -> list[CacheEntryInfo]:
        found = [self._read(p.parent) for p in sorted(self.root.glob("*/*/manifest.json")) if not p.parent.name.startswith(".")]
        return [e for e in found if e and (source is None or e.source == source) and (kind is None or e.kind == kind)]


def list_cache_entries(cache_dir: str | None = None, source_fingerprint: str | None = None, kind: str | None = None) -> list[CacheEntryInfo]:
    return CacheManager(CacheConfig(cache_dir or "")).entries(source_fingerprint, kind)


def clear_cache(cache_dir: str | None = None, source_fingerprint: str | None = None, kind: str | None = None) -> int:
    """Remove complete artifacts; how many."""
    found = list_cache_entries(cache_dir, source_fingerprint, kind)
    for e in found:
        shutil.rmtree(e.path)
    return len(found)
