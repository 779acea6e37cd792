"""Structural identities of pipelines (R2, R3) and the resume envelope (R1)."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import inspect
import json
import operator
from collections.abc import Mapping, Set

VERSION = 3
DEPTH = 16


class ResumeStateError(ValueError):
    """A resume state that can't be used, or an object without a stable identity."""


class UnsupportedResume(RuntimeError):
    """This pipeline can't be resumed."""


def _name(x: object) -> str:
    t = x if inspect.isclass(x) else type(x)
    return f"{t.__module__}.{t.__qualname__}"


def identity(x: object, _depth: int = 0, _above: tuple[int, ...] = ()) -> object:
    """A JSON value that is equal in every process for equal definitions; an error for what has none."""
    if _depth > DEPTH:
        raise ResumeStateError(f"[UnstableResumeIdentity] {_name(x)} is nested too deeply")
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if x == x and abs(x) != float("inf") else {"float": repr(x)}
    if isinstance(x, (bytes, bytearray, memoryview)):
        return {"bytes": hashlib.sha256(bytes(x)).hexdigest()}
    if isinstance(x, range):
        return {"range": [x.start, x.stop, x.step]}
    if id(x) in _above:
        raise ResumeStateError(f"[UnstableResumeIdentity] {_name(x)} holds itself")
    sub = functools.partial(identity, _depth=_depth + 1, _above=(*_above, id(x)))
    own = getattr(x, "identity", None)
    if own is not None and not inspect.isclass(x):
        return {"type": _name(x), "is": sub(own() if callable(own) else own)}
    if isinstance(x, functools.partial):
        return {"partial": [sub(x.func), [sub(a) for a in x.args], {k: sub(v) for k, v in sorted((x.keywords or {}).items())}]}
    if type(x) is operator.methodcaller:
        name, args = x.__reduce__()[1][0], x.__reduce__()[1][1:]
        return {"methodcaller": [sub(name) if isinstance(name, str) else sub(name), [sub(a) for a in args]]}
    if inspect.isbuiltin(x):
        return {"builtin": f"{x.__module__}.{x.__qualname__}"}
    if inspect.ismethod(x):
        return {"method": [sub(x.__func__), sub(x.__self__)]}
    if inspect.isfunction(x):
        cells = [sub(c.cell_contents) for c in x.__closure__ or ()]
        try:
            code = inspect.getsource(x)
        except (OSError, TypeError):
            code = x.__code__.co_code.hex() + repr([c for c in x.__code__.co_consts if not inspect.iscode(c)])
        return {"function": f"{x.__module__}.{x.__qualname__}", "code": hashlib.sha256(code.encode()).hexdigest(), "defaults": [sub(d) for d in x.__defaults__ or ()], "kwdefaults": {k: sub(v) for k, v in sorted((x.__kwdefaults__ or {}).items())}, "closure": cells}
    if inspect.isclass(x):
        try:
            code = inspect.getsource(x)
        except (OSError, TypeError):
            code = ""
        return {"class": _name(x), "code": hashlib.sha256(code.encode()).hexdigest()}
    if dataclasses.is_dataclass(x):
        return {"dataclass": _name(x), "fields": {f.name: sub(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, Mapping):
        if bad := [k for k in x if not isinstance(k, (str, int, float, bool, type(None)))]:
            raise ResumeStateError(f"[UnstableResumeIdentity] a key of type {_name(bad[0])}")
        return {"mapping": sorted(([type(k).__name__, str(k), sub(v)] for k, v in x.items()), key=lambda e: e[:2])}
    if isinstance(x, Set):
        return {"set": sorted((sub(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True))}
    if isinstance(x, (list, tuple)):
        return {"tuple" if isinstance(x, tuple) else "list": [sub(v) for v in x]}
    # Spark columns say what they are; anything else that only has its address does not
    text = repr(x)
    if _name(x).startswith("pyspark.") and " at 0x" not in text:
        return {"spark": text}
    raise ResumeStateError(f"[UnstableResumeIdentity] {_name(x)} has no stable identity; give it identity()")


def difference(want: object, got: object, path: str = "$") -> str | None:
    """Where two identities part, and both values there."""
    if isinstance(want, dict) and isinstance(got, dict):
        for k in sorted(want.keys() | got.keys()):
            if k not in want or k not in got:
                return f"{path}.{k}: {want.get(k, '(none)')!r} / {got.get(k, '(none)')!r}"
            if d := difference(want[k], got[k], f"{path}.{k}"):
                return d
        return None
    if isinstance(want, list) and isinstance(got, list) and len(want) == len(got):
        return next((d for i, (a, b) in enumerate(zip(want, got)) if (d := difference(a, b, f"{path}[{i}]"))), None)
    return None if want == got and type(want) is type(got) else f"{path}: {want!r} / {got!r}"


def envelope(own: object, state: object) -> dict:
    return {"version": VERSION, "identity": own, "state": state}


def opened(own: object, given: object) -> object:
    """The state in an envelope, if it is one of this version and identity."""
    if not isinstance(given, dict) or not {"version", "identity", "state"} <= given.keys():
        raise ResumeStateError("[InvalidResumeState] not a resume state")
    if given["version"] != VERSION:
        raise ResumeStateError(f"[InvalidResumeStateVersion] version {given['version']!r} where {VERSION} is due")
    if d := difference(given["identity"], own):
        raise ResumeStateError(f"[ResumeIdentityMismatch] saved / own differ at {d}")
    s = given["state"]
    if s is not None and not (isinstance(s, dict) and isinstance(s.get("yielded"), int) and s["yielded"] >= 0):
        raise ResumeStateError("[InvalidResumeState] the state must say how many items were given out")
    return s
