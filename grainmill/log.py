"""The package's logger (G1): its level, and another one in its place."""

from __future__ import annotations

import logging

DEFAULT = logging.WARNING
_own = logging.getLogger("grainmill")
_own.setLevel(DEFAULT)
_given: object | None = None


def _level(level: int | str) -> int:
    if isinstance(level, int) and not isinstance(level, bool):
        return level
    known = logging.getLevelNamesMapping()
    if not isinstance(level, str) or level.upper() not in known:
        raise ValueError(f"unknown log level {level!r}")
    return known[level.upper()]


def set_log_level(level: int | str) -> None:
    _own.setLevel(_level(level))


def get_log_level() -> int:
    return _own.getEffectiveLevel()


def reset_log_level() -> None:
    _own.setLevel(DEFAULT)


def set_logger(logger: object) -> None:
    """Anything with debug, info, warning and error."""
    if missing := [m for m in ("debug", "info", "warning", "error") if not callable(getattr(logger, m, None))]:
        raise TypeError(f"a logger needs {missing[0]}")
    global _given
    _given = logger


def reset_logger() -> None:
    global _given
    _given = None


def get_logger() -> object:
    return _given or _own
