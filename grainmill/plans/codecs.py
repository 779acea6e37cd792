"""Arrays in columns: a self-describing struct of bytes, type and shape, taken apart and put together recursively (X1)."""

from __future__ import annotations

import json

import numpy as np

TENSOR = "struct<codec: string, payload: binary, dtype: string, shape: string, device_type: string>"
CODEC = "ndarray-v1"
_FIELDS = {"codec", "payload", "dtype", "shape", "device_type"}


def encode(value: object) -> object:
    """Arrays become envelopes, tuples lists; everything else stays."""
    if isinstance(value, np.ndarray):
        return {"codec": CODEC, "payload": np.ascontiguousarray(value).tobytes(), "dtype": value.dtype.str, "shape": json.dumps(list(value.shape)), "device_type": "cpu"}
    if isinstance(value, dict):
        return {k: encode(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [encode(v) for v in value]
    return value


def decode(value: object) -> object:
    """What ``encode`` was given, with lists for tuples."""
    if isinstance(value, dict):
        return _array(value) if value.get("codec") == CODEC else {k: decode(v) for k, v in value.items()}
    return [decode(v) for v in value] if isinstance(value, list) else value


def _array(value: dict) -> np.ndarray:
    try:
        shape = json.loads(value["shape"])
        if value.keys() != _FIELDS or not all(isinstance(n, int) and n >= 0 for n in shape):
            raise ValueError("fields or shape are wrong")
        return np.frombuffer(bytes(value["payload"]), np.dtype(value["dtype"])).reshape(shape).copy()
    except (KeyError, TypeError, ValueError) as e:
        raise RuntimeError(f"[InvalidSnapshotTensor] {e}") from e
