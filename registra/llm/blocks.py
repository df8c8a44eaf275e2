"""Compressed blocks of numpy arrays: how rows of numbers are packed before they are shuffled."""

from __future__ import annotations

import pickle
import zlib

import numpy as np

Arrays = dict[str, np.ndarray]


def pack(arrays: Arrays) -> bytes:
    """Arrays byte by byte (all first bytes, then all second ones), rising unsigned ones as differences, and compressed."""
    out = {}
    for name, a in arrays.items():
        rising = len(a) > 1 and a.dtype.kind == "u" and bool((a[1:] >= a[:-1]).all())
        d = np.concatenate([a[:1], np.diff(a)]) if rising else a
        out[name] = (a.dtype.str, rising, zlib.compress(np.ascontiguousarray(d).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"", 1))
    return pickle.dumps(out)


def unpack(blob: bytes) -> Arrays:
    out = {}
    for name, (kind, rising, raw) in pickle.loads(blob).items():
        size = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind)[:, 0]
        out[name] = np.cumsum(a, dtype=a.dtype) if rising else a
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Numbers from zero up in two or four bytes each."""
    return a.astype(np.uint16 if not len(a) or a.max() < 1 << 16 else np.uint32)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start..start+size of each pair, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def splits(keys: np.ndarray) -> list[np.ndarray]:
    """Row numbers by key."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(keys) else []
