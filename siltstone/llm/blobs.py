"""Columns of numbers as one compressed value, so that a shuffle moves a few large rows for each pair of tasks."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_KINDS = ("<u8", "<i8", "<u4", "<u1")


def pack(*columns: np.ndarray) -> bytes:
    parts = [struct.pack("<BI", len(columns), len(columns[0]))]
    for c in columns:
        kind = np.dtype(c.dtype).newbyteorder("<").str.replace("|", "<")
        width = c.shape[1] if c.ndim > 1 else 0
        parts.append(struct.pack("<BH", _KINDS.index(kind), width))
        flat = np.ascontiguousarray(c).reshape(-1)
        parts.append(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes())  # bytes of equal weight together
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count, n = struct.unpack_from("<BI", raw, 0)
    at, out = 5, []
    for _ in range(count):
        kind, width = struct.unpack_from("<BH", raw, at)
        at += 3
        size, t = n * max(1, width), np.dtype(_KINDS[kind])
        c = np.frombuffer(raw, np.uint8, size * t.itemsize, at).reshape(t.itemsize, size).T
        c = np.ascontiguousarray(c).view(t).reshape((n, width) if width else n)
        at += size * t.itemsize
        out.append(c)
    return out


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True)]


def by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, blob of its rows) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.flatnonzero(np.diff(b)) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(bucket[rows[0]]), pack(*(c[rows] for c in columns))


def ragged(bucket: np.ndarray, columns: list[np.ndarray], parts: list[np.ndarray]):
    """(bucket, blob of its rows) for each bucket: a row is a value of each column and an array of its own."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        mine = [parts[i] for i in rows.tolist()]
        head = pack(*(c[rows] for c in columns), np.array([len(x) for x in mine], np.uint32))
        yield int(bucket[rows[0]]), struct.pack("<I", len(head)) + head + pack(np.concatenate(mine))


def joined_ragged(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns, where each row's array starts and ends in the values, the values) of blobs by ragged()."""
    sizes = [struct.unpack_from("<I", x)[0] for x in blobs]
    *columns, n = joined([x[4 : 4 + k] for x, k in zip(blobs, sizes, strict=True)])
    (flat,) = joined([x[4 + k :] for x, k in zip(blobs, sizes, strict=True)])
    return columns, np.concatenate([[0], np.cumsum(n.astype(np.int64))]), flat
