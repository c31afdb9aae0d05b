"""WKB polygons and lines: ISO and EWKB, either byte order, extra dimensions dropped."""

from __future__ import annotations

import struct

import numpy as np


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def take(self, code: str) -> int:
        value = struct.unpack_from(self.order + code, self.data, self.at)[0]
        self.at += struct.calcsize(code)
        return value

    def head(self) -> tuple[int, int]:
        """Geometry type and number of coordinates of a point; the byte order and an SRID are consumed."""
        self.order = "<" if self.data[self.at] else ">"
        self.at += 1
        code = self.take("I")
        size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            self.take("I")
        code &= 0x0FFFFFFF
        size += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000 % 10] if code >= 1000 else 0
        return code % 1000, size

    def points(self, size: int) -> np.ndarray:
        n = self.take("I")
        out = np.frombuffer(self.data, self.order + "f8", n * size, self.at).reshape(n, size)[:, :2].astype(float)
        self.at += 8 * n * size
        return out


def polygons(data: bytes) -> list[list[np.ndarray]]:
    """Parts of a geometry, each a list of rings as stored, shell first; points and lines of collections are left out."""
    return _parts(_Reader(data))


def _parts(r: _Reader) -> list[list[np.ndarray]]:
    kind, size = r.head()
    if kind == 1:
        r.at += 8 * size
    elif kind == 2:
        r.points(size)
    elif kind == 3:
        rings = [r.points(size) for _ in range(r.take("I"))]
        return [rings] if rings and len(rings[0]) else []
    elif kind in (4, 5, 6, 7):
        return [p for _ in range(r.take("I")) for p in _parts(r)]
    else:
        raise ValueError(f"geometry type {kind} isn't supported")
    return []


def line(data: bytes) -> np.ndarray:
    r = _Reader(data)
    kind, size = r.head()
    if kind != 2:
        raise ValueError("not a LineString")
    return r.points(size)


def _ring(points: np.ndarray) -> bytes:
    p = np.asarray(points, "<f8")
    if len(p) and (p[0] != p[-1]).any():
        p = np.concatenate([p, p[:1]])
    return struct.pack("<I", len(p)) + p.tobytes()


def from_polygons(parts: list[list[np.ndarray]], multi: bool = False) -> bytes:
    """Little-endian Polygon, or MultiPolygon for several parts or if ``multi``; rings are closed."""
    each = [struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(_ring, rings)) for rings in parts]
    return each[0] if len(each) == 1 and not multi else struct.pack("<BII", 1, 6, len(each)) + b"".join(each)


def from_line(points: np.ndarray) -> bytes:
    p = np.asarray(points, "<f8")
    return struct.pack("<BII", 1, 2, len(p)) + p.tobytes()
