"""Geometry from well-known binary, well-known text and nested coordinate lists, as (kind, parts) with parts of points."""

from __future__ import annotations

import re
import struct

Shape = tuple[str, list]


def from_wkb(data: bytes) -> Shape:
    """(kind, parts): points share one part, each line is a part, polygons give their rings in order. Z and M values are dropped."""
    shape, _ = _read(memoryview(bytes(data)), 0)
    return shape


def _read(data: memoryview, at: int) -> tuple[Shape, int]:
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    if code & 0x20000000:
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    base = code & 0xFFFF
    if base >= 1000:
        dims, base = {1: 3, 2: 3, 3: 4}[base // 1000], base % 1000

    def points(n: int, at: int) -> tuple[list, int]:
        flat = struct.unpack_from(f"{order}{n * dims}d", data, at)
        return [[flat[k], flat[k + 1]] for k in range(0, n * dims, dims)], at + 8 * n * dims

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if base == 1:
        p, at = points(1, at)
        return ("point", [p] if p[0][0] == p[0][0] else []), at
    if base == 2:
        n, at = count(at)
        p, at = points(n, at)
        return ("line", [p] if p else []), at
    if base == 3:
        rings, (n, at) = [], count(at)
        for _ in range(n):
            m, at = count(at)
            p, at = points(m, at)
            rings.append(p)
        return ("polygon", rings), at
    if base in (4, 5, 6, 7):
        parts, kinds, (n, at) = [], set(), count(at)
        for _ in range(n):
            (kind, inner), at = _read(data, at)
            kinds.add(kind)
            parts += inner
        kind = kinds.pop() if len(kinds) == 1 else {4: "point", 5: "line", 6: "polygon"}.get(base, "unknown")
        if kind == "point" and parts:
            parts = [[p for part in parts for p in part]]
        return (kind, parts), at
    raise ValueError(f"unknown geometry code {code}")


def from_geopackage(data: bytes) -> Shape | None:
    """The geometry behind a GeoPackage header; none if it is flagged empty."""
    data = bytes(data)
    if data[:2] != b"GP":
        return from_wkb(data)
    flags = data[3]
    if flags & 0x10:
        return None
    return from_wkb(data[8 + (0, 32, 48, 48, 64)[(flags >> 1) & 7] :])


_NUMBERS = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def from_wkt(text: str) -> Shape:
    found = re.match(r"(?i)\s*(?:SRID\s*=\s*\d+\s*;)?\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(?:ZM|Z|M)?\s*(EMPTY|\()", text or "")
    if not found:
        raise ValueError("no geometry text")
    kind = {"POINT": "point", "LINESTRING": "line", "POLYGON": "polygon"}[found.group(2).upper()]
    if found.group(3).upper() == "EMPTY":
        return kind, []
    body = text[found.end() - 1 :]
    if kind == "point":
        return kind, [[[float(v) for v in _NUMBERS.findall(p)[:2]] for p in body.split(",")]]
    return kind, [[[float(v) for v in _NUMBERS.findall(p)[:2]] for p in ring.split(",")] for ring in re.findall(r"\(([^()]*)\)", body)]


def from_geojson(kind: str, coordinates) -> Shape:
    name = kind.removeprefix("Multi")
    many = kind != name
    if name == "Point":
        return "point", [[p[:2] for p in (coordinates if many else [coordinates])]]
    if name == "LineString":
        return "line", [[p[:2] for p in line] for line in (coordinates if many else [coordinates])]
    if name == "Polygon":
        return "polygon", [[p[:2] for p in ring] for polygon in (coordinates if many else [coordinates]) for ring in polygon]
    raise ValueError(f"unknown geometry {kind}")


def to_world(parts: list) -> list:
    """Degrees to web-mercator world coordinates, 0 to 1."""
    import math

    def y(lat: float) -> float:
        if lat > 85.0511287798066:
            return -0.1
        if lat < -85.0511287798066:
            return 1.1
        s = math.sin(math.radians(lat))
        return 0.5 - math.log((1 + s) / (1 - s)) * 0.25 / math.pi

    return [[[(p[0] + 180) / 360, y(p[1])] for p in part] for part in parts]
