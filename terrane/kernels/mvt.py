"""Mapbox vector tiles, version 2: encoding and decoding of whole tiles with a small protobuf writer."""

from __future__ import annotations

import gzip
import struct

import numpy as np

from terrane.kernels.geometry import nest
from terrane.sinks.archives import read_varint, varint

EXTENT = 4096
MOVE, LINE, CLOSE = 1, 2, 7
KINDS = {"point": 1, "line": 2, "polygon": 3}


def zigzag(v: int) -> int:
    return -2 * v - 1 if v < 0 else 2 * v


def unzigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def commands(kind: str, parts: list, scale: float = EXTENT / 256) -> list[int]:
    """Command integers of points, lines or rings in tile pixels; parts that shrink to nothing on the grid are left out."""
    out: list[int] = []
    cx = cy = 0
    if kind == "point":
        grid = np.floor(np.asarray(parts, dtype=float).reshape(-1, 2) * scale + 0.5).astype(int)
        out.append(MOVE | len(grid) << 3)
        for x, y in grid.tolist():
            out += [zigzag(x - cx), zigzag(y - cy)]
            cx, cy = x, y
        return out
    for part in parts:
        grid = np.floor(np.asarray(part, dtype=float) * scale + 0.5).astype(int)
        grid = grid[np.concatenate([[True], (np.diff(grid, axis=0) != 0).any(axis=1)])]
        if kind == "polygon" and len(grid) > 1 and (grid[0] == grid[-1]).all():
            grid = grid[:-1]
        if len(grid) < (2 if kind == "line" else 3):
            continue
        first, rest = grid[0].tolist(), grid[1:].tolist()
        out += [MOVE | 1 << 3, zigzag(first[0] - cx), zigzag(first[1] - cy), LINE | len(rest) << 3]
        cx, cy = first
        for x, y in rest:
            out += [zigzag(x - cx), zigzag(y - cy)]
            cx, cy = x, y
        if kind == "polygon":
            out.append(CLOSE | 1 << 3)
    return out


def packed_commands(kinds: np.ndarray, points: np.ndarray, offsets: np.ndarray, row: np.ndarray, scale: float = EXTENT / 256) -> list[bytes]:
    """``commands`` of many rows as packed bytes: row r has the parts k with row[k] == r, points[offsets[k]:offsets[k + 1]] each, and a number of ``KINDS``."""
    count = offsets[1:] - offsets[:-1]
    part = np.repeat(np.arange(len(count)), count)
    grid = np.floor(points * scale + 0.5).astype(np.int64)
    kind = kinds[row]
    first = np.ones(len(grid), dtype=bool)
    first[1:] = part[1:] != part[:-1]
    keep = first.copy()
    keep[1:] |= (grid[1:] != grid[:-1]).any(axis=1)
    keep |= kind[part] == KINDS["point"]
    grid, part = grid[keep], part[keep]
    count = np.bincount(part, minlength=len(count))
    start = np.cumsum(count) - count
    some = np.flatnonzero((kind == KINDS["polygon"]) & (count > 1))
    shut = some[(grid[start[some]] == grid[start[some] + count[some] - 1]).all(axis=1)]
    keep = np.ones(len(grid), dtype=bool)
    keep[start[shut] + count[shut] - 1] = False
    count[shut] -= 1
    fine = count >= np.array([0, 1, 2, 3])[kind]
    keep &= fine[part]
    grid, part = grid[keep], part[keep]
    count = np.where(fine, count, 0)
    rank = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    before = np.zeros_like(grid)
    before[1:] = np.where((row[part[1:]] == row[part[:-1]])[:, None], grid[:-1], 0)
    steps = grid - before
    steps = np.where(steps < 0, -2 * steps - 1, 2 * steps)
    point = kind == KINDS["point"]
    size = np.where(count > 0, 1 + 2 * count + np.where(point, 0, 1) + (kind == KINDS["polygon"]), 0)
    ends = np.cumsum(size)
    start = ends - size
    ints = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    at = start[part] + 1 + 2 * rank + np.where(point[part] | (rank == 0), 0, 1)
    ints[at], ints[at + 1] = steps[:, 0], steps[:, 1]
    used = count > 0
    ints[start[used]] = MOVE | np.where(point[used], count[used], 1) << 3
    drawn = used & ~point
    ints[start[drawn] + 3] = LINE | (count[drawn] - 1) << 3
    ints[ends[used & (kind == KINDS["polygon"])] - 1] = CLOSE | 1 << 3
    raw, at = varints(ints)
    bounds = at[np.concatenate([[0], ends]).astype(np.int64)[np.searchsorted(row, np.arange(len(kinds) + 1))]].tolist()
    return [raw[a:z] for a, z in zip(bounds, bounds[1:])]


def varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Varints of numbers that are not negative, and where each one starts (and the last one ends)."""
    sizes = np.ones(len(values), dtype=np.int64)
    top = int(values.max()) if len(values) else 0
    widest = max(1, -(-top.bit_length() // 7))
    for k in range(1, widest):
        sizes += values >= 1 << 7 * k
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.empty(int(at[-1]), dtype=np.uint8)
    for k in range(widest):
        some = sizes > k
        out[at[:-1][some] + k] = (values[some] >> 7 * k & 127) | np.where(sizes[some] > k + 1, 128, 0)
    return out.tobytes(), at


def parts_of(kind: str, ints: list[int], scale: float = EXTENT / 256) -> list:
    """The inverse: points, lines, or polygons (rings nested by their winding, clockwise in the tile's y-down plane for outer rings)."""
    parts, run, cx, cy, k = [], [], 0, 0, 0
    while k < len(ints):
        op, times = ints[k] & 7, ints[k] >> 3
        k += 1
        if op == CLOSE:
            run.append(run[0])
            continue
        for _ in range(times):
            cx, cy = cx + unzigzag(ints[k]), cy + unzigzag(ints[k + 1])
            k += 2
            if op == MOVE and run and kind != "point":
                parts.append(run)
                run = []
            run.append((cx / scale, cy / scale))
    if run:
        parts.append(run)
    if kind == "point":
        return [p for part in parts for p in part]
    arrays = [np.array(p) for p in parts]
    return nest(arrays) if kind == "polygon" else arrays


def _value(v) -> bytes:
    if isinstance(v, bool):
        return b"\x38" + varint(int(v))
    if isinstance(v, int):
        return b"\x30" + varint(zigzag(v))
    if isinstance(v, float):
        return b"\x19" + struct.pack("<d", v)
    raw = str(v).encode()
    return b"\x0a" + varint(len(raw)) + raw


def _field(number: int, raw: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def _packed(values: list[int]) -> bytes:
    return b"".join(map(varint, values))


def encode(layers: dict[str, list[dict]], ids: bool = True) -> bytes:
    """A tile of layers of features {id, kind, commands, attrs}; null attributes and the id 0 are left out, features without commands too."""
    return b"".join(layer(name, ((f.get("id") if ids else 0, KINDS[f["kind"]], _packed(f["commands"]), f["attrs"]) for f in layers[name])) for name in sorted(layers))


def layer(name: str, features) -> bytes:
    """A layer of features (id, number of the kind, packed commands, attributes); nothing if no feature has commands."""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    body = []
    for id_, kind, commands_, attrs in features:
        if not commands_:
            continue
        tags = []
        for key, value in attrs.items():
            if value is not None:
                tags += [keys.setdefault(key, len(keys)), values.setdefault((type(value).__name__, value), len(values))]
        raw = b""
        if id_:
            raw += b"\x08" + varint(id_)
        if tags:
            raw += _field(2, _packed(tags))
        body.append(_field(2, raw + b"\x18" + varint(kind) + _field(4, commands_)))
    if not body:
        return b""
    made = b"\x78\x02" + _field(1, name.encode()) + b"".join(body)
    made += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values) + b"\x28" + varint(EXTENT)
    return _field(3, made)


def _messages(data: bytes):
    at = 0
    while at < len(data):
        head, at = read_varint(data, at)
        number, wire = head >> 3, head & 7
        if wire == 0:
            value, at = read_varint(data, at)
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
        yield number, wire, value


def _ints(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = read_varint(data, at)
        out.append(v)
    return out


def _read_value(data: bytes):
    for number, _, v in _messages(data):
        if number == 1:
            return v.decode()
        if number == 2:
            return struct.unpack("<f", v)[0]
        if number == 3:
            return struct.unpack("<d", v)[0]
        if number in (4, 5):
            return v
        if number == 6:
            return unzigzag(v)
        if number == 7:
            return bool(v)
    return None


def decode(data: bytes) -> dict[str, list[dict]]:
    """Layers of features {id, kind, commands, attrs}; gzip is recognised."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    kinds = {v: k for k, v in KINDS.items()}
    out: dict[str, list[dict]] = {}
    for number, _, layer in _messages(data):
        if number != 3:
            continue
        name, features, keys, values = "", [], [], []
        for n, _, v in _messages(layer):
            if n == 1:
                name = v.decode()
            elif n == 2:
                features.append(v)
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                values.append(_read_value(v))
        rows = []
        for raw in features:
            f = {"id": 0, "kind": "point", "commands": [], "attrs": {}}
            tags: list[int] = []
            for n, _, v in _messages(raw):
                if n == 1:
                    f["id"] = v
                elif n == 2:
                    tags = _ints(v)
                elif n == 3:
                    f["kind"] = kinds.get(v, "point")
                elif n == 4:
                    f["commands"] = _ints(v)
            f["attrs"] = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}
            rows.append(f)
        out[name] = rows
    return out


def compressed(data: bytes, how: str = "gzip") -> bytes:
    """Compressed without a time stamp, so equal tiles stay equal."""
    return gzip.compress(data, mtime=0) if how == "gzip" else data
