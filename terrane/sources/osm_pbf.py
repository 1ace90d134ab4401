"""OpenStreetMap PBF files: the driver reads only the blobs' headers, the executors read and decode the blobs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from terrane.kernels.mvt import _ints, _messages, unzigzag

SCHEMA = (
    "kind string, id bigint, lat double, lon double, tags map<string,string>, node_ids array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, "
    "version int, changeset bigint, user_id bigint, timestamp_s bigint, visible boolean"
)
MEMBER_TYPES = ("node", "way", "relation")


def blobs(path: str) -> list[tuple[str, int, int]]:
    """(type, offset, size) of every blob."""
    found, at = [], 0
    with open(path, "rb") as source:
        while head := source.read(4):
            size = struct.unpack(">I", head)[0]
            fields = {n: v for n, _, v in _messages(source.read(size))}
            found.append((fields[1].decode(), at + 4 + size, fields[3]))
            at += 4 + size + fields[3]
            source.seek(at)
    return found


def inflate(blob: bytes) -> bytes:
    fields = {n: v for n, _, v in _messages(blob)}
    if 1 in fields:
        return fields[1]
    if 3 in fields:
        return zlib.decompress(fields[3])
    raise ValueError("the blob's compression is not supported")


def header_bounds(path: str) -> tuple[float, float, float, float] | None:
    """(west, south, east, north) of the file's header, if it has one."""
    for kind, offset, size in blobs(path)[:1]:
        if kind == "OSMHeader":
            with open(path, "rb") as source:
                source.seek(offset)
                for n, _, v in _messages(inflate(source.read(size))):
                    if n == 1:
                        box = {k: unzigzag(w) / 1e9 for k, _, w in _messages(v)}
                        return box[1], box[4], box[2], box[3]
    return None


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += unzigzag(v)
        out.append(total)
    return out


def decode_block(data: bytes) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of one data block; negative ids are an error."""
    strings: list[str] = []
    groups, granularity, lat0, lon0, date_step = [], 100, 0, 0, 1000
    for n, _, v in _messages(data):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, _, s in _messages(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            granularity = v
        elif n == 18:
            date_step = v
        elif n == 19:
            lat0 = v
        elif n == 20:
            lon0 = v
    place = lambda base, v: (base + granularity * v) * 1e-9

    def info(raw: bytes | None) -> tuple:
        f = {n: v for n, _, v in _messages(raw)} if raw else {}
        return f.get(1), f.get(3), f.get(4), f[2] * date_step // 1000 if 2 in f else None, bool(f.get(6, 1))

    def checked(id_: int) -> int:
        if id_ < 0:
            raise ValueError(f"negative id {id_}")
        return id_

    for group in groups:
        for n, _, v in _messages(group):
            fields: dict[int, bytes | int] = {}
            for k, _, w in _messages(v):
                fields[k] = w
            if n == 1:
                tags = {strings[a]: strings[b] for a, b in zip(_ints(fields.get(2, b"")), _ints(fields.get(3, b"")))}
                yield ("node", checked(unzigzag(fields[1])), place(lat0, unzigzag(fields[8])), place(lon0, unzigzag(fields[9])), tags, None, None, *info(fields.get(4)))
            elif n == 2:
                ids, lats, lons = (_running(_ints(fields.get(k, b""))) for k in (1, 8, 9))
                flat = _ints(fields.get(10, b""))
                dense = {k: _ints(w) for k, w in ((k, w) for k, _, w in _messages(fields[5]))} if 5 in fields else {}
                versions, visible = dense.get(1), dense.get(6)
                times, sets, users = (_running(dense[k]) if k in dense else None for k in (2, 3, 4))
                at = 0
                for k, id_ in enumerate(ids):
                    tags = {}
                    while at < len(flat) and flat[at]:
                        tags[strings[flat[at]]] = strings[flat[at + 1]]
                        at += 2
                    at += 1
                    yield (
                        "node", checked(id_), place(lat0, lats[k]), place(lon0, lons[k]), tags, None, None, versions[k] if versions else None, sets[k] if sets else None, users[k] if users else None,
                        times[k] * date_step // 1000 if times else None, bool(visible[k]) if visible else True,
                    )
            elif n == 3:
                tags = {strings[a]: strings[b] for a, b in zip(_ints(fields.get(2, b"")), _ints(fields.get(3, b"")))}
                yield ("way", checked(fields[1]), None, None, tags, _running(_ints(fields.get(8, b""))), None, *info(fields.get(4)))
            elif n == 4:
                tags = {strings[a]: strings[b] for a, b in zip(_ints(fields.get(2, b"")), _ints(fields.get(3, b"")))}
                refs = zip(_ints(fields.get(10, b"")), _running(_ints(fields.get(9, b""))), _ints(fields.get(8, b"")))
                yield ("relation", checked(fields[1]), None, None, tags, None, [{"type": MEMBER_TYPES[t], "ref": ref, "role": strings[role]} for t, ref, role in refs], *info(fields.get(4)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All elements of a file that every executor can open, one task input per blob."""
    parts = [(path, offset, size) for kind, offset, size in blobs(path) if kind == "OSMData"]
    listed = spark.createDataFrame(parts, "path string, offset bigint, size bigint")
    names = [c.split()[0] for c in SCHEMA.replace("array<struct<type:string,ref:bigint,role:string>>", "x").split(", ")]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, offset, size in zip(frame["path"], frame["offset"], frame["size"]):
                with open(name, "rb") as source:
                    source.seek(offset)
                    rows = list(decode_block(inflate(source.read(size))))
                out = pd.DataFrame(rows, columns=names)
                for c in ("version", "changeset", "user_id", "timestamp_s"):
                    out[c] = out[c].astype("Int64")
                yield out

    return listed.repartition(max(1, min(len(parts), 4096))).mapInPandas(decode, SCHEMA)


def tables(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relation members) in the layout of the graph operators."""
    from pyspark.sql import functions as F

    nodes = elements.filter("kind = 'node'").select("id", "lat", "lon", "tags", "version", "visible")
    ways = elements.filter("kind = 'way'").select("id", "node_ids", "tags", "version", "visible")
    exploded = elements.filter("kind = 'relation'").select(F.col("id").alias("relation_id"), "tags", F.posexplode("members").alias("member_pos", "m"))
    return nodes, ways, exploded.select("relation_id", "tags", "member_pos", F.col("m.type").alias("member_type"), F.col("m.ref").alias("member_ref"), F.col("m.role").alias("role"))
