import gzip
import json
import os
import sqlite3
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.kernels import wkb
from terrane.kernels.mvt import zigzag
from terrane.operators.render import FEATURE, RenderOptions, decode_tiles, encode_tiles, label_limited, merged, render
from terrane.sinks import archives
from terrane.sinks.archives import varint
from terrane.sources import catalog, files, osm_pbf


def field(n, raw):
    return varint(n << 3 | 2) + varint(len(raw)) + raw


def packed(values):
    return b"".join(map(varint, values))


def deltas(values):
    return packed([zigzag(b - a) for a, b in zip([0, *values], values)])


def pbf(path, compress=True):
    strings = [b"", b"amenity", b"cafe", b"highway", b"path", b"outer", b"type", b"multipolygon"]
    table = field(1, b"".join(field(1, s) for s in strings))
    dense = field(1, deltas([1, 2, 9])) + field(8, deltas([482000000, 482000010, -5])) + field(9, deltas([163000000, 0, 7])) + field(10, packed([1, 2, 0, 0, 0])) + field(5, field(1, packed([3, 1, 1])))
    way = b"\x08" + varint(5) + field(2, packed([3])) + field(3, packed([4])) + field(8, deltas([1, 2, 1]))
    relation = b"\x08" + varint(6) + field(2, packed([6])) + field(3, packed([7])) + field(8, packed([5])) + field(9, deltas([5])) + field(10, packed([1]))
    block = table + field(2, field(2, dense)) + field(2, field(3, way)) + field(2, field(4, relation))
    box = b"".join(varint(k << 3) + varint(zigzag(v)) for k, v in ((1, -10**9), (2, 2 * 10**9), (3, 3 * 10**9), (4, -4 * 10**9)))
    with open(path, "wb") as out:
        for kind, data in ((b"OSMHeader", field(1, box)), (b"OSMData", block)):
            blob = b"\x10" + varint(len(data)) + field(3, zlib.compress(data)) if compress else field(1, data)
            header = field(1, kind) + b"\x18" + varint(len(blob))
            out.write(struct.pack(">I", len(header)) + header + blob)


@pytest.mark.parametrize("compress", [True, False])
def test_pbf(spark, tmp_path, compress):
    path = str(tmp_path / "x.osm.pbf")
    pbf(path, compress)
    assert osm_pbf.header_bounds(path) == (-1, -4, 2, 3)
    rows = {(r["kind"], r["id"]): r for r in osm_pbf.read(spark, path).collect()}
    assert set(rows) == {("node", 1), ("node", 2), ("node", 9), ("way", 5), ("relation", 6)}
    node = rows["node", 1]
    assert abs(node["lat"] - 48.2) < 1e-9 and abs(node["lon"] - 16.3) < 1e-9 and node["tags"] == {"amenity": "cafe"} and node["version"] == 3
    assert rows["way", 5]["node_ids"] == [1, 2, 1] and rows["way", 5]["tags"] == {"highway": "path"}
    assert [tuple(m) for m in rows["relation", 6]["members"]] == [("way", 5, "outer")]
    nodes, ways, members = osm_pbf.tables(osm_pbf.read(spark, path))
    assert (nodes.count(), ways.count(), members.first()["member_ref"]) == (3, 1, 5)


def wkb_of(kind, parts):
    points = lambda ps: b"".join(struct.pack("<2d", *p) for p in ps)
    if kind == 1:
        return struct.pack("<BI", 1, 1) + points(parts[0])
    if kind == 2:
        return struct.pack("<BII", 1, 2, len(parts[0])) + points(parts[0])
    return struct.pack("<BII", 1, 3, len(parts)) + b"".join(struct.pack("<I", len(r)) + points(r) for r in parts)


def test_geometry_readers():
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    assert wkb.from_wkb(wkb_of(3, [ring])) == ("polygon", [ring])
    multi = struct.pack("<BII", 1, 4, 2) + wkb_of(1, [[[1, 2]]]) + wkb_of(1, [[[3, 4]]])
    assert wkb.from_wkb(multi) == ("point", [[[1, 2], [3, 4]]])
    mixed = struct.pack("<BII", 1, 7, 2) + wkb_of(1, [[[1, 2]]]) + wkb_of(2, [ring])
    assert wkb.from_wkb(mixed)[0] == "unknown"
    assert wkb.from_wkb(struct.pack(">BI3d", 0, 1001, 1, 2, 9)) == ("point", [[[1, 2]]])
    assert wkb.from_wkt("LINESTRING Z (1 2 3, 4 5 6)") == ("line", [[[1, 2], [4, 5]]]) and wkb.from_wkt("POLYGON EMPTY") == ("polygon", [])
    assert wkb.from_geojson("MultiPolygon", [[ring], [ring]]) == ("polygon", [ring, ring])
    assert wkb.to_world([[[0, 0], [180, 90]]]) == [[[0.5, 0.5], [1.0, -0.1]]]
    with pytest.raises(ValueError):
        wkb.from_wkt("CIRCLE (1)")


def test_sqlite_sources(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('stations', 'geom', 4326), ('metres', 'geom', 3857)")
    head = b"GP\x00\x01" + struct.pack("<i", 4326)
    for table in ("stations", "metres"):
        db.execute(f"CREATE TABLE {table} (fid INTEGER PRIMARY KEY, name TEXT, height REAL, geom BLOB)")
    db.executemany("INSERT INTO stations VALUES (?, ?, ?, ?)", [(1, "a", 2.0, head + wkb_of(1, [[[1, 2]]])), (2, None, None, head + wkb_of(1, [[[50, 60]]])), (3, "c", 1.5, None), (4, "d", 1.5, b"GP\x00\x11" + struct.pack("<i", 4326))])
    db.execute("INSERT INTO metres VALUES (1, 'm', 1, ?)", (head + wkb_of(1, [[[20037508.342789244 / 2, 0]]]),))
    db.commit()
    db.close()
    rows = {(r["source_layer"], r["id"]): r for r in files.geopackage(spark, path).collect()}
    assert set(rows) == {("stations", 1), ("stations", 2), ("metres", 1)}
    assert rows["stations", 1]["tags"] == {"fid": "1", "name": "a", "height": "2"} and abs(rows["metres", 1]["shape"][0][0][0] - 90) < 1e-9
    assert [r["id"] for r in files.geopackage(spark, path, "stations", (0, 0, 10, 10)).collect()] == [1]
    ne = str(tmp_path / "ne.sqlite")
    db = sqlite3.connect(ne)
    db.execute("CREATE TABLE ne_points (ogc_fid INTEGER PRIMARY KEY, elevation REAL, GEOMETRY BLOB)")
    db.executemany("INSERT INTO ne_points VALUES (?, ?, ?)", [(1, 7.5, wkb_of(1, [[[3, 4]]])), (2, 1.0, None)])
    db.execute("CREATE TABLE other (x)")
    db.commit()
    db.close()
    assert [(r["source_layer"], r["tags"]["elevation"]) for r in files.features(spark, "natural_earth", ne).collect()] == [("ne_points", "7.5")]


def test_shapefile(spark, tmp_path):
    base = str(tmp_path / "areas")
    records = [struct.pack("<i2d", 1, 1.0, 2.0), struct.pack("<i4diii", 5, 0, 0, 1, 1, 1, 4, 0) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0), struct.pack("<i", 0)]
    shp, shx, at = b"", b"", 50
    for k, r in enumerate(records):
        shp += struct.pack(">ii", k + 1, len(r) // 2) + r
        shx += struct.pack(">ii", at, len(r) // 2)
        at += 4 + len(r) // 2
    open(base + ".shp", "wb").write(bytes(100) + shp)
    open(base + ".shx", "wb").write(bytes(100) + shx)
    column = lambda name, kind, size: name.ljust(11, b"\0") + kind + bytes(4) + bytes([size]) + bytes(15)
    head = struct.pack("<4BIHH", 3, 0, 0, 0, 3, 32 + 64 + 1, 1 + 6 + 4) + bytes(20) + column(b"name", b"C", 6) + column(b"n", b"N", 4) + b"\r"
    open(base + ".dbf", "wb").write(head + b" alpha    7" + b" beta     8" + b" gone      ")
    rows = files.shapefile(spark, base + ".shp").orderBy("id").collect()
    assert [(r["id"], r["geom_type"], r["tags"]) for r in rows] == [(1, "point", {"name": "alpha", "n": "7"}), (2, "polygon", {"name": "beta", "n": "8"})]
    assert files.shapefile(spark, base + ".shp", (1.5, 0, 3, 3)).count() == 0
    with pytest.raises(ValueError):
        files.shapefile(spark, base + ".shp", projection="EPSG:2056")


def test_geojson_and_poly(spark, tmp_path):
    feature = lambda k, g: {"type": "Feature", "id": k, "geometry": g, "properties": {"name": f"n{k}", "v": 1.5, "list": [1]}}
    items = [feature(1, {"type": "Point", "coordinates": [102, 0.5]}), feature(2, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}), {"type": "Feature", "geometry": None}, feature(4, {"type": "Oval", "coordinates": []})]
    whole, lines, one = (str(tmp_path / n) for n in ("fc.geojson", "nl.geojson", "one.geojson"))
    open(whole, "w").write(json.dumps({"type": "FeatureCollection", "features": items}, indent=1))
    open(lines, "w").write("\n".join(map(json.dumps, items)) + "\n{broken\n\n")
    open(one, "w").write(json.dumps(items[0]))
    for path, n in ((whole, 2), (lines, 2), (one, 1)):
        rows = files.geojson(spark, path).orderBy("id").collect()
        assert [r["id"] for r in rows] == [1, 2][:n] and rows[0]["tags"] == {"name": "n1", "v": "1.5", "list": "[1]"}
    poly = str(tmp_path / "x.poly")
    open(poly, "w").write("name\nsection\n  0 0\n  10 0\n  10 10\n  0 0\nEND\n!hole\n  1 1\n  2 1\n  2 2\nEND\nEND\n")
    assert [[len(r) for r in p] for p in files.poly_file(poly)] == [[4, 3]]


def sample_features(spark):
    rows = [("place", k, "point", [[[(k % 10 + 0.5) / 20, (k // 10 + 0.5) / 20]]], 0, 3, k, {"name": f"n{k}"}) for k in range(1, 60)]
    rows += [("area", 1001, "polygon", [[[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9], [0.1, 0.1]]], 0, 4, 0, {"kind": "x"})]
    rows += [("road", 2000 + k, "line", [[[k / 10, 0.5], [(k + 1) / 10, 0.5]]], 2, 3, 0, {"kind": "r"}) for k in range(8)]
    rows += [("road", 3000, "line", None, 0, 3, 0, {}), ("road", 3001, "line", [[[0.1, 0.1]]], 0, 3, 0, {}), ("area", 3002, "polygon", [[[0.1, 0.1], [0.1, 0.1], [0.1, 0.1], [0.1, 0.1]]], 0, 3, 0, None)]
    return spark.createDataFrame(rows, FEATURE)


def test_render_encode_decode(spark):
    made = render(sample_features(spark))
    counts = {(r["layer"], r["z"]): r["n"] for r in made.groupBy("layer", "z").agg(F.count_distinct("id").alias("n")).collect()}
    assert counts["place", 0] == 59 and counts["road", 2] == 8 and ("road", 0) not in counts and counts["area", 4] == 1
    assert made.filter("layer = 'area' and z = 4 and filled").count() > 50
    tiles = encode_tiles(made)
    back = decode_tiles(tiles)
    want = {tuple(r) for r in made.select("z", "x", "y", "layer", "id").distinct().collect()}
    assert {tuple(r) for r in back.select("z", "x", "y", "layer", "id").collect()} == want
    assert encode_tiles(made, skip_filled=True).count() < tiles.count()
    one = encode_tiles(made.repartition(1)).orderBy("z", "x", "y").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in encode_tiles(made.repartition(7)).orderBy("z", "x", "y").collect()]


def test_label_grid_and_merge(spark):
    options = RenderOptions(grid_px=128, grid_limit=2, buffer=0)
    limited = label_limited(render(sample_features(spark), options), options)
    top = limited.filter("layer = 'place' and z = 0").groupBy("cell").count().collect()
    assert all(r["count"] <= 2 for r in top)
    joined = merged(render(sample_features(spark), RenderOptions(buffer=0)), {"road": {}})
    rows = joined.filter("layer = 'road' and z = 2").collect()
    assert len(rows) == 4 and all(len(r["ends"]) == 1 for r in rows) and {r["id"] for r in rows} <= {2000, 2002, 2005, 2007, 2003}
    two = spark.createDataFrame([("area", k, "polygon", [[[x, 0.2], [x + 0.3, 0.2], [x + 0.3, 0.6], [x, 0.6], [x, 0.2]]], 0, 0, 0, {"a": "b"}) for k, x in ((11, 0.1), (12, 0.3))], FEATURE)
    whole = merged(render(two, RenderOptions(buffer=0)), {"area": {"min_area": 1.0}}).collect()
    assert len(whole) == 1 and whole[0]["id"] == 10


def small_tiles(spark):
    rows = [(z, x, y, bytes([65 + (x + y) % 3]) * 5) for z in (0, 2) for x in range(1 << z) for y in range(1 << z)]
    return spark.createDataFrame(rows, "z int, x int, y int, data binary"), {r[:3]: r[3] for r in rows}


@pytest.mark.parametrize("name,options", [("a.mbtiles", {}), ("a.pmtiles", {}), ("tree", {})])
def test_archives_round_trip(spark, tmp_path, name, options):
    tiles, want = small_tiles(spark)
    path = str(tmp_path / name)
    archives.write(tiles, path, {"name": "sample"})
    assert {(r["z"], r["x"], r["y"]): bytes(r["data"]) for r in files.archive(spark, path).collect()} == want


def test_compact_mbtiles_and_pmtiles_layout(spark, tmp_path):
    tiles, want = small_tiles(spark)
    path = str(tmp_path / "c.mbtiles")
    archives.write_mbtiles(tiles, path, {"name": "x"}, deduplicate=True)
    db = sqlite3.connect(path)
    assert db.execute("SELECT count(*), (SELECT count(*) FROM tiles_data) FROM tiles").fetchone() == (17, 3)
    assert db.execute("SELECT tile_data FROM tiles WHERE zoom_level = 2 AND tile_column = 0 AND tile_row = 3").fetchone()[0] == want[2, 0, 0]
    db.close()
    assert {(r["z"], r["x"], r["y"]): bytes(r["data"]) for r in files.mbtiles(spark, path).collect()} == want
    pm = str(tmp_path / "c.pmtiles")
    archives.write_pmtiles(tiles, pm, {"name": "x"})
    head = files.pmtiles_header(pm)
    assert (head["magic"], head["version"], head["n_addressed"], head["n_contents"], head["data_size"]) == (b"PMTiles", 3, 17, 3, 15)
    entries = [(0, 1, 5, 0), (1, 0, 9, 9), (7, 3, 5, 5)]
    assert archives.parse_directory(archives.directory_bytes(entries)) == entries
    assert {files.hilbert_tile(r["tile_id"]) for r in archives.in_tile_order(tiles, "hilbert").collect()} == set(want)


def test_text_and_stream_sinks(spark, tmp_path):
    tiles, want = small_tiles(spark)
    archives.write(tiles, str(tmp_path / "t.csv"), {})
    assert spark.read.csv(str(tmp_path / "t.csv")).count() == 17
    archives.write(tiles, str(tmp_path / "t.json"), {"name": "n"})
    kinds = [json.loads(r["value"])["type"] for r in spark.read.text(str(tmp_path / "t.json")).collect()]
    assert sorted(set(kinds)) == ["finish", "initialization", "tile"] and kinds.count("tile") == 17
    assert archives.write_messages(tiles, str(tmp_path / "pb")) == 17
    size = sum(os.path.getsize(tmp_path / "pb" / f) for f in os.listdir(tmp_path / "pb"))
    assert size == sum(len(archives.delimited_message(*k, v)) for k, v in want.items())
    with pytest.raises(ValueError):
        archives.write(tiles, "x", kind="nope")
    archives.write_layer_stats(tiles.select("z", "x", "y"), str(tmp_path / "s"))
    part = next(f for f in os.listdir(tmp_path / "s") if f.endswith(".gz"))
    assert gzip.open(tmp_path / "s" / part, "rt").readline() == "z\tx\ty\n"
    layers = spark.createDataFrame([("b", {"x": "String"}, 0, 14), ("a", None, 3, 5)], "id string, fields map<string,string>, minzoom int, maxzoom int")
    meta = archives.archive_metadata("m", (-1, -2, 3, 4), layers, attribution="me")
    assert [x["id"] for x in meta["vector_layers"]] == ["a", "b"] and meta["attribution"] == "me" and meta["center"] == "1,1,0"


def test_catalogue(spark, tmp_path):
    for name, node in {
        "catalog.json": {"links": [{"rel": "child", "href": "t.json"}, {"rel": "child", "href": "u.json"}]}, "t.json": {"id": "places", "links": [{"rel": "child", "href": "k.json"}]}, "u.json": {"id": "other", "assets": {"a": {"href": "no.parquet"}}},
        "k.json": {"id": "place", "links": [{"rel": "item", "href": "i1.json"}, {"rel": "item", "href": "i2.json"}]}, "i1.json": {"bbox": [0, 0, 1, 1], "assets": {"a": {"href": "one.parquet"}}}, "i2.json": {"bbox": [50, 0, 51, 1], "assets": {"a": {"href": "two.parquet"}}},
    }.items():
        (tmp_path / name).write_text(json.dumps(node))
    found = catalog.catalog_items(str(tmp_path / "catalog.json"), "places", "place", (0, 0, 10, 10))
    assert [os.path.basename(p) for p in found] == ["one.parquet"]
    assert catalog.hive_fields("/a/theme=x/type=y/z.parquet") == {"theme": "x", "type": "y"}
    df = spark.createDataFrame([(1, (0.0, 1.0, 0.0, 1.0)), (2, (50.0, 51.0, 0.0, 1.0))], "id bigint, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    df.write.parquet(str(tmp_path / "d/type=007"))
    read = catalog.read_parquet(spark, str(tmp_path / "d"), (0, 0, 10, 10), "type").collect()
    assert [(r["id"], r["type"], r["source_layer"]) for r in read] == [(1, "007", "007")]
    one = next(str(p) for p in (tmp_path / "d/type=007").iterdir() if p.suffix == ".parquet")
    assert catalog.geo_metadata(one)["columns"] == {} and catalog.files_in_bounds([one], (0, 0, 1, 1)) == [one]
    assert geo.LENGTH_UNITS["z0_px"] == 0.00390625
