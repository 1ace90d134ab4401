"""Connected components of points that lie close together, without making the pairs.

Method. The plane is cut into cells whose side is the distance / sqrt(8), so any two points of one cell or of touching cells are close enough, with
no test. Only the cells (bounds of their points, smallest and greatest key) are linked: by touching, or where the bounds alone tell that
all or no points of two cells are close. That is done tile by tile with a ring of cells around, with union-find inside; a tile has a fixed
number of cells, whatever the number of points. The few pairs of cells that stay open, and are not yet linked inside their tile, are
decided by a join of their points. The components of the cells are then those of the points.

Skew and size. Pairs grow with the square of the density, this does not: dense places have many points but no more cells. Points are
joined to their cells by key, and never gathered.

Defined results: rows without a key or a place are in no component; a row that repeats a key at its place counts once; a point with no other key close by is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.hierarchy import components
from terrane.session import durable, forget

#: Cells on a side of a tile, and how many cells away a point may still be close.
TILE, REACH = 32, 3
#: Up to so many open pairs of cells (48 bytes each) are broadcast, so that the points need not be shuffled for them.
FEW = 50_000
_OFFSETS = [(i, j) for i in range(REACH + 1) for j in range(-REACH, REACH + 1) if i > 0 or j > 0]
_LINKS = "kind string, a bigint, b bigint"


def _links(group: pd.DataFrame, tx: int, ty: int, distance: float) -> pd.DataFrame:
    """Links of the cells of a tile and its ring: sure ones as (cell, first cell linked to it), and open ones that start in the tile."""
    cx, cy, ids = (group[c].to_numpy() for c in ("cx", "cy", "cell"))
    x0, y0, x1, y1 = (group[c].to_numpy() for c in ("minx", "miny", "maxx", "maxy"))
    side = TILE + 2 * REACH
    at = np.full((side + 2 * REACH, side + 2 * REACH), -1)
    col, row = cx - tx * TILE + 2 * REACH, cy - ty * TILE + 2 * REACH
    at[col, row] = np.arange(len(ids))
    up = np.arange(len(ids))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    undecided = []
    for i, j in _OFFSETS:
        a = np.flatnonzero(at[col + i, row + j] >= 0)
        b = at[col[a] + i, row[a] + j]
        gap = lambda lo, hi: np.maximum(0, np.maximum(lo[b] - hi[a], lo[a] - hi[b]))
        far = lambda lo, hi: np.maximum(hi[b] - lo[a], hi[a] - lo[b])
        sure = far(x0, x1) ** 2 + far(y0, y1) ** 2 <= distance * distance
        sure |= max(abs(i), abs(j)) <= 1
        # a hair more than the distance, since the join has the last word
        open_ = ~sure & (gap(x0, x1) ** 2 + gap(y0, y1) ** 2 <= distance * distance * (1 + 1e-9))
        for p, q in zip(a[sure].tolist(), b[sure].tolist()):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
        undecided.append((a[open_], b[open_]))
    roots = np.array([root(k) for k in range(len(ids))], dtype=int)
    a, b = (np.concatenate(v) for v in zip(*undecided))
    own = (cx[a] // TILE == tx) & (cy[a] // TILE == ty) & (roots[a] != roots[b])
    moved = np.flatnonzero(roots != np.arange(len(ids)))
    sure = pd.DataFrame({"kind": "sure", "a": ids[moved], "b": ids[roots[moved]]})
    return pd.concat([sure, pd.DataFrame({"kind": "open", "a": ids[a[own]], "b": ids[b[own]]})])


def close_components(points: DataFrame, distance: float) -> DataFrame:
    """(node, component) of the points (key, lon, lat) that have another within ``distance``; component is the smallest key of it."""
    side = distance / math.sqrt(8) * (1 - 1e-9)
    cx, cy = F.floor(F.col("lon") / side).cast("bigint"), F.floor(F.col("lat") / side).cast("bigint")
    # the number of a cell: its column in the upper, its row in the lower half
    cell = F.shiftleft(cx, 32).bitwiseOR(cy.bitwiseAND(F.lit(0xFFFFFFFF)))
    placed = points.select("key", "lon", "lat").filter("key is not null and lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").withColumn("cell", cell)
    low, high = F.min("key").alias("low"), F.max("key").alias("high")
    cells = durable(placed.groupBy("cell").agg(low, high, F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy")))

    column, line = F.shiftright("cell", 32), F.shiftright(F.shiftleft("cell", 32), 32)
    ringed = cells.drop("low", "high").withColumns({"cx": column, "cy": line})
    over = lambda c: F.sequence(F.floor((c - REACH) / TILE), F.floor((c + REACH) / TILE))
    tiled = ringed.withColumn("tx", F.explode(over(F.col("cx")))).withColumn("ty", F.explode(over(F.col("cy"))))

    def links(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _links(group, int(key[0]), int(key[1]), distance)

    found = durable(tiled.groupBy("tx", "ty").applyInPandas(links, _LINKS))
    sure = found.filter("kind = 'sure'").select("a", "b")
    pairs = found.filter("kind = 'open'").select("a", "b")
    bounds = ["minx", "miny", "maxx", "maxy"]
    if few := pairs.count() <= FEW:
        pairs = F.broadcast(pairs)
    reach = distance * (1 + 1e-9)

    def near(one: str, other: str, x: str, y: str) -> DataFrame:
        """Of the points of one cell those that are near the bounds of the other."""
        open_ = pairs.join(cells.select(F.col("cell").alias(other), *bounds), other)
        met = placed.select(F.col("cell").alias(one), F.col("lon").alias(x), F.col("lat").alias(y)).join(F.broadcast(open_) if few else open_, one)
        return met.filter(F.col(x).between(F.col("minx") - reach, F.col("maxx") + reach) & F.col(y).between(F.col("miny") - reach, F.col("maxy") + reach)).select("a", "b", x, y)

    test = F.pow(F.col("lon") - F.col("x"), F.lit(2)) + F.pow(F.col("lat") - F.col("y"), F.lit(2)) <= distance * distance
    met = near("a", "b", "x", "y").join(near("b", "a", "lon", "lat"), ["a", "b"]).filter(test).groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b")
    linked = durable(sure.unionByName(met).select(F.col("a").alias("parent"), F.col("b").alias("child")))
    forget(found)

    own = cells.select("cell", "low", "high").join(components(linked).withColumnRenamed("node", "cell"), "cell", "left").filter("component is not null or low <> high")
    own = durable(own.select("cell", F.coalesce("component", "cell").alias("part"), "low"))
    least = own.groupBy("part").agg(F.min("low").alias("component"))
    labels = durable(own.join(least, "part").select("cell", "component"))
    for done in (own, cells, linked):
        forget(done)
    return placed.select("cell", "key").join(labels, "cell").select("cell", F.col("key").alias("node"), "component").dropDuplicates(["cell", "node"]).select("node", "component")
