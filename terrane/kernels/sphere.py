"""Distances on the sphere and the lon/lat boxes that hold everything within a distance."""

from __future__ import annotations

import numpy as np

EARTH_RADIUS_M = 6371008.8


def haversine(lon1, lat1, lon2, lat2):
    """Great-circle metres between points in degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def reach(lon: np.ndarray, lat: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boxes around points: (row, x0, y0, x1, y1). A box over the antimeridian is given as two; near a pole it spans all longitudes."""
    r = metres / EARTH_RADIUS_M * (1 + 1e-9) + 1e-12
    dlat = np.degrees(r)
    polar = np.abs(lat) + dlat >= 90
    ratio = np.where(polar, 0.0, np.sin(r) / np.maximum(np.cos(np.radians(lat)), 1e-300))
    dlon = np.where(polar, 360.0, np.degrees(np.arcsin(np.clip(ratio, 0, 1))) + 1e-12)
    row = np.arange(len(lon))
    x0, x1, y0, y1 = lon - dlon, lon + dlon, lat - dlat, lat + dlat
    west, east = (x0 <= -180) & ~polar, (x1 >= 180) & ~polar
    return (
        np.concatenate([row, row[west], row[east]]),
        np.concatenate([x0, x0[west] + 360, x0[east] - 360]),
        np.concatenate([y0, y0[west], y0[east]]),
        np.concatenate([x1, x1[west] + 360, x1[east] - 360]),
        np.concatenate([y1, y1[west], y1[east]]),
    )
