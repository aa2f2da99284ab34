"""Convex hulls per group (SP10, AG11 hull area, AG12 hull boundary).

Three levels, so no group is ever collected whole into one task: first every
input partition is reduced, Arrow batch by Arrow batch, to the hull vertices
of each key it holds (``mapInPandas`` - a map-side combine, raw points are
never shuffled; what it holds is flushed at ``MOST_KEYS`` keys); then the vertices of a key
are reduced again in salted groups of partitions, so that a key held by very many
partitions spreads over tasks, and the few vertices left are joined to the hull of
hulls (``applyInPandas``).  A hull of hulls is the hull of the whole set, so the
result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose running hulls a task holds at once, and salts of the middle level.
MOST_KEYS, SALTS = 50_000, 64

# WGS84: semi-major axis and flattening.
_A, _F = 6378137.0, 1 / 298.257223563


def _drop_interior(pts: np.ndarray) -> np.ndarray:
    """Akl-Toussaint filter: drop the points strictly inside the polygon of the
    extreme points in eight directions (vectorised), leaving the hull candidates."""
    if len(pts) < 32:
        return pts
    ang = np.arange(8) * (np.pi / 4)
    proj = pts @ np.vstack([np.cos(ang), np.sin(ang)])          # (n, 8) projections
    ext = pts[np.argmax(proj, axis=0)]                          # extremes, counter-clockwise
    keep_rows = np.r_[True, np.any(ext[1:] != ext[:-1], axis=1)]
    ext = ext[keep_rows]
    if len(ext) >= 2 and np.all(ext[0] == ext[-1]):
        ext = ext[:-1]
    if len(ext) < 3:
        return pts
    a, b = ext, np.roll(ext, -1, axis=0)
    cross = ((b[:, 0] - a[:, 0])[None, :] * (pts[:, 1:2] - a[:, 1][None, :])
             - (b[:, 1] - a[:, 1])[None, :] * (pts[:, 0:1] - a[:, 0][None, :]))
    inside = np.all(cross > 0, axis=1)
    return pts[~inside]


def _hull_xy(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Andrew's monotone chain; counter-clockwise vertices, no repeated endpoint.
    Points strictly inside the extreme-point octagon are dropped first, so the
    chain (a Python loop) only walks the few candidates near the hull."""
    pts = np.unique(np.column_stack([x, y]), axis=0)
    pts = _drop_interior(pts)
    if len(pts) <= 2:
        return pts[:, 0], pts[:, 1]

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    lower: list = []
    for p in pts:
        while len(lower) >= 2 and cross(lower[-2], lower[-1], p) <= 0:
            lower.pop()
        lower.append(p)
    upper: list = []
    for p in pts[::-1]:
        while len(upper) >= 2 and cross(upper[-2], upper[-1], p) <= 0:
            upper.pop()
        upper.append(p)
    h = np.array(lower[:-1] + upper[:-1])
    return h[:, 0], h[:, 1]


def _partial(key_cols: list[str]):
    def fn(batches):
        running: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(key_cols, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                prev = running.get(key)
                x, y = g["x"].to_numpy(), g["y"].to_numpy()
                if prev is not None:
                    x, y = np.concatenate([prev[0], x]), np.concatenate([prev[1], y])
                running[key] = _hull_xy(x, y)
            if len(running) > MOST_KEYS:
                yield from rows(running)
                running = {}
        yield from rows(running)

    def rows(running: dict):
        for key, (hx, hy) in running.items():
            out = pd.DataFrame({"x": hx, "y": hy})
            for k, v in zip(key_cols, key):
                out[k] = v
            yield out[key_cols + ["x", "y"]]
    return fn


def _middle(key_cols: list[str]):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        hx, hy = _hull_xy(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(hx) for k in key_cols}, "x": hx, "y": hy})
    return fn


def _final(key_cols: list[str]):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        hx, hy = _hull_xy(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        row = {k: pdf[k].iloc[0] for k in key_cols}
        row["hull_x"] = [hx.tolist()]
        row["hull_y"] = [hy.tolist()]
        row["hull_vertices"] = len(hx)
        row["hull_area_m2"] = _spheroid_area(hx, hy) if len(hx) >= 3 else 0.0
        return pd.DataFrame({k: [v] if not isinstance(v, list) else v for k, v in row.items()})
    return fn


def _q(sin_lat: np.ndarray) -> np.ndarray:
    """Area function of the spheroid: the zone from the equator to a latitude, over pi a^2."""
    e2 = _F * (2 - _F)
    e = np.sqrt(e2)
    return (1 - e2) * (sin_lat / (1 - e2 * sin_lat ** 2) - np.log((1 - e * sin_lat) / (1 + e * sin_lat)) / (2 * e))


def _spheroid_area(lon: np.ndarray, lat: np.ndarray) -> float:
    """Area (m^2) of a lon/lat ring on the WGS84 spheroid: each edge's strip to the equator, with the
    spheroid's area function at its ends (authalic latitudes)."""
    lo = np.radians(np.append(lon, lon[0]))
    q = _q(np.sin(np.radians(np.append(lat, lat[0]))))
    return float(abs(np.sum((lo[1:] - lo[:-1]) * (q[:-1] + q[1:]))) * _A ** 2 / 4)


def convex_hulls(df: DataFrame, keys: list[str], x: str = "lon", y: str = "lat") -> DataFrame:
    """Per group of ``keys``: hull vertex lists (``hull_x``, ``hull_y``, counter-clockwise),
    vertex count and area in m^2.  Rows without coordinates are ignored."""
    pts = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
             .select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    key_types = {f.name: f.dataType.simpleString() for f in pts.schema.fields}
    ks = ", ".join(f"{k} {key_types[k]}" for k in keys)
    part = pts.mapInPandas(_partial(keys), f"{ks}, x double, y double")
    salted = part.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = salted.groupBy(*keys, "_salt").applyInPandas(_middle(keys), f"{ks}, x double, y double")
    return part.groupBy(*keys).applyInPandas(
        _final(keys), f"{ks}, hull_x array<double>, hull_y array<double>, hull_vertices int, hull_area_m2 double")


def hull_geojson(hulls: DataFrame, digits: int = 9) -> DataFrame:
    """AG12: the hull boundary as GeoJSON Polygon text (closed ring)."""
    ring = F.transform(F.arrays_zip("hull_x", "hull_y"), lambda p: F.array(F.round(p["hull_x"], digits),
                                                                          F.round(p["hull_y"], digits)))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return hulls.withColumn("geojson", F.to_json(F.struct(F.lit("Polygon").alias("type"),
                                                          F.array(closed).alias("coordinates"))))
