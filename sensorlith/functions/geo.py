"""Distances on the ground and polyline checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: earth radius in metres.
EARTH_RADIUS_M = 6_371_000.0

POINTS = T.ArrayType(
    T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
)


@dataclass(frozen=True)
class Box:
    """Accepted area and spans of a polyline, in degrees."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    lat_span: float
    lon_span: float
    jump_m: float | None = None


# The wide box of the fused map and the strict one of the operational map.
WIDE_BOX = Box(40.45, 40.95, -74.35, -73.55, 0.35, 0.55)
STRICT_BOX = Box(40.45, 41.00, -74.35, -73.45, 0.25, 0.35, 12_000.0)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def local_xy_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of (lat0, lon0) on a flat earth."""
    x = EARTH_RADIUS_M * (F.radians(lon) - F.radians(lon0)) * F.cos(F.radians(lat0))
    y = EARTH_RADIUS_M * (F.radians(lat) - F.radians(lat0))
    return x, y


def origin_to_segment_m(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from (0, 0) to the segment a–b; a segment without length is a point."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    along = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / squared))).otherwise(0.0)
    return F.hypot(ax + along * dx, ay + along * dy)


def parse_points(text: Column) -> Column:
    """ "lat,lon lat,lon …" to points; tokens that are no pair of numbers are left out."""
    pairs = F.transform(
        F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"),
        lambda token: F.struct(
            F.substring_index(token, ",", 1).try_cast("double").alias("lat"),
            F.when(F.instr(token, ",") > 0, F.regexp_replace(token, r"^[^,]*,", "")).try_cast("double").alias("lon"),
        ),
    )
    return F.filter(pairs, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def usable_polyline(points: Column, box: Box) -> Column:
    """At least two points, all in the box, spans and jumps within the limits."""
    lats = F.transform(points, lambda p: p["lat"])
    lons = F.transform(points, lambda p: p["lon"])
    ok = (
        (F.size(points) >= 2)
        & (F.array_min(lats) >= box.lat_min)
        & (F.array_max(lats) <= box.lat_max)
        & (F.array_min(lons) >= box.lon_min)
        & (F.array_max(lons) <= box.lon_max)
        & (F.array_max(lats) - F.array_min(lats) <= box.lat_span)
        & (F.array_max(lons) - F.array_min(lons) <= box.lon_span)
    )
    if box.jump_m is not None:
        steps = F.arrays_zip(
            F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"),
            F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"),
        )
        ok = ok & F.forall(
            steps,
            lambda s: haversine_m(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]) <= box.jump_m,
        )
    return F.coalesce(ok, F.lit(False))


def choose_polyline(candidates: dict[str, Column], box: Box) -> Column:
    """(source, points) of the first candidate that passes the check, else null."""
    tagged = F.array(*[F.struct(F.lit(n).alias("source"), p.alias("points")) for n, p in candidates.items()])
    return F.get(F.filter(tagged, lambda c: usable_polyline(c["points"], box)), F.lit(0))


def _polyline_numbers(text: str) -> np.ndarray:
    """Signed deltas of an encoded polyline: 5-bit groups, zigzag, low group first."""
    raw = np.frombuffer(text.encode("latin-1"), dtype=np.uint8).astype(np.int64) - 63
    last = raw < 0x20
    if not last.any():
        return np.empty(0, dtype=np.int64)
    raw, last = raw[: np.flatnonzero(last)[-1] + 1], last[: np.flatnonzero(last)[-1] + 1]
    group = np.concatenate(([0], np.cumsum(last)[:-1]))
    place = np.arange(raw.size) - np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))[group]
    value = np.bincount(group, weights=(raw & 0x1F) * (2.0 ** (5 * place))).astype(np.int64)
    return (value >> 1) ^ -(value & 1)


@F.pandas_udf(POINTS)
def decode_polyline(text: pd.Series) -> pd.Series:
    """Encoded polylines to points, a batch of links at a time."""

    def one(value):
        if not value:
            return []
        deltas = _polyline_numbers(value)
        deltas = deltas[: deltas.size // 2 * 2].reshape(-1, 2)
        return [{"lat": a, "lon": b} for a, b in (np.cumsum(deltas, axis=0) / 1e5).tolist()]

    return text.map(one, na_action=None)
