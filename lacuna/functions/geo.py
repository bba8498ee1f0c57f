"""Map projections and colours as closed-form Column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the spherical Mercator radius.
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
MERCATOR_R = 6378137.0


@dataclass(frozen=True)
class TransverseMercator:
    lat0: float
    lon0: float
    scale: float
    east: float
    north: float

    def series(self) -> tuple[float, float, tuple[float, float, float]]:
        """(c, rectifying radius, alpha1..3) of the three-term Krueger series."""
        n = GRS80_F / (2 - GRS80_F)
        c = 2 * math.sqrt(n) / (1 + n)
        radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        return c, radius, alpha

    def origin_arc(self) -> float:
        """Scaled meridian distance of the origin latitude."""
        c, radius, alpha = self.series()
        s = math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - c * math.atanh(c * s)))
        return self.scale * radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(alpha, 1)))


# The two Korean metric grids.
EPSG_5186 = TransverseMercator(38.0, 127.0, 1.0, 200000.0, 600000.0)
EPSG_5179 = TransverseMercator(38.0, 127.5, 0.9996, 1000000.0, 2000000.0)


def tm_xy(lon: Column, lat: Column, grid: TransverseMercator) -> tuple[Column, Column]:
    """Metric (x, y) of a position in degrees."""
    c, radius, alpha = grid.series()
    k = grid.scale * radius
    s = F.sin(F.radians(lat))
    dl = F.radians(lon - F.lit(grid.lon0))
    t = F.sinh(F.atanh(s) - F.lit(c) * F.atanh(F.lit(c) * s))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        y = y + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    return (
        F.lit(grid.east) + F.lit(k) * x,
        F.lit(grid.north - grid.origin_arc()) + F.lit(k) * y,
    )


#: Metric grids by EPSG number (fixed values).
GRIDS = {5186: EPSG_5186, 5179: EPSG_5179}


def tm_lonlat(x: Column, y: Column, grid: TransverseMercator) -> tuple[Column, Column]:
    """Position in degrees of a metric (x, y): the inverse series, true to well below a millimetre near the grid's meridian."""
    n = GRS80_F / (2 - GRS80_F)
    _, radius, _ = grid.series()
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630,
    )
    k = grid.scale * radius
    xi0 = (y - F.lit(grid.north - grid.origin_arc())) / F.lit(k)
    eta0 = (x - F.lit(grid.east)) / F.lit(k)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - F.lit(b) * F.sin(F.lit(2.0 * j) * xi0) * F.cosh(F.lit(2.0 * j) * eta0)
        eta = eta - F.lit(b) * F.cos(F.lit(2.0 * j) * xi0) * F.sinh(F.lit(2.0 * j) * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    return F.lit(grid.lon0) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def mercator_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Position in degrees of a spherical web-map (x, y)."""
    lat = F.lit(2.0) * F.atan(F.exp(y / F.lit(MERCATOR_R))) - F.lit(math.pi / 2)
    return F.degrees(x / F.lit(MERCATOR_R)), F.degrees(lat)


def mercator_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical web-map (x, y) in metres."""
    x = F.radians(lon) * F.lit(MERCATOR_R)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / F.lit(2.0))) * F.lit(MERCATOR_R)
    return x, y


# Five-stop colour ramps.
PALETTES = {
    "temp": ("#2c7bb6", "#abd9e9", "#ffffbf", "#fdae61", "#d7191c"),
    "precip": ("#f7fbff", "#c6dbef", "#6baed6", "#2171b5", "#08306b"),
    "elev": ("#2b7a3d", "#a6d96a", "#ffffbf", "#e0a060", "#8c510a"),
}


def palette_stops(palette: str, channel: int) -> list[float]:
    """One channel (0 red, 1 green, 2 blue) of every stop, 0..255."""
    return [float(int(stop[1 + 2 * channel : 3 + 2 * channel], 16)) for stop in PALETTES[palette]]


def colour_ramp(value: Column, vmin: Column, vmax: Column, palette: str) -> dict[str, Column]:
    """r, g, b (0..255) and a (0/1): value clamped to [vmin, vmax], mixed between neighbouring stops."""
    usable = value.isNotNull() & ~F.isnan(value)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - vmin) / (vmax - vmin)))
    steps = len(PALETTES[palette]) - 1
    low = F.least(F.floor(share * steps), F.lit(steps - 1)).cast("int")
    mix = share * steps - low
    out = {}
    for i, name in enumerate(("r", "g", "b")):
        stops = palette_stops(palette, i)
        start, end = F.lit(stops[0]), F.lit(stops[1])
        for s in range(1, steps):
            start = F.when(low == s, F.lit(stops[s])).otherwise(start)
            end = F.when(low == s, F.lit(stops[s + 1])).otherwise(end)
        out[name] = F.when(usable, start + (end - start) * mix).otherwise(F.lit(0.0))
    out["a"] = F.when(usable, 1).otherwise(0)
    return out
