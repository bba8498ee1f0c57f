"""The cell index on fine boundaries: short rows, the same answers as brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.geo import EPSG_5179, tm_xy
from lacuna.operators import spatial

RINGS = "code string, ord bigint, ring int, vertices array<array<double>>"


def coast(rng, x, y, radius, vertices, rough):
    """A ragged closed line round (x, y)."""
    out = []
    for k in range(vertices):
        a = 2 * math.pi * k / vertices
        r = radius * (1 + rough * math.sin(7 * a) + rough / 4 * math.sin(53 * a + 1) + 20 / vertices * rng.uniform(-1, 1))
        out.append([x + r * math.cos(a), y + r * math.sin(a)])
    return out


def parity(rings, px, py):
    """Rays to the right of all points against all edges."""
    hit, on = np.zeros(len(px), int), np.zeros(len(px), bool)
    for ring in rings:
        v = np.array(ring)
        for part in np.array_split(np.arange(len(v)), max(1, len(v) // 2000)):
            (x1, y1), (x2, y2) = v[part].T[:, :, None], np.roll(v, -1, 0)[part].T[:, :, None]
            spans = (y1 > py) != (y2 > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit += (spans & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).sum(0)
            near = (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
            on |= (near & ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1))).any(0)
    return (hit % 2 == 1) & ~on


@pytest.fixture(scope="module")
def land(spark):
    """A fine coast with a lake, one polygon inside its bounds, one that overlaps, one with grid-aligned edges."""
    rng = random.Random(1)
    shapes = {
        "coast": [coast(rng, 127.6, 37.4, 1.1, 100_000, 0.1), coast(rng, 127.9, 37.5, 0.2, 3000, 0.2)],
        "isle": [coast(rng, 127.9, 37.5, 0.1, 500, 0.1)],
        "overlap": [coast(rng, 128.4, 38.1, 0.6, 20_000, 0.3)],
        "square": [[[126.0, 36.0], [126.5, 36.0], [126.5, 36.25], [126.25, 36.25], [126.25, 36.5], [126.0, 36.5]]],
    }
    rows = [(c, k, r, ring) for k, (c, rings) in enumerate(shapes.items()) for r, ring in enumerate(rings)]
    edges = spatial.polygon_edges(spark.createDataFrame(rows, RINGS)).cache()
    return shapes, edges


def test_cells_hold_few_edges(land):
    index = spatial.within_index(land[1])
    held = index.leaves.select(F.aggregate("polygons", F.lit(0), lambda n, p: n + F.size(p["edges"])).alias("n"))
    got = held.agg(F.avg("n"), F.max("n"), F.count("n"), F.sum("n")).first()
    assert got[0] < 30 and got[1] <= spatial.MOST_EDGES and got[3] < 4 * land[1].count()
    whole = spatial.within_index(land[1], depth=0)
    assert whole.depth == 0 and whole.splits.count() == 0


def test_within_equals_brute_force_on_fine_coast(spark, land):
    shapes, edges = land
    rng = random.Random(2)
    line = shapes["coast"][0]
    points = [(rng.uniform(125.9, 129.2), rng.uniform(35.9, 38.9)) for _ in range(1500)]
    points += [(x + rng.gauss(0, 1e-4), y + rng.gauss(0, 1e-4)) for x, y in rng.sample(line, 1500)]
    points += [tuple(v) for v in rng.sample(line, 50)] + [(126 + k / 8, 36 + j / 8) for k in range(6) for j in range(6)]
    points += [(127.5, y) for y in np.linspace(36, 39, 60)] + [(x, 37.25) for x in np.linspace(126, 129, 60)]
    px, py = np.array(points).T
    want = {}
    for code, rings in reversed(shapes.items()):
        want |= {p: code for p, inside in zip(points, parity(rings, px, py), strict=True) if inside}
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points] + [(None, None), (None, 37.0)], "lon double, lat double")
    for size, most in ((0.25, 48), (1.0, 10)):
        index = spatial.within_index(edges, size, most)
        assert index.depth > 1
        got = spatial.region_within(df, index).collect()
        assert len(got) == len(points) + 2
        assert {(r.lon, r.lat): r.region for r in got if r.region} == want


def test_nearest_equals_brute_force_on_fine_coast(spark, land):
    shapes, edges = land
    rng = random.Random(3)
    line = shapes["coast"][0] + shapes["overlap"][0]
    points = [(x + rng.gauss(0, 0.015), y + rng.gauss(0, 0.015)) for x, y in rng.sample(line, 400)]
    df = spark.createDataFrame(points, "lon double, lat double")
    ax, ay = tm_xy(F.col("x1"), F.col("y1"), EPSG_5179)
    bx, by = tm_xy(F.col("x2"), F.col("y2"), EPSG_5179)
    m = edges.select("ord", "code", ax, ay, bx, by).collect()
    ords, codes = np.array([r[0] for r in m]), np.array([r[1] for r in m])
    a, b = np.array([r[2:4] for r in m]), np.array([r[4:6] for r in m])
    x, y = tm_xy(F.col("lon"), F.col("lat"), EPSG_5179)
    want = {}
    for lon, lat, mx, my in df.select("lon", "lat", x, y).collect():
        p, d = np.array([mx, my]), b - a
        t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)[:, None]
        off = np.round(np.hypot(*(p - (a + t * d)).T), 3)
        best = np.lexsort((ords, off))[0]
        want[(lon, lat)] = codes[best] if off[best] <= 2000 else None
    assert {"coast", "overlap", None} <= set(want.values())
    index = spatial.nearest_index(edges)
    assert {(r.lon, r.lat): r.region for r in spatial.region_nearest(df, index).collect()} == want


def test_index_of_no_edges(spark, land):
    none = land[1].limit(0)
    df = spark.createDataFrame([(127.0, 37.0)], "lon double, lat double")
    assert [r.region for r in spatial.assign_region(df, spatial.build_index(none)).collect()] == ["00000"]
