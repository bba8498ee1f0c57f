"""Points × regions without geometry types: polygons are edge tables, joins are equi-joins on grid cells.

Each cell row carries, for every polygon that covers or meets the cell, the edges that touch the cell and one
parity for all others. Cells with many edges are cut into smaller ones, so a row stays short however fine the
boundaries are. A point needs the lookup of its cell (one more for each level that some cells were cut) and
arithmetic on that row; pairs of points and polygons are never materialised and nothing is grouped per point.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.geo import EPSG_5179, TransverseMercator, tm_xy
from lacuna.operators.joins import spread_join
from lacuna.session import staged

UNKNOWN_PROVINCE = "미상"
UNKNOWN_DISTRICT = "00000"
NEAR_METRES = 2000.0
#: A cell with more edges than this is cut into FAN x FAN parts, DEPTH times at most.
MOST_EDGES = 48
FAN = 4
DEPTH = 6
#: Share of a cell by which edges may miss it and still be held.
SLACK = 1e-6


def polygon_edges(rings: DataFrame) -> DataFrame:
    """(code, ord, ring, vertices array<array<double>>) → edges (code, ord, x1, y1, x2, y2).

    Rings are closed: the last vertex connects to the first, whether or not the first is repeated.
    """
    v = F.col("vertices")
    following = F.concat(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    # Paired before they are taken apart: a row must not carry its whole ring along.
    pairs = F.zip_with(
        v, following, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    )
    edges = rings.where(F.size(v) >= 3).select("code", "ord", F.explode(pairs).alias("e")).select("code", "ord", "e.*")
    return edges.where("x1 <> x2 OR y1 <> y2")


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def check_cell_size(size: float) -> None:
    if math.log2(size) != round(math.log2(size)):
        raise ValueError("cell size must be a power of two so that cell borders are exact")


@dataclass(frozen=True)
class CellIndex:
    """Cells with few edges each: `leaves` by (level, cx, cy), `splits` the cells that were cut further, `size` at level 0."""

    leaves: DataFrame
    splits: DataFrame
    depth: int
    size: float


def _refined(cells: DataFrame, size: float, children: Callable[[DataFrame, float], DataFrame], most: int, depth: int) -> CellIndex:
    """Cut cells with more than `most` edges (column `edges_held`) into FAN x FAN, again and again."""
    here = staged(cells.withColumn("level", F.lit(0)), "cells")
    kept, cut, level = [], [], 0
    heavy = F.col("edges_held") > most
    while level < depth and not (dense := here.where(heavy)).isEmpty():
        kept.append(here.where(~heavy))
        cut.append(dense.select("level", "cx", "cy"))
        level += 1
        here = staged(children(dense.drop("level", "edges_held"), size / FAN**level).withColumn("level", F.lit(level)), "cells")
    leaves = functools.reduce(DataFrame.unionByName, kept, here).drop("edges_held")
    splits = functools.reduce(DataFrame.unionByName, cut) if cut else here.select("level", "cx", "cy").limit(0)
    return CellIndex(staged(leaves, "leaves") if cut else leaves, staged(splits, "splits") if cut else splits, level, size)


def _children(rows: DataFrame) -> DataFrame:
    """Each row once for each of the FAN x FAN parts of its cell."""
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FAN * FAN - 1))))
    return parts.withColumns(
        {"cx": F.col("cx") * FAN + F.col("_part") % FAN, "cy": F.col("cy") * FAN + F.expr(f"_part DIV {FAN}")}
    ).drop("_part")


def _looked_up(points: DataFrame, x: Column, y: Column, index: CellIndex, spread_on: list[str]) -> DataFrame:
    """Points with the content of the leaf that holds (x, y); NULL where there is none, or without coordinates."""
    df = points.withColumns(
        {
            "level": F.lit(0), "cx": F.coalesce(cell_of(x, index.size), _nowhere(spread_on)),
            "cy": F.coalesce(cell_of(y, index.size), F.lit(0)),
        }
    )
    for level in range(index.depth):
        cut = index.splits.where(F.col("level") == level).withColumn("_cut", F.lit(True))
        fine = index.size / FAN ** (level + 1)

        def part(value: Column, cell: str) -> Column:
            low = F.col(cell) * FAN
            return F.when(F.col("_cut"), F.least(F.greatest(cell_of(value, fine), low), low + FAN - 1)).otherwise(F.col(cell))  # noqa: B023

        df = spread_join(df, cut, ["level", "cx", "cy"], spread_on)
        finer = {"level": F.when(F.col("_cut"), level + 1).otherwise(F.col("level")), "cx": part(x, "cx"), "cy": part(y, "cy")}
        df = df.withColumns(finer).drop("_cut")
    return spread_join(df, index.leaves, ["level", "cx", "cy"], spread_on).drop("level", "cx", "cy")


def _clipped(e: Callable[[str], Column], left: Column, right: Column) -> tuple[Column, Column]:
    """Lowest and highest y of the part of an edge between two vertical lines that it reaches."""
    x1, y1, x2, y2 = (e(c) for c in ("x1", "y1", "x2", "y2"))

    def at(x: Column) -> Column:
        share = F.when(x1 == x2, F.lit(0.0)).otherwise((x - x1) / F.when(x1 == x2, F.lit(1.0)).otherwise(x2 - x1))
        return y1 + (y2 - y1) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))

    a, b = at(F.greatest(F.least(x1, x2), left)), at(F.least(F.greatest(x1, x2), right))
    upright = x1 == x2
    low = F.when(upright, F.least(y1, y2)).otherwise(F.least(a, b))
    high = F.when(upright, F.greatest(y1, y2)).otherwise(F.greatest(a, b))
    return low, high


def _far(e: Callable[[str], Column], right: Column) -> Column:
    """The y of the end beyond the right border, where the edge crosses that border's line."""
    x1, x2 = e("x1"), e("x2")
    return F.when((x1 >= right) != (x2 >= right), F.when(x1 >= right, e("y1")).otherwise(e("y2")))


def within_index(edges: DataFrame, size: float = 0.25, most: int = MOST_EDGES, depth: int = DEPTH) -> CellIndex:
    """Cell → candidate polygons in ordinal order, each with the edges that meet the cell and one parity.

    A ray from a point to the right meets edges of its own cell, which are tested, and others. How often it meets others
    changes along the height of the cell only where the boundary crosses the cell's right border, and the edges that do so
    meet the cell: `far` tells at which height an edge changes the parity, and `base` is the parity at the bottom. It counts
    the edges that cross the line of the right border further down. So no cell holds an edge that does not touch it.
    """
    check_cell_size(size)
    slack = size * SLACK
    across = edges.withColumn(
        "cx", F.explode(F.sequence(cell_of(F.least("x1", "x2"), size), cell_of(F.greatest("x1", "x2"), size)))
    )
    left, right = F.col("cx") * size, (F.col("cx") + 1) * size
    low, high = _clipped(F.col, left, right)
    far = _far(F.col, right)
    banded = across.select(
        "code", "ord", "cx", cell_of(low - slack, size).alias("r0"), cell_of(high + slack, size).alias("r1"),
        F.struct("x1", "y1", "x2", "y2", far.alias("far")).alias("edge"),
    )
    rows = lambda a, b: F.explode(F.sequence(a, b)).alias("cy")
    held = banded.select("code", "ord", "cx", rows("r0", "r1"), "edge", F.lit(None).cast("int").alias("base"))
    lines = banded.groupBy("code", "ord", "cx").agg(
        F.min("r0").alias("r0"), F.max("r1").alias("r1"),
        F.collect_list(F.when(F.col("edge.far").isNotNull(), F.col("r1"))).alias("ends"),
    )
    below = F.size(F.filter("ends", lambda r: r < F.col("cy"))) % 2
    bases = lines.select("code", "ord", "cx", rows("r0", "r1"), "ends").select(
        "code", "ord", "cx", "cy", F.lit(None).cast(held.schema["edge"].dataType).alias("edge"), below.alias("base")
    )
    per_polygon = held.unionByName(bases).groupBy("cx", "cy", "ord", "code").agg(
        F.max("base").alias("base"), F.collect_list("edge").alias("edges")
    )
    return _refined(_polygons(per_polygon), size, _within_children, most, depth)


def _polygons(per_polygon: DataFrame) -> DataFrame:
    """One row per cell from rows per cell and polygon."""
    return per_polygon.where("base = 1 OR size(edges) > 0").groupBy("cx", "cy").agg(
        F.sort_array(F.collect_list(F.struct("ord", "code", "base", "edges"))).alias("polygons"),
        F.sum(F.size("edges")).alias("edges_held"),
    )


def _within_children(dense: DataFrame, size: float) -> DataFrame:
    """Parts of cells; the parity of a part is that of its lower left corner, worked out from the whole cell."""
    left, right = F.col("cx") * size, (F.col("cx") + 1) * size
    bottom, top = F.col("cy") * size, (F.col("cy") + 1) * size
    slack = size * SLACK
    e = F.col("edge")
    low, high = _clipped(e.getField, left, right)
    across = (F.least(e["x1"], e["x2"]) <= right) & (F.greatest(e["x1"], e["x2"]) >= left)
    meets = across & (low <= top + slack) & (high >= bottom - slack)
    own = F.struct(*[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")], _far(e.getField, right).alias("far"))
    whole = dense.select("cx", "cy", F.inline("polygons"))
    rows = _children(whole.select("cx", "cy", "ord", "code", F.explode("edges").alias("edge"))).withColumn("own", F.when(meets, own))
    # What the edge changes at the corner in the whole cell, less what it changes there in the part.
    turn = F.coalesce(_turns(e, left, bottom), F.lit(False)) != F.coalesce(_turns(F.col("own"), left, bottom), F.lit(False))
    told = rows.select("cx", "cy", "ord", "code", F.lit(0).alias("base"), "own", turn.alias("turn")).where("turn OR own IS NOT NULL")
    seeds = _children(whole.select("cx", "cy", "ord", "code", "base")).withColumns(
        {"own": F.lit(None).cast(told.schema["own"].dataType), "turn": F.lit(False)}
    )
    parts = told.unionByName(seeds).groupBy("cx", "cy", "ord", "code")
    base = ((F.max("base") + F.count_if("turn")) % 2).cast("int")
    return _polygons(parts.agg(base.alias("base"), F.collect_list("own").alias("edges")))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right meets the edge (half-open in y)."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])


def _turns(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge of the cell changes the parity at (x, y)."""
    return _crosses(e, x, y) != F.coalesce(y >= e["far"], F.lit(False))


def _touches(e: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies on the edge."""
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (cross == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def _inside(p: Column, x: Column, y: Column) -> Column:
    met = F.size(F.filter(p["edges"], lambda e: _turns(e, x, y))) + p["base"]
    return (met % 2 == 1) & ~F.exists(p["edges"], lambda e: _touches(e, x, y))


def _nowhere(spread_on: list[str]) -> Column:
    """Cell numbers no polygon has, spread by hash, for rows that need no lookup."""
    return F.lit(-(2**40)) - F.pmod(F.xxhash64(*spread_on), F.lit(4096))


def region_within(points: DataFrame, index: CellIndex, out: str = "region") -> DataFrame:
    """Add the first polygon strictly containing (lon, lat); NULL outside, on an edge, or without coordinates."""
    x, y = F.col("lon"), F.col("lat")
    joined = _looked_up(points, x, y, index, points.columns)
    hit = F.filter("polygons", lambda p: _inside(p, x, y))
    return joined.withColumn(out, F.get(hit, F.lit(0))["code"]).drop("polygons")


def nearest_index(edges: DataFrame, reach: float = NEAR_METRES, grid: TransverseMercator = EPSG_5179) -> CellIndex:
    """Metric cell of side `reach` → edges that may lie within `reach` of a point in the cell; these cells are not cut."""
    ax, ay = tm_xy(F.col("x1"), F.col("y1"), grid)
    bx, by = tm_xy(F.col("x2"), F.col("y2"), grid)
    m = edges.select("code", "ord", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    pad = reach + 1.0

    def span(a: str, b: str) -> Column:
        low = cell_of(F.least(a, b) - pad, reach)
        return F.explode(F.sequence(low, cell_of(F.greatest(a, b) + pad, reach)))

    centre = [(F.col(c) + 0.5) * reach for c in ("cx", "cy")]
    cells = m.withColumn("cx", span("ax", "bx")).withColumn("cy", span("ay", "by"))
    near = cells.where(segment_distance(*centre, *[F.col(c) for c in ("ax", "ay", "bx", "by")]) <= pad + reach * math.sqrt(0.5))
    grouped = near.groupBy("cx", "cy").agg(
        F.collect_list(F.struct("ord", "code", "ax", "ay", "bx", "by")).alias("near_edges")
    )
    leaves = staged(grouped.withColumn("level", F.lit(0)), "nearest-cells")
    return CellIndex(leaves, leaves.select("level", "cx", "cy").limit(0), 0, reach)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((px - ax) * dx + (py - ay) * dy) / length2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def region_nearest(
    points: DataFrame, index: CellIndex, reach: float = NEAR_METRES, out: str = "region",
    grid: TransverseMercator = EPSG_5179, needed: Column | None = None,
) -> DataFrame:
    """Add the polygon nearest to (lon, lat) within `reach` metres (distance to 1 mm, ties by ordinal).

    Only rows where `needed` holds are projected and looked up.
    """
    wanted = F.col("lon").isNotNull() if needed is None else needed & F.col("lon").isNotNull()
    px, py = tm_xy(F.col("lon"), F.col("lat"), grid)
    keyed = points.withColumn("_m", F.when(wanted, F.struct(px.alias("x"), py.alias("y"))))
    x, y = F.col("_m.x"), F.col("_m.y")
    joined = _looked_up(keyed, x, y, index, points.columns)
    ranked = F.transform(
        "near_edges",
        lambda e: F.struct(
            F.round(segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"]), 3).alias("d"),
            e["ord"].alias("ord"),
            e["code"].alias("code"),
        ),
    )
    best = F.array_min(ranked)
    return joined.withColumn(out, F.when(best["d"] <= reach, best["code"])).drop("_m", "near_edges")


@dataclass(frozen=True)
class RegionIndex:
    """Cell tables of one set of boundaries, written once so that their size is known to the planner."""

    within: CellIndex
    nearest: CellIndex | None
    reach: float


def build_index(edges: DataFrame, size: float = 0.25, reach: float | None = NEAR_METRES) -> RegionIndex:
    """`reach` None leaves out the nearest-polygon fallback."""
    return RegionIndex(within_index(edges, size), None if reach is None else nearest_index(edges, reach), reach or 0.0)


def assign_region(
    points: DataFrame, index: RegionIndex, unknown: str = UNKNOWN_DISTRICT, out: str = "region"
) -> DataFrame:
    """Region of every row: strictly inside, else nearest within reach, else `unknown`.

    Two lookups in small cell tables and arithmetic within the row; the points are not shuffled.
    """
    placed = region_within(points, index.within, "_in")
    if index.nearest is not None:
        placed = region_nearest(placed, index.nearest, index.reach, "_near", needed=F.col("_in").isNull())
    else:
        placed = placed.withColumn("_near", F.lit(None).cast("string"))
    return placed.withColumn(out, F.coalesce("_in", "_near", F.lit(unknown))).drop("_in", "_near")


def attach_region(points: DataFrame, regions: DataFrame, unknown: str = UNKNOWN_DISTRICT) -> DataFrame:
    """Join a (lon, lat, region) table back onto rows by exact coordinate; missing → unknown.

    Rows without coordinates go round the join, so that they do not meet in one task.
    """
    spread_on = points.columns
    placed = spread_join(points.where("lon IS NOT NULL"), regions, ["lon", "lat"], spread_on)
    placed = placed.withColumn("region", F.coalesce("region", F.lit(unknown)))
    return placed.unionByName(points.where("lon IS NULL").withColumn("region", F.lit(unknown)))
