"""Points × raster cells, per-species statistics, grids and colours."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import geo, values
from lacuna.operators.joins import sized, spread_join
from lacuna.operators.quantiles import summarise
from lacuna.session import staged

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
GRID_PROBS = {"p01": 0.01, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
VECTOR_STATS = ("min", "q1", "median", "q3", "max", "mean", "sd")


@dataclass(frozen=True)
class Affine:
    """North-up grid with its origin at the lower-left corner; row and column count upward."""

    x0: float
    y0: float
    res: float

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / F.lit(self.res))

    def row(self, y: Column) -> Column:
        return F.floor((y - F.lit(self.y0)) / F.lit(self.res))


def sample_cells(
    points: DataFrame, cells: DataFrame, affine: Affine, project: geo.TransverseMercator | None = None
) -> DataFrame:
    """Points × variables with the value of the containing cell.

    Each distinct position is projected and matched once, and its values are kept as a table; the raster
    itself is never carried along with the points.
    """
    coords = points.where("lon IS NOT NULL").select("lon", "lat").distinct()
    x, y = geo.tm_xy(F.col("lon"), F.col("lat"), project) if project else (F.col("lon"), F.col("lat"))
    placed = coords.withColumn("row", affine.row(y)).withColumn("col", affine.col(x))
    # Many positions may share one cell, and each cell has one row per variable.
    met = spread_join(placed, cells, ["row", "col"], ["lon", "lat"], "inner")
    sampled = staged(met.select("lon", "lat", "var", "value"), "sampled")
    spread_on = [c for c in points.columns if c not in ("lon", "lat")] or ["lon"]
    return spread_join(points.where("lon IS NOT NULL"), sampled, ["lon", "lat"], spread_on, "inner")


def species_sites(points: DataFrame) -> DataFrame:
    """Points counted per species and position: all that the statistics need of them."""
    return points.where("lon IS NOT NULL").groupBy("ktsn", "lon", "lat").agg(F.count(F.lit(1)).alias("n_points"))


def species_stats(samples: DataFrame, digits: int, with_sd: bool = True) -> DataFrame:
    """n, min, quartiles, max, mean (and sd) per species and variable on finite values of sampled sites."""
    stats = summarise(samples, ["ktsn", "var"], "value", QUARTILES, weight="n_points")
    names = ["min", "q1", "median", "q3", "max", "mean"] + (["sd"] if with_sd else [])
    return stats.select("ktsn", "var", "n", *[F.bround(n, digits).alias(n) for n in names])


def grid_aggregate(cells: DataFrame, factor: int) -> DataFrame:
    """Mean of factor × factor blocks, missing cells ignored; edge blocks average the cells they have."""
    finite = F.when(~F.isnan("value"), F.col("value"))
    return cells.groupBy(
        "var", F.floor(F.col("row") / factor).alias("row"),
        F.floor(F.col("col") / factor).alias("col"),
    ).agg(F.avg(finite).alias("value"))


def grid_quantiles(cells: DataFrame, digits: int | None = 1) -> DataFrame:
    """Distribution of every variable over the grid."""
    stats = summarise(cells, ["var"], "value", GRID_PROBS)
    names = [*GRID_PROBS, "min", "max"]
    shown = [F.col(n) if digits is None else F.bround(n, digits).alias(n) for n in names]
    return stats.select("var", *shown, "n")


def mask_cells(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """Cells kept only where the reference grid has a value."""
    land = reference.where(F.col("value").isNotNull() & ~F.isnan("value")).select("row", "col").distinct()
    return cells.join(land, ["row", "col"], "left_semi")


def resample_bilinear(targets: DataFrame, cells: DataFrame, affine: Affine) -> DataFrame:
    """Value at target positions (trow, tcol, x, y) from the four nearest cell centres.

    Missing neighbours drop out and the remaining weights are rescaled; no neighbour gives NULL.
    """
    u = (F.col("x") - F.lit(affine.x0)) / F.lit(affine.res) - 0.5
    v = (F.col("y") - F.lit(affine.y0)) / F.lit(affine.res) - 0.5
    based = targets.select(
        "trow", "tcol", F.floor(u).alias("c0"), F.floor(v).alias("r0"),
        (u - F.floor(u)).alias("wx"), (v - F.floor(v)).alias("wy"),
    )
    wx, wy = F.col("wx"), F.col("wy")
    corners = F.array(
        *[
            F.struct(
                (F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"),
                ((wy if dr else 1 - wy) * (wx if dc else 1 - wx)).alias("w"),
            )
            for dr in (0, 1)
            for dc in (0, 1)
        ]
    )
    near = based.select("trow", "tcol", F.explode(corners).alias("n")).select("trow", "tcol", "n.*")
    usable = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    joined = near.where("w > 0").join(usable, ["row", "col"])
    return joined.groupBy("var", "trow", "tcol").agg(
        (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value")
    )


@dataclass(frozen=True)
class WebGrid:
    """North-up grid in spherical web-map metres with its origin at the lower-left corner."""

    x0: float
    y0: float
    res: float
    rows: int
    cols: int

    def extent(self) -> tuple[float, float, float, float]:
        """xmin, xmax, ymin, ymax, as a map overlay asks for it."""
        return self.x0, self.x0 + self.cols * self.res, self.y0, self.y0 + self.rows * self.res


def web_grid(
    spark: SparkSession, affine: Affine, rows: int, cols: int, res: float | None = None, project: geo.TransverseMercator | None = None
) -> WebGrid:
    """The web-map grid that covers a grid of `rows` x `cols` cells in degrees, or in the metres of `project`.

    Its bounds are those of points along the four sides, four to a cell. Without `res` a cell is as wide as a source cell.
    """
    rims = [(k / (4 * cols), j) for k in range(4 * cols + 1) for j in (0.0, 1.0)] + [(j, k / (4 * rows)) for k in range(4 * rows + 1) for j in (0.0, 1.0)]
    at = spark.createDataFrame([(affine.x0 + u * cols * affine.res, affine.y0 + v * rows * affine.res) for u, v in rims], "x double, y double")
    lon, lat = geo.tm_lonlat(F.col("x"), F.col("y"), project) if project else (F.col("x"), F.col("y"))
    mx, my = geo.mercator_xy(lon, lat)
    x0, x1, y0, y1 = at.select(mx.alias("mx"), my.alias("my")).agg(F.min("mx"), F.max("mx"), F.min("my"), F.max("my")).first()
    res = res or (x1 - x0) / cols
    return WebGrid(x0, y0, res, math.ceil((y1 - y0) / res), math.ceil((x1 - x0) / res))


def web_targets(spark: SparkSession, grid: WebGrid, project: geo.TransverseMercator | None = None) -> DataFrame:
    """Centres of the web-map cells (trow, tcol) in the source's coordinates; each row of cells is made where it is used."""
    cells = spark.range(grid.rows).select(F.col("id").alias("trow"), F.explode(F.expr(f"sequence(0L, {grid.cols - 1}L)")).alias("tcol"))
    lon, lat = geo.mercator_lonlat(F.lit(grid.x0) + (F.col("tcol") + 0.5) * grid.res, F.lit(grid.y0) + (F.col("trow") + 0.5) * grid.res)
    x, y = geo.tm_xy(lon, lat, project) if project else (lon, lat)
    return cells.select("trow", "tcol", x.alias("x"), y.alias("y"))


def warp(cells: DataFrame, affine: Affine, grid: WebGrid, project: geo.TransverseMercator | None = None) -> DataFrame:
    """Cells (var, row, col, value) of the web-map grid, bilinear between the source's cell centres."""
    warped = resample_bilinear(web_targets(cells.sparkSession, grid, project), cells, affine)
    return warped.select("var", F.col("trow").alias("row"), F.col("tcol").alias("col"), "value")


def layer_image(
    cells: DataFrame, affine: Affine, grid: WebGrid, palette: str, project: geo.TransverseMercator | None = None
) -> DataFrame:
    """Web-map cells in colours; the colours' limits come from the source grid, not from the warped one."""
    return coloured_cells(warp(cells, affine, grid, project), grid_quantiles(cells, digits=None), palette)


def coloured_cells(cells: DataFrame, quantiles: DataFrame, palette: str) -> DataFrame:
    """r, g, b, a per cell between the 1st and 99th percentile of its variable."""
    limits = quantiles.select("var", F.col("p01").alias("vmin"), F.col("p99").alias("vmax"))
    rgba = geo.colour_ramp(F.col("value"), F.col("vmin"), F.col("vmax"), palette)
    joined = cells.join(sized(limits, 10_000), "var")
    return joined.select("var", "row", "col", *[c.alias(n) for n, c in rgba.items()])


def env_vector(stats: DataFrame, variables: list[str], decimals: dict[str, int]) -> DataFrame:
    """One array per species: fixed variable order × seven statistics, NULL where a variable is missing."""
    packed = F.array(
        *[values.round_by_decimals(F.col(s), F.col("var"), decimals).cast("double") for s in VECTOR_STATS]
    )
    wide = (
        stats.where(F.col("var").isin(variables))
        .select("ktsn", "var", packed.alias("stats"))
        .groupBy("ktsn")
        .pivot("var", variables)
        .agg(F.first("stats"))
    )
    missing = F.array_repeat(F.lit(None).cast("double"), len(VECTOR_STATS))
    return wide.select("ktsn", F.concat(*[F.coalesce(F.col(v), missing) for v in variables]).alias("vector"))
