"""Raster sampling, per-species statistics, grids and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import geo
from lacuna.operators import env, observe
from lacuna.plans.duck import half_even
from lacuna.plans.registry import query
from lacuna.plans.standin import Inputs
from lacuna.session import staged

AFFINE = env.Affine(124.0, 33.0, 1 / 64)
VARS = ("bio01", "bio12", "dem")

_SAMPLED = """
, pt AS (SELECT DISTINCT ktsn, source, year, region, lon, lat FROM v_obs WHERE lon IS NOT NULL)
, sm AS (SELECT p.ktsn, p.source, p.year, p.lon, p.lat, r.var, r.value FROM pt p JOIN v_raster r
  ON r."row" = CAST(floor((p.lat - 33) * 64) AS BIGINT) AND r.col = CAST(floor((p.lon - 124) * 64) AS BIGINT))"""


def samples(i: Inputs) -> DataFrame:
    return env.sample_cells(observe.distinct_points(i.obs()), i.raster(), AFFINE)


def site_samples(i: Inputs) -> DataFrame:
    return env.sample_cells(env.species_sites(observe.distinct_points(i.obs())), i.raster(), AFFINE)


@query("raster_sample", _SAMPLED + " SELECT ktsn, source, coalesce(year, 0) AS year, lon, lat, var, value FROM sm")
def raster_sample(i: Inputs) -> DataFrame:
    return samples(i).select("ktsn", "source", F.coalesce("year", F.lit(0)).alias("year"), "lon", "lat", "var", "value")


def _stats_sql(source: str, keys: str, digits: int, sd: bool) -> str:
    shown = {
        "min": "min(value)", "q1": "quantile_cont(value, 0.25)", "median": "quantile_cont(value, 0.5)",
        "q3": "quantile_cont(value, 0.75)", "max": "max(value)", "mean": "avg(value)",
    }
    if sd:
        shown["sd"] = "CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END"
    rounded = ", ".join(f"{half_even(e, digits)} AS {n}" for n, e in shown.items())
    return f"SELECT {keys}, count(*) AS n, {rounded} FROM {source} WHERE value IS NOT NULL AND isfinite(value) GROUP BY {keys}"


@query(
    "species_env_stats",
    _SAMPLED + ", st AS (" + _stats_sql("sm", "ktsn, var", 2, True)
    + ") SELECT st.*, coalesce(c.taxon_group, '') AS taxon_group FROM st LEFT JOIN v_check c ON c.ktsn = st.ktsn",
)
def species_env_stats(i: Inputs) -> DataFrame:
    stats = observe.with_group(env.species_stats(site_samples(i), 2), i.check(), "left")
    return stats.withColumn("taxon_group", F.coalesce("taxon_group", F.lit("")))


@query("species_bioclim", _SAMPLED + " " + _stats_sql("sm", "ktsn, var", 3, False))
def species_bioclim(i: Inputs) -> DataFrame:
    return env.species_stats(site_samples(i), 3, with_sd=False)


_BLOCKS = ', bl AS (SELECT var, CAST(floor("row" / 11) AS BIGINT) AS "row", CAST(floor(col / 11) AS BIGINT) AS col, avg(value) AS value FROM v_raster GROUP BY 1, 2, 3)'


@query("grid_aggregate", _BLOCKS + ' SELECT var, "row", col, round(value, 6) AS value FROM bl')
def grid_aggregate(i: Inputs) -> DataFrame:
    return env.grid_aggregate(i.raster(), 11).withColumn("value", F.round("value", 6))


_GQ = ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in env.GRID_PROBS.items())
_QUANT = f", gq AS (SELECT var, {_GQ}, min(value) AS min, max(value) AS max, count(value) AS n FROM v_raster WHERE value IS NOT NULL GROUP BY var)"


@query(
    "grid_quantiles",
    _QUANT + " SELECT var, " + ", ".join(f"{half_even(n, 1)} AS {n}" for n in (*env.GRID_PROBS, "min", "max")) + ", n FROM gq",
)
def grid_quantiles(i: Inputs) -> DataFrame:
    return env.grid_quantiles(i.raster())


@query(
    "mask_to_land",
    """SELECT var, "row", col, value FROM v_raster d WHERE var = 'dem' AND EXISTS
    (SELECT 1 FROM v_raster b WHERE b.var = 'bio01' AND b.value IS NOT NULL AND b."row" = d."row" AND b.col = d.col)""",
)
def mask_to_land(i: Inputs) -> DataFrame:
    cells = i.raster()
    kept = env.mask_cells(cells.where("var = 'dem'"), cells.where("var = 'bio01'"))
    return kept.select("var", "row", "col", "value")


# Target grid: every position of an observation, moved by a third of a cell.
@query(
    "resample_bilinear",
    """, t AS (SELECT DISTINCT CAST(floor((lat - 33) * 64) AS BIGINT) AS trow, CAST(floor((lon - 124) * 64) AS BIGINT) AS tcol, lon + 0.005 AS x, lat + 0.004 AS y FROM v_obs WHERE lon IS NOT NULL)
    , b AS (SELECT *, (x - 124) * 64 - 0.5 AS u, (y - 33) * 64 - 0.5 AS v FROM t)
    , n AS (SELECT trow, tcol, floor(v) + dr AS r, floor(u) + dc AS c, CASE dr WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * CASE dc WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END AS w
      FROM b CROSS JOIN (VALUES (0), (1)) d1(dr) CROSS JOIN (VALUES (0), (1)) d2(dc))
    SELECT s.var, n.trow, n.tcol, round(sum(w * s.value) / sum(w), 6) AS value FROM n JOIN v_raster s ON s."row" = n.r AND s.col = n.c AND s.value IS NOT NULL WHERE w > 0 GROUP BY 1, 2, 3""",
)
def resample_bilinear(i: Inputs) -> DataFrame:
    coords = observe.distinct_coords(i.obs())
    targets = coords.select(
        AFFINE.row(F.col("lat")).alias("trow"), AFFINE.col(F.col("lon")).alias("tcol"),
        (F.col("lon") + 0.005).alias("x"), (F.col("lat") + 0.004).alias("y"),
    )
    return env.resample_bilinear(targets, i.raster(), AFFINE).withColumn("value", F.round("value", 6))


def _mix(channel: int) -> str:
    s = geo.palette_stops("temp", channel)
    pick = " ".join(f"WHEN {k} THEN {s[k]} + ({s[k + 1]} - {s[k]}) * (share * 4 - {k})" for k in range(4))
    return f"CASE WHEN value IS NULL THEN 0 ELSE CASE CAST(least(floor(share * 4), 3) AS INT) {pick} END END"


@query(
    "colour_ramp",
    _QUANT
    + """, cs AS (SELECT r.var, r."row", r.col, r.value, least(1, greatest(0, (r.value - q.p01) / (q.p99 - q.p01))) AS share FROM v_raster r JOIN gq q ON q.var = r.var)
    SELECT var, "row", col, """
    + ", ".join(f"round(CAST({_mix(k)} AS DOUBLE), 4) AS {c}" for k, c in enumerate("rgb"))
    + ", CAST(CASE WHEN value IS NULL THEN 0 ELSE 1 END AS INT) AS a FROM cs",
)
def colour_ramp(i: Inputs) -> DataFrame:
    cells = i.raster()
    rgba = env.coloured_cells(cells, env.grid_quantiles(cells, digits=None), "temp")
    return rgba.withColumns({c: F.round(c, 4) for c in "rgb"})


_WEB_RES = 6000.0
_R = geo.MERCATOR_R


@query(
    "layer_image",
    f""", bl AS (SELECT var, CAST(floor("row" / 4) AS BIGINT) AS "row", CAST(floor(col / 4) AS BIGINT) AS col, avg(value) AS value FROM v_raster GROUP BY 1, 2, 3)
    , gq AS (SELECT var, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM bl WHERE value IS NOT NULL GROUP BY var)
    , e AS (SELECT radians(124) * {_R} AS x0, radians(124 + (max(col) + 1) / 16.0) * {_R} AS x1, ln(tan(pi() / 4 + radians(33) / 2)) * {_R} AS y0,
        ln(tan(pi() / 4 + radians(33 + (max("row") + 1) / 16.0) / 2)) * {_R} AS y1 FROM bl)
    , t AS (SELECT trow, tcol, degrees((x0 + (tcol + 0.5) * {_WEB_RES}) / {_R}) AS x, degrees(2 * atan(exp((y0 + (trow + 0.5) * {_WEB_RES}) / {_R})) - pi() / 2) AS y
        FROM e, generate_series(0, CAST(ceil((y1 - y0) / {_WEB_RES}) AS BIGINT) - 1) r(trow), generate_series(0, CAST(ceil((x1 - x0) / {_WEB_RES}) AS BIGINT) - 1) c(tcol))
    , b AS (SELECT *, (x - 124) * 16 - 0.5 AS u, (y - 33) * 16 - 0.5 AS v FROM t)
    , n AS (SELECT trow, tcol, floor(v) + dr AS r, floor(u) + dc AS c, CASE dr WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * CASE dc WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END AS w
      FROM b CROSS JOIN (VALUES (0), (1)) d1(dr) CROSS JOIN (VALUES (0), (1)) d2(dc))
    , wp AS (SELECT s.var, n.trow AS "row", n.tcol AS col, sum(w * s.value) / sum(w) AS value FROM n JOIN bl s ON s."row" = n.r AND s.col = n.c AND s.value IS NOT NULL WHERE w > 0 GROUP BY 1, 2, 3)
    , cs AS (SELECT wp.*, least(1, greatest(0, (wp.value - q.p01) / (q.p99 - q.p01))) AS share FROM wp JOIN gq q ON q.var = wp.var)
    SELECT var, "row", col, """
    + ", ".join(f"round(CAST({_mix(k)} AS DOUBLE), 4) AS {c}" for k, c in enumerate("rgb"))
    + ", CAST(1 AS INT) AS a FROM cs",
)
def layer_image(i: Inputs) -> DataFrame:
    """Blocks of 4 x 4 cells, warped to the web map, coloured between the 1st and 99th percentile of the blocks."""
    cells = staged(env.grid_aggregate(i.raster(), 4), "blocks")
    blocks = env.Affine(AFFINE.x0, AFFINE.y0, AFFINE.res * 4)
    size = cells.agg(F.max("row").alias("rows"), F.max("col").alias("cols")).first()
    grid = env.web_grid(i.spark, blocks, size.rows + 1, size.cols + 1, _WEB_RES)
    return env.layer_image(cells, blocks, grid, "temp").withColumns({c: F.round(c, 4) for c in "rgb"})


@query(
    "env_vector",
    _SAMPLED
    + ", st AS ("
    + _stats_sql("sm", "ktsn, var", 2, True)
    + f"""), un AS (
      SELECT ktsn, CASE var WHEN 'bio01' THEN 0 WHEN 'bio12' THEN 1 ELSE 2 END AS v, var,
        unnest([0, 1, 2, 3, 4, 5, 6]) AS k, unnest([min, q1, median, q3, max, mean, sd]) AS x FROM st)
    , slots AS (SELECT DISTINCT ktsn, unnest(range(0, 21)) AS slot FROM st)
    SELECT s.ktsn, CAST(s.slot AS INT) AS slot, coalesce(CASE u.var WHEN 'bio01' THEN {half_even('u.x', 1)} ELSE {half_even('u.x', 0)} END, -1) AS x
    FROM slots s LEFT JOIN un u ON u.ktsn = s.ktsn AND u.v * 7 + u.k = s.slot""",
)
def env_vector(i: Inputs) -> DataFrame:
    vectors = env.env_vector(env.species_stats(site_samples(i), 2), list(VARS), {"bio01": 1, "bio12": 0, "dem": 0})
    return vectors.select("ktsn", F.posexplode("vector").alias("slot", "x")).withColumn("x", F.coalesce("x", F.lit(-1.0)))
