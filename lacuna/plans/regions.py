"""Regions of points, distinct points, counts, audits and set rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import values
from lacuna.operators import gap, observe, quality, spatial
from lacuna.plans import duck
from lacuna.plans.registry import query
from lacuna.plans.standin import Inputs
from lacuna.session import staged


def edges(i: Inputs) -> DataFrame:
    return spatial.polygon_edges(i.rings())


def by_survey(rows: DataFrame) -> list[DataFrame]:
    """A table for each of two surveys, and one for all other sources, named or not."""
    first = F.coalesce(F.substring("source", 1, 1), F.lit(""))
    return [rows.where(first == "A"), rows.where(first == "N"), rows.where(~first.isin("A", "N"))]


@query(
    "region_within",
    duck.COORDS + duck.WITHIN
    + " SELECT c.lon, c.lat, coalesce(i.code, '미상') AS region FROM coords c LEFT JOIN inside i ON c.lon = i.lon AND c.lat = i.lat",
)
def region_within(i: Inputs) -> DataFrame:
    coords = observe.distinct_coords(i.obs())
    got = spatial.region_within(coords, spatial.build_index(edges(i), reach=None).within)
    return got.select("lon", "lat", F.coalesce("region", F.lit(spatial.UNKNOWN_PROVINCE)).alias("region"))


@query(
    "region_nearest_within",
    duck.COORDS + duck.WITHIN + duck.NEAREST
    + " SELECT m.lon, m.lat, coalesce(n.code, '00000') AS region FROM missed m LEFT JOIN near n ON m.lon = n.lon AND m.lat = n.lat",
)
def region_nearest_within(i: Inputs) -> DataFrame:
    index = spatial.build_index(edges(i))
    inside = spatial.region_within(observe.distinct_coords(i.obs()), index.within)
    missed = inside.where("region IS NULL").select("lon", "lat")
    near = spatial.region_nearest(missed, index.nearest)
    return near.select("lon", "lat", F.coalesce("region", F.lit(spatial.UNKNOWN_DISTRICT)).alias("region"))


_PLACED = (
    duck.COORDS + duck.WITHIN + duck.NEAREST
    + """, placed AS (SELECT lon, lat, code FROM inside UNION ALL SELECT lon, lat, code FROM near)
    , located AS (SELECT o.ktsn, o.source, o.year, o.lon, o.lat, coalesce(p.code, '00000') AS region
      FROM v_obs o LEFT JOIN placed p ON o.lon = p.lon AND o.lat = p.lat)"""
)


@query("attach_region", _PLACED + " SELECT region, source, count(*) AS n, count(DISTINCT ktsn) AS n_species FROM located GROUP BY region, source")
def attach_region(i: Inputs) -> DataFrame:
    """Region found once per distinct position, kept as a table, and joined back by position."""
    obs = i.obs().drop("region")
    regions = spatial.assign_region(observe.distinct_coords(obs), spatial.build_index(edges(i)))
    regions = staged(regions, "coordinate-regions")
    located = spatial.attach_region(obs, regions)
    return located.groupBy("region", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ktsn").alias("n_species")
    )


@query(
    "obs_count_agg",
    _PLACED
    + """ SELECT l.ktsn, c.taxon_group, l.region, coalesce(l.year, 0) AS year, l.source, count(DISTINCT {'a': l.lon, 'b': l.lat}) AS obs_count
      FROM located l JOIN v_check c ON c.ktsn = l.ktsn GROUP BY l.ktsn, c.taxon_group, l.region, l.year, l.source""",
)
def obs_count_agg(i: Inputs) -> DataFrame:
    """Observations → distinct points → region → counts; the checklist is joined to the counts, not the records.

    The region is a function of the position, so points are made distinct before it is looked up.
    """
    points = i.obs().select("ktsn", "source", "year", "lon", "lat").distinct()
    located = spatial.assign_region(points, spatial.build_index(edges(i)))
    counted = observe.with_group(observe.count_points(located), i.check())
    return counted.select("ktsn", "taxon_group", "region", F.coalesce("year", F.lit(0)).alias("year"), "source", "obs_count")


@query(
    "points_distinct",
    "SELECT DISTINCT o.ktsn, c.taxon_group, o.source, coalesce(o.year, 0) AS year, o.region, o.lon, o.lat FROM v_obs o JOIN v_check c ON c.ktsn = o.ktsn",
)
def points_distinct(i: Inputs) -> DataFrame:
    points = observe.with_group(observe.distinct_points(i.obs()), i.check())
    return points.select("ktsn", "taxon_group", "source", F.coalesce("year", F.lit(0)).alias("year"), "region", "lon", "lat")


@query(
    "points_to_region_agg",
    "SELECT ktsn, region, coalesce(year, 0) AS year, source, count(*) AS obs_count FROM (SELECT DISTINCT ktsn, region, year, source, lon, lat FROM v_obs) GROUP BY ktsn, region, year, source",
)
def points_to_region_agg(i: Inputs) -> DataFrame:
    counted = observe.count_points(observe.distinct_points(i.obs()))
    return counted.select("ktsn", "region", F.coalesce("year", F.lit(0)).alias("year"), "source", "obs_count")


@query(
    "region_rollup",
    """SELECT coalesce(substring(region, 1, 2), '') AS province, coalesce(region, '') AS region, CAST(sum(obs_count) AS BIGINT) AS obs_count,
      CAST(GROUPING(substring(region, 1, 2)) * 2 + GROUPING(region) AS BIGINT) AS level
      FROM v_agg GROUP BY ROLLUP (substring(region, 1, 2), region)""",
)
def region_rollup(i: Inputs) -> DataFrame:
    return observe.region_rollup(observe.obs_count(i.obs()))


@query("distinct_coords", duck.COORDS + " SELECT lon, lat FROM coords")
def distinct_coords(i: Inputs) -> DataFrame:
    return observe.distinct_coords(*by_survey(i.obs()))


@query("observed_ids", "SELECT DISTINCT ktsn FROM v_obs WHERE ktsn IS NOT NULL")
def observed_ids(i: Inputs) -> DataFrame:
    return observe.observed_ids(*by_survey(i.obs()))


_BAD_COUNT = "CASE WHEN ktsn % 97 = 0 THEN 'n/a' ELSE CAST(obs_count AS STRING) END"
_TEXT_YEAR = "CASE WHEN ktsn % 89 = 0 THEN '4225' WHEN year IS NULL THEN '' ELSE CAST(year AS STRING) END"


@query(
    "union_sources",
    f""", t AS (SELECT ktsn, taxon_group, region, source, {_BAD_COUNT} AS c, {_TEXT_YEAR} AS y FROM v_gagg)
    SELECT ktsn, taxon_group, region, source, CAST(c AS BIGINT) AS obs_count,
      coalesce(CASE WHEN TRY_CAST(y AS INT) BETWEEN 1900 AND 2026 THEN TRY_CAST(y AS INT) END, 0) AS year FROM t WHERE c <> 'n/a'""",
)
def union_sources(i: Inputs) -> DataFrame:
    agg = observe.with_group(observe.obs_count(i.obs()), i.check()).selectExpr(
        "ktsn", "taxon_group", "region", f"{_TEXT_YEAR} AS year", "source", f"{_BAD_COUNT} AS obs_count"
    )
    tables = by_survey(staged(agg, "aggregates"))
    return observe.union_sources(tables).withColumn("year", F.coalesce("year", F.lit(0)))


@query(
    "reconcile_equal",
    """, stored AS (SELECT ktsn, region, year, source, obs_count + CASE WHEN ktsn % 101 = 0 THEN 1 ELSE 0 END AS obs_count FROM v_agg WHERE ktsn % 103 <> 0)
    SELECT d.ktsn, d.region, coalesce(d.year, 0) AS year, d.source, d.obs_count AS derived, coalesce(s.obs_count, 0) AS stored
    FROM v_agg d LEFT JOIN stored s ON d.ktsn = s.ktsn AND d.region = s.region AND d.year IS NOT DISTINCT FROM s.year AND d.source = s.source
    WHERE d.obs_count <> coalesce(s.obs_count, 0)""",
)
def reconcile_equal(i: Inputs) -> DataFrame:
    """Against a stored copy with wrong and missing rows, so that the differences are known."""
    derived = observe.count_points(observe.distinct_points(i.obs()))
    stored = observe.obs_count(i.obs()).where("ktsn % 103 <> 0").withColumn(
        "obs_count", F.col("obs_count") + F.when(F.col("ktsn") % 101 == 0, 1).otherwise(0)
    )
    diff = quality.reconcile(derived, stored, observe.AGG_KEY)
    return diff.withColumn("year", F.coalesce("year", F.lit(0)))


@query(
    "total_preserved",
    "SELECT CAST(sum(obs_count) AS BIGINT) AS district_total, CAST(sum(obs_count) AS BIGINT) AS province_total, CAST(0 AS BIGINT) AS difference FROM v_agg",
)
def total_preserved(i: Inputs) -> DataFrame:
    district = observe.obs_count(i.obs())
    province = observe.obs_count(i.obs().withColumn("region", values.province_of(F.col("region"))))
    return quality.total_preserved(district, province)


@query(
    "dedup_occurrence",
    """, d AS (SELECT *, row_number() OVER (PARTITION BY species, eventDate, decimalLongitude, decimalLatitude ORDER BY _ord, coordinateUncertaintyInMeters) AS rn FROM v_occ)
    SELECT species, eventDate AS event_date, decimalLongitude AS lon, decimalLatitude AS lat, gbifID AS id FROM d WHERE rn = 1""",
)
def dedup_occurrence(i: Inputs) -> DataFrame:
    once = observe.dedup_occurrence(i.occ())
    return once.select(
        "species", F.col("eventDate").alias("event_date"), F.col("decimalLongitude").alias("lon"),
        F.col("decimalLatitude").alias("lat"), F.col("gbifID").alias("id"),
    )


# Tiles of the same service overlap: events of two neighbouring days come twice.
_TILES = "SELECT event_id AS id, ts, user_id, event_type FROM events"


@query("dedup_feature_id", f"SELECT id, user_id, event_type FROM ({_TILES})")
def dedup_feature_id(i: Inputs) -> DataFrame:
    e = i.table("events").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type")
    overlapping = e.where("user_id % 3 <> 0").unionByName(e.where("user_id % 2 = 0")).unionByName(e.where("user_id % 6 = 3"))
    return quality.dedup_features(overlapping, "id", "ts").select("id", "user_id", "event_type")


@query(
    "layer_census",
    """, l AS (SELECT event_type || '_' || CAST(user_id % 7 AS VARCHAR) AS layer FROM events)
    SELECT coalesce(layer, '') AS layer, count(*) AS n_features, CAST(GROUPING(layer) AS BIGINT) AS is_total FROM l GROUP BY ROLLUP (layer)""",
)
def layer_census(i: Inputs) -> DataFrame:
    layer = F.concat_ws("_", "event_type", (F.col("user_id") % 7).cast("string"))
    return quality.layer_census(i.table("events").select(layer.alias("layer")))


_CLASS_KEYS = (
    "SELECT DISTINCT {g} AS taxon_group, substring(p_brand, 7, 1) AS class_la, CAST(ascii(substring(p_brand, 7, 1)) AS INT) AS gbif_key, "
    "CASE substring(p_brand, 7, 1) WHEN '3' THEN 'NONE' WHEN '4' THEN 'HIGHERRANK' ELSE 'EXACT' END AS gbif_match FROM part"
)
_ORDER_KEYS = (
    "SELECT {g} AS taxon_group, substring(p_brand, 7, 1) AS class_la, p_brand || CAST(p_size AS STRING) AS order_la, "
    "CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size * 1000 END AS gbif_key, CASE WHEN p_size % 5 = 0 THEN 'NONE' ELSE 'EXACT' END AS gbif_match FROM part"
)
_G = "p_type"


@query(
    "taxon_key_fallback",
    f""", ck AS ({_CLASS_KEYS.format(g=_G)}), ok AS ({_ORDER_KEYS.format(g=_G)})
    SELECT taxon_group, CAST(gbif_key AS INT) AS taxon_key FROM ck WHERE gbif_key IS NOT NULL AND gbif_match NOT IN ('NONE', 'HIGHERRANK')
    UNION SELECT o.taxon_group, CAST(o.gbif_key AS INT) FROM ok o JOIN ck c ON c.taxon_group = o.taxon_group AND c.class_la = o.class_la
      AND (c.gbif_key IS NULL OR c.gbif_match IN ('NONE', 'HIGHERRANK')) WHERE o.gbif_key IS NOT NULL AND o.gbif_match NOT IN ('NONE', 'HIGHERRANK')""",
)
def taxon_key_fallback(i: Inputs) -> DataFrame:
    i.table("part").createOrReplaceTempView("lacuna_part")
    cls = i.spark.sql(_CLASS_KEYS.format(g=_G).replace("FROM part", "FROM lacuna_part"))
    order = i.spark.sql(_ORDER_KEYS.format(g=_G).replace("FROM part", "FROM lacuna_part"))
    return quality.usable_keys(cls, order)


@query(
    "set_equality_match",
    """, l AS (SELECT l_orderkey AS l_id, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY 1)
    , r AS (SELECT o_custkey AS r_id, list_sort(list(DISTINCT CAST(o_totalprice AS BIGINT) % 7 + 1)) AS s FROM orders GROUP BY 1)
    SELECT l_id, min(r_id) AS r_id, min(len(l.s)) AS n_keys FROM l JOIN (SELECT min(r_id) AS r_id, s FROM r GROUP BY s) r ON l.s = r.s GROUP BY l_id""",
)
def set_equality_match(i: Inputs) -> DataFrame:
    left = i.table("lineitem").select(F.col("l_orderkey").alias("l_id"), F.col("l_linenumber").cast("bigint").alias("k"))
    price = F.bround("o_totalprice", 0).cast("bigint")
    right = i.table("orders").select(F.col("o_custkey").alias("r_id"), (price % 7 + 1).alias("k"))
    return quality.match_equal_sets(left, right)


@query(
    "filter_region_year",
    "SELECT ktsn, source, obs_count FROM v_agg WHERE region = '12020' AND year = 1998",
)
def filter_region_year(i: Inputs) -> DataFrame:
    obs = gap.filter_region_year(i.obs(), "12020", 1998)
    return observe.obs_count(obs).select("ktsn", "source", "obs_count")
