"""Found / gap / dormant queries, orders, service tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import values
from lacuna.operators import gap, observe, publish
from lacuna.plans import duck
from lacuna.plans.registry import query
from lacuna.plans.standin import Inputs
from lacuna.session import scratch_path, staged
from lacuna.sources import readers, writers

REGION, YEAR, GROUP = "12020", 1998, "MM"
BUILD = "2010-06-29"
_SP = "c.ktsn, c.taxon_group, c.scientific_name, c.korean_name, c.grade, c.redlist"


def agg(i: Inputs, region: str | None = None, year: int | None = None) -> DataFrame:
    """Counts; the filters act on the records, before anything is shuffled."""
    return observe.obs_count(gap.filter_region_year(i.obs(), region, year))


def group_agg(i: Inputs) -> DataFrame:
    return observe.with_group(agg(i), i.check())


_SEEN = f"SELECT ktsn FROM v_agg WHERE region = '{REGION}' AND year = {YEAR}"
_GAP = f"SELECT {_SP} FROM v_check c WHERE c.taxon_group = '{GROUP}' AND c.ktsn NOT IN ({_SEEN})"
_FOUND = (
    f"SELECT {_SP}, CAST(sum(a.obs_count) AS BIGINT) AS n_obs FROM v_check c JOIN v_agg a ON a.ktsn = c.ktsn "
    f"WHERE c.taxon_group = '{GROUP}' AND a.region = '{REGION}' AND a.year = {YEAR} GROUP BY {_SP}"
)


def gap_rows(i: Inputs) -> DataFrame:
    return gap.gap_species(i.check(), gap.filter_region_year(i.obs(), REGION, YEAR), GROUP)


def found_rows(i: Inputs) -> DataFrame:
    return gap.found_species(i.check(), agg(i, REGION, YEAR), GROUP)


@query("gap_species", _GAP)
def gap_species(i: Inputs) -> DataFrame:
    return gap_rows(i)


@query("gap_order", _GAP)
def gap_order(i: Inputs) -> DataFrame:
    return gap.order_gap(gap_rows(i))


@query("find_undiscovered_species", f"SELECT {_SP} FROM v_check c WHERE c.ktsn NOT IN (SELECT ktsn FROM v_agg WHERE year = 1999)")
def find_undiscovered_species(i: Inputs) -> DataFrame:
    return gap.gap_species(i.check(), i.obs(), year=1999)


@query("found_species", _FOUND)
def found_species(i: Inputs) -> DataFrame:
    return found_rows(i)


@query("found_order", _FOUND)
def found_order(i: Inputs) -> DataFrame:
    return gap.order_found(found_rows(i))


@query("table_cap", f"SELECT {_SP} FROM v_check c WHERE c.redlist <> '' ORDER BY c.ktsn LIMIT 1500")
def table_cap(i: Inputs) -> DataFrame:
    """The on-screen cap itself, over the red-listed species in id order."""
    listed = i.check().where("redlist <> ''").select(*gap.SPECIES_COLUMNS)
    return gap.table_cap(listed.orderBy("ktsn"))


@query("found_counts", f"SELECT ktsn, CAST(sum(obs_count) AS BIGINT) AS n_obs FROM v_agg WHERE year = {YEAR} GROUP BY ktsn")
def found_counts(i: Inputs) -> DataFrame:
    return gap.found_counts(agg(i, year=YEAR))


@query(
    "gap_headline",
    f""", s AS (SELECT DISTINCT ktsn FROM v_agg WHERE region = '{REGION}' AND year = {YEAR})
    SELECT count(*) AS n_species, count(s.ktsn) AS n_found, count(*) - count(s.ktsn) AS n_gap,
      count(*) FILTER (s.ktsn IS NULL AND c.grade <> '') AS n_graded_gap
    FROM v_check c LEFT JOIN s ON s.ktsn = c.ktsn WHERE c.taxon_group = '{GROUP}'""",
)
def gap_headline(i: Inputs) -> DataFrame:
    return gap.gap_headline(i.check(), i.obs(), GROUP, REGION, YEAR)


_GRID = """
, rg AS (SELECT DISTINCT region FROM v_obs), yr AS (SELECT DISTINCT year FROM v_obs WHERE year IS NOT NULL)
, t AS (SELECT taxon_group, count(*) AS n_species FROM v_check GROUP BY 1)
, f AS (SELECT c.taxon_group, a.region, a.year, count(DISTINCT a.ktsn) AS n_found FROM v_agg a JOIN v_check c ON c.ktsn = a.ktsn GROUP BY 1, 2, 3)
, grid AS (SELECT t.taxon_group, rg.region, CAST(yr.year AS INT) AS year, t.n_species, coalesce(f.n_found, 0) AS n_found, t.n_species - coalesce(f.n_found, 0) AS n_gap
  FROM t CROSS JOIN rg CROSS JOIN yr LEFT JOIN f ON f.taxon_group = t.taxon_group AND f.region = rg.region AND f.year = yr.year)"""


def grid(i: Inputs) -> DataFrame:
    regions = i.obs().select("region").distinct()
    seen = i.obs().select("ktsn", "region", "year").distinct()
    return gap.gap_grid(i.check(), seen, regions)


@query("gap_grid", _GRID + " SELECT * FROM grid")
def gap_grid(i: Inputs) -> DataFrame:
    return grid(i)


@query(
    "region_gap_summary",
    _GRID + " SELECT region, CAST(sum(n_found) AS BIGINT) AS found_cells, CAST(sum(n_gap) AS BIGINT) AS gap_cells FROM grid GROUP BY region",
)
def region_gap_summary(i: Inputs) -> DataFrame:
    return grid(i).groupBy("region").agg(F.sum("n_found").alias("found_cells"), F.sum("n_gap").alias("gap_cells"))


@query("species_state", "SELECT ktsn, max(coalesce(year, 0)) AS last_year FROM v_obs GROUP BY ktsn")
def species_state(i: Inputs) -> DataFrame:
    return gap.species_state(i.obs())


_STATUS = """
, st AS (SELECT ktsn, max(coalesce(year, 0)) AS last_year FROM v_obs GROUP BY ktsn)
, stat AS (SELECT c.*, s.last_year, CASE WHEN s.last_year IS NULL THEN 'undiscovered' WHEN s.last_year > 2000 THEN 'found' ELSE 'dormant' END AS status
  FROM v_check c LEFT JOIN st s ON s.ktsn = c.ktsn)"""


@query("discovery_status", _STATUS + " SELECT ktsn, taxon_group, coalesce(last_year, -1) AS last_year, status FROM stat")
def discovery_status(i: Inputs) -> DataFrame:
    state = gap.species_state(i.obs())
    got = gap.with_status(i.check(), state, BUILD)
    return got.select("ktsn", "taxon_group", F.coalesce("last_year", F.lit(-1)).alias("last_year"), "status")


@query(
    "get_species_status",
    _STATUS + """, n AS (SELECT ktsn, CAST(sum(obs_count) AS BIGINT) AS n_obs FROM v_agg GROUP BY ktsn)
    SELECT s.ktsn, s.scientific_name, s.status, coalesce(n.n_obs, 0) AS n_obs FROM stat s LEFT JOIN n ON n.ktsn = s.ktsn""",
)
def get_species_status(i: Inputs) -> DataFrame:
    state = agg(i).groupBy("ktsn").agg(F.max(F.coalesce("year", F.lit(0))).alias("last_year"), F.sum("obs_count").alias("n_obs"))
    got = gap.with_status(i.check(), state, BUILD)
    return got.select("ktsn", "scientific_name", "status", F.coalesce("n_obs", F.lit(0)).alias("n_obs"))


@query("rarely_found", "SELECT ktsn, CAST(sum(obs_count) AS BIGINT) AS n_obs FROM v_agg GROUP BY ktsn HAVING sum(obs_count) <= 25")
def rarely_found(i: Inputs) -> DataFrame:
    return gap.rarely_found(agg(i), 25)


@query(
    "list_red_list",
    f"SELECT {_SP}, c.ktsn IN (SELECT ktsn FROM v_obs) AS observed FROM v_check c WHERE c.redlist <> ''",
)
def list_red_list(i: Inputs) -> DataFrame:
    return gap.list_red_list(i.check(), i.obs())


_LOOKUP = f"""
, s AS (SELECT ktsn, count(DISTINCT region) AS n_regions, CAST(sum(obs_count) AS BIGINT) AS n_obs FROM v_agg GROUP BY ktsn)
SELECT {_SP}, coalesce(s.n_regions, 0) AS n_regions, coalesce(s.n_obs, 0) AS n_obs,
  CASE WHEN c.grade IN ('I', 'II') THEN 'graded' ELSE 'general' END AS link
FROM v_check c LEFT JOIN s ON s.ktsn = c.ktsn WHERE contains(lower(c.korean_name), '{{0}}') OR contains(lower(c.scientific_name), '{{0}}')"""


@query("species_lookup", _LOOKUP.format("나무"))
def species_lookup(i: Inputs) -> DataFrame:
    return gap.species_lookup(i.check(), agg(i), "나무")


@query("search_species", _LOOKUP.format("gnb"))
def search_species(i: Inputs) -> DataFrame:
    return gap.species_lookup(i.check(), agg(i), "GnB")


@query(
    "rarity_to_category",
    """, n AS (SELECT ktsn, CAST(sum(obs_count) AS BIGINT) AS n FROM v_agg GROUP BY ktsn)
    SELECT ktsn, CAST(least(5, greatest(1, 6 - floor(n / 8))) AS INT) AS rarity,
      CASE CAST(least(5, greatest(1, 6 - floor(n / 8))) AS INT) WHEN 1 THEN 'LC' WHEN 2 THEN 'NT' WHEN 3 THEN 'VU' WHEN 4 THEN 'EN' ELSE 'CR' END AS category FROM n""",
)
def rarity_to_category(i: Inputs) -> DataFrame:
    counts = gap.found_counts(agg(i))
    rarity = F.least(F.lit(5), F.greatest(F.lit(1), F.lit(6) - F.floor(F.col("n_obs") / 8))).cast("int")
    rated = counts.select("ktsn", rarity.alias("rarity"))
    return rated.withColumn("category", values.rarity_to_category(F.col("rarity")))


@query("agg_order", "SELECT taxon_group, region, coalesce(year, 0) AS year, ktsn, source, obs_count FROM v_gagg")
def agg_order(i: Inputs) -> DataFrame:
    ordered = group_agg(i).orderBy("taxon_group", "region", "year", F.desc("obs_count"), "ktsn", "source")
    return ordered.select("taxon_group", "region", F.coalesce("year", F.lit(0)).alias("year"), "ktsn", "source", "obs_count")


@query("species_index", "SELECT ktsn, korean_name, scientific_name, taxon_group, grade, redlist FROM v_check")
def species_index(i: Inputs) -> DataFrame:
    return publish.species_index(i.check())


# Marine list: names of customers' favourite species.
_MARINE = "SELECT DISTINCT lower(concat('Gn', translate(CAST(CAST(floor(c_custkey / 4) AS BIGINT) % 197 AS STRING), '0123456789', 'abcdefghij'), ' sp', translate(CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING), '0123456789', 'abcdefghij'))) AS managed_key FROM {t} WHERE c_nationkey < 9"
_FLAGS = f"""
, marine AS ({_MARINE.format(t='customer')}), seen AS (SELECT DISTINCT ktsn FROM v_obs)
, fl AS (SELECT c.ktsn, c.taxon_group, c.korean_name, c.scientific_name,
    CASE WHEN c.taxon_group = 'MM' AND (c.order_la = 'Cetacea' OR c.family_la IN ('Otariidae', 'Phocidae', 'Odobenidae', 'Dugongidae', 'Trichechidae') OR m.managed_key IS NOT NULL) THEN 'marine_mammal'
         WHEN c.taxon_group = '-P' AND m.managed_key IS NOT NULL AND s.ktsn IS NULL AND c.redlist = '' THEN 'marine_fish_unrecorded'
         WHEN c.taxon_group = 'UC' THEN 'tunicate_marine' ELSE '' END AS exclude_reason
  FROM v_check c LEFT JOIN marine m ON m.managed_key = {duck.managed('c.scientific_name')} LEFT JOIN seen s ON s.ktsn = c.ktsn)"""


def marine(i: Inputs) -> DataFrame:
    i.table("customer").createOrReplaceTempView("lacuna_customer")
    return publish.marine_keys(i.spark.sql(_MARINE.format(t="lacuna_customer")))


def flags(i: Inputs) -> DataFrame:
    return publish.service_flags(i.check(), marine(i), i.obs())


@query("marine_keys", f"SELECT managed_key FROM ({_MARINE.format(t='customer')})")
def marine_keys(i: Inputs) -> DataFrame:
    return marine(i)


@query("service_flags", _FLAGS + " SELECT ktsn, taxon_group, korean_name, scientific_name, exclude_reason = '' AS in_service, exclude_reason FROM fl")
def service_flags(i: Inputs) -> DataFrame:
    return flags(i)


@query("filter_service", _FLAGS + " SELECT ktsn, taxon_group FROM fl WHERE exclude_reason = ''")
def filter_service(i: Inputs) -> DataFrame:
    return publish.in_service(i.check(), flags(i)).select("ktsn", "taxon_group")


@query(
    "taxa_summary",
    """, l AS (SELECT taxon_group, count(*) AS n_species FROM v_check GROUP BY 1)
    , s AS (SELECT taxon_group, count(DISTINCT ktsn) AS n_obs_species, CAST(sum(obs_count) AS BIGINT) AS n_records FROM v_gagg GROUP BY 1)
    SELECT l.taxon_group, l.n_species, coalesce(s.n_obs_species, 0) AS n_obs_species, coalesce(s.n_records, 0) AS n_records,
      coalesce(s.n_records, 0) > 0 AS has_data FROM l LEFT JOIN s ON s.taxon_group = l.taxon_group""",
)
def taxa_summary(i: Inputs) -> DataFrame:
    return publish.taxa_summary(i.check(), group_agg(i))


@query(
    "obs_meta",
    """SELECT taxon_group, array_to_string(list_sort(list(DISTINCT year) FILTER (year > 0)), ',') AS years,
      array_to_string(list_sort(list(DISTINCT region)), ',') AS regions, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
      CAST(sum(obs_count) AS BIGINT) AS n_records, count(DISTINCT ktsn) AS n_obs_species FROM v_gagg GROUP BY taxon_group""",
)
def obs_meta(i: Inputs) -> DataFrame:
    meta = publish.obs_meta(group_agg(i))
    return meta.withColumns({c: F.array_join(c, ",") for c in ("years", "regions", "sources")})


@query(
    "group_detail_meta",
    f"""SELECT '{GROUP}' AS taxon_group, coalesce(source, '') AS source, count(*) AS n_rows, CAST(sum(obs_count) AS BIGINT) AS n_records,
      count(DISTINCT ktsn) AS n_obs_species, CAST(GROUPING(source) AS BIGINT) AS is_total FROM v_gagg WHERE taxon_group = '{GROUP}' GROUP BY ROLLUP (source)""",
)
def group_detail_meta(i: Inputs) -> DataFrame:
    return publish.group_detail(i.check(), agg(i), GROUP)


_ORDERED = "SELECT a.*, min(a.ktsn * 100000 + CAST(a.region AS BIGINT)) OVER (PARTITION BY a.ktsn, a.region) AS _ord FROM v_gagg a"


def ordered_agg(i: Inputs) -> DataFrame:
    return group_agg(i).withColumn("_ord", F.col("ktsn") * 100000 + F.col("region").cast("bigint"))


_DENSE = f"""
, o AS ({_ORDERED}), k1 AS (SELECT taxon_group, ktsn, min(_ord) AS f FROM o GROUP BY 1, 2), s1 AS (SELECT taxon_group, region, min(_ord) AS f FROM o GROUP BY 1, 2)
, ki AS (SELECT taxon_group, ktsn, row_number() OVER (PARTITION BY taxon_group ORDER BY f, ktsn) - 1 AS idx FROM k1)
, si AS (SELECT taxon_group, region, row_number() OVER (PARTITION BY taxon_group ORDER BY f, region) - 1 AS idx FROM s1)"""


@query(
    "dense_index",
    _DENSE + " SELECT taxon_group, 'k' AS kind, CAST(ktsn AS VARCHAR) AS value, idx FROM ki UNION ALL SELECT taxon_group, 's', region, idx FROM si",
)
def dense_index(i: Inputs) -> DataFrame:
    rows = staged(ordered_agg(i), "served")
    k = publish.dense_index(rows, "ktsn").select("taxon_group", F.lit("k").alias("kind"), F.col("ktsn").cast("string").alias("value"), "idx")
    s = publish.dense_index(rows, "region").select("taxon_group", F.lit("s").alias("kind"), F.col("region").alias("value"), "idx")
    return k.unionByName(s)


@query("decode_obs", "SELECT taxon_group, ktsn, region, coalesce(year, 0) AS year, obs_count FROM v_gagg")
def decode_obs(i: Inputs) -> DataFrame:
    rows = staged(ordered_agg(i), "served")
    back = publish.decode_observations(publish.encode_observations(rows))
    return back.withColumn("year", F.coalesce("year", F.lit(0)))


@query("sink_csv", "SELECT ktsn, region, source, coalesce(year, 0) AS year, obs_count FROM v_agg")
def sink_csv(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "agg")
    writers.write_csv(agg(i), path)
    back = readers.scan_csv(i.spark, path)
    return back.select(
        F.col("ktsn").cast("bigint").alias("ktsn"), "region", "source",
        F.coalesce(F.col("year").cast("int"), F.lit(0)).alias("year"), F.col("obs_count").cast("bigint").alias("obs_count"),
    )


@query(
    "sink_points",
    "SELECT DISTINCT c.taxon_group, o.ktsn, o.source, coalesce(o.year, 0) AS year, o.region, o.lon, o.lat FROM v_obs o JOIN v_check c ON c.ktsn = o.ktsn",
)
def sink_points(i: Inputs) -> DataFrame:
    """Point store written and read back, all groups."""
    path = scratch_path(i.spark, "points")
    writers.write_points(observe.with_group(observe.distinct_points(i.obs()), i.check()), path)
    back = i.spark.read.schema(
        "ktsn bigint, source string, year int, region string, lon double, lat double, taxon_group string"
    ).parquet(path)
    return back.select("taxon_group", "ktsn", "source", F.coalesce("year", F.lit(0)).alias("year"), "region", "lon", "lat")


@query("sink_obs_by_group", "SELECT taxon_group, ktsn, region, coalesce(year, 0) AS year, obs_count FROM v_gagg")
def sink_obs_by_group(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "served")
    writers.write_by_group(publish.serve_observations(group_agg(i), BUILD), path)
    return i.spark.read.parquet(path).select("taxon_group", "ktsn", "region", F.coalesce("year", F.lit(0)).alias("year"), "obs_count")


@query(
    "export_checklist",
    f"""SELECT korean_name AS "국명", scientific_name AS "학명", CASE WHEN grade <> '' THEN grade || '급' ELSE '' END AS "멸종위기등급", redlist AS "적색목록",
      CAST(n_obs AS VARCHAR) AS "발견횟수" FROM ({_FOUND})""",
)
def export_checklist(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "export")
    writers.export_checklist(gap.order_found(found_rows(i)), path, found=True)
    back = readers.scan_csv(i.spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])
