"""Scalar rules and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import geo, names, values
from lacuna.functions.sql import register
from lacuna.operators import observe
from lacuna.plans import duck
from lacuna.plans.registry import query
from lacuna.plans.standin import Inputs, genus, letters, species
from lacuna.streaming import ingest

# Free-text names as observers write them.
_G, _S = genus("p_partkey"), species("p_partkey")
TEXT_NAME = (
    f"CASE p_partkey % 9 WHEN 0 THEN concat({_G}, ' ', {_S}, ' L.') "
    f"WHEN 1 THEN concat({_G}, ' ', {_S}, ' var. ', 'vr', {letters('p_size')}, ' (Regel) F.Maek.') "
    f"WHEN 2 THEN concat({_G}, ' sp.') WHEN 3 THEN concat({_G}, ' ', {_S}, ' F., 1793') WHEN 4 THEN NULL WHEN 5 THEN '' "
    f"WHEN 6 THEN concat('  ', {_G}, ' (Sub) ', {_S}, ' subsp. ', {_S}, 'é f. alba x') "
    f"WHEN 7 THEN concat(upper({_G}), ' cf. ', {_S}, ' Kim & Lee') ELSE concat({_G}, '-', {_S}, '  aff. minor Cv.') END"
)
_NAMED = f", n AS (SELECT p_partkey, {TEXT_NAME} AS name FROM part)"


def _named(i: Inputs) -> DataFrame:
    return i.table("part").selectExpr("p_partkey", f"{TEXT_NAME} AS name")


@query(
    "name_tokens",
    f"{_NAMED} SELECT p_partkey, array_to_string({duck.words('name')}, '|') AS tokens, CAST(len({duck.words('name')}) AS INT) AS n_tokens FROM n",
)
def name_tokens(i: Inputs) -> DataFrame:
    t = names.name_tokens(F.col("name"))
    return _named(i).select("p_partkey", F.array_join(t, "|").alias("tokens"), F.size(t).alias("n_tokens"))


@query(
    "sci_keys",
    f"{_NAMED} SELECT p_partkey, {duck.binomial('name')} AS binom, {duck.trinomial('name')} AS trinom FROM n",
)
def sci_keys(i: Inputs) -> DataFrame:
    n = F.col("name")
    return _named(i).select("p_partkey", names.binomial(n).alias("binom"), names.trinomial(n).alias("trinom"))


@query("managed_key", f"{_NAMED} SELECT p_partkey, {duck.managed('name')} AS key FROM n")
def managed_key(i: Inputs) -> DataFrame:
    """Through the SQL function, which expands to the same built-ins."""
    register(i.spark)
    return _named(i).selectExpr("p_partkey", "managed_key(name) AS key")


@query(
    "ktsn_keys",
    f"SELECT ktsn, {duck.field_key('gnus', 'specs', 'NULL')} AS binom, "
    f"CASE WHEN trim(sspecs) <> '' THEN {duck.field_key('gnus', 'specs', 'sspecs')} END AS trinom FROM v_raw",
)
def ktsn_keys(i: Inputs) -> DataFrame:
    g, s, ss = F.col("gnus"), F.col("specs"), F.col("sspecs")
    tri = F.when(names.field_binomial(g, s).isNotNull(), names.field_trinomial(g, s, ss))
    return i.raw().select("ktsn", names.field_binomial(g, s).alias("binom"), tri.alias("trinom"))


@query(
    "norm_tokens_ws",
    f"{_NAMED} SELECT p_partkey, {duck.listed_key('name', 2)} AS binom, {duck.listed_key('name', 3)} AS trinom FROM n",
)
def norm_tokens_ws(i: Inputs) -> DataFrame:
    n = F.col("name")
    return _named(i).select("p_partkey", names.listed_key(n, 2).alias("binom"), names.listed_key(n, 3).alias("trinom"))


_SPACED = "concat(' ', replace(krn, ' ', CASE WHEN ktsn % 3 = 0 THEN ' ' WHEN ktsn % 3 = 1 THEN '　' ELSE ' ' END), '\t')"


@query("norm_vernacular", f"SELECT ktsn, {duck.vern(_SPACED)} AS key FROM v_raw")
def norm_vernacular(i: Inputs) -> DataFrame:
    return i.raw().select("ktsn", names.vernacular_key(F.expr(_SPACED)).alias("key"))


@query(
    "norm_grade",
    """, g AS (SELECT _ord, replace(replace(replace(replace(upper(trim(grade)), 'Ⅰ', 'I'), 'Ⅱ', 'II'), '급', ''), ' ', '') AS t FROM v_rated)
    SELECT _ord, CASE WHEN t IN ('I', '1') THEN 'I' WHEN t IN ('II', '2') THEN 'II' ELSE t END AS grade FROM g""",
)
def norm_grade(i: Inputs) -> DataFrame:
    return i.rated().select("_ord", names.grade(F.col("grade")).alias("grade"))


_DATE_TEXT = (
    "CASE l_orderkey % 6 WHEN 0 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) WHEN 1 THEN concat('5/1/', CAST(year(l_shipdate) AS STRING)) "
    "WHEN 2 THEN 'n.d.' WHEN 3 THEN '' WHEN 4 THEN concat('c. ', CAST(year(l_shipdate) AS STRING), '-05-xx 1234') "
    "ELSE concat(CAST(CAST(l_shipdate AS DATE) AS STRING), ' 10:00') END"
)
_LINE = "l_orderkey * 8 + l_linenumber AS id, l_partkey, l_suppkey"


@query(
    "parse_date_year",
    rf""", t AS (SELECT {_LINE}, {_DATE_TEXT} AS d FROM lineitem)
    SELECT id, l_partkey, l_suppkey, coalesce(nullif(regexp_extract(d, '^(\d{{4}})-\d{{2}}-\d{{2}}', 1), ''), regexp_extract(d, '(\d{{4}})', 1)) AS year FROM t""",
)
def parse_date_year(i: Inputs) -> DataFrame:
    t = i.table("lineitem").selectExpr(*[f"{e}" for e in _LINE.split(", ")], f"{_DATE_TEXT} AS d")
    return t.select("id", "l_partkey", "l_suppkey", values.year_from_date(F.col("d")).alias("year"))


@query(
    "year_from_fields",
    r"SELECT _ord, source, sci_name, CASE WHEN regexp_full_match(trim(examin_year), '\d{4}') THEN trim(examin_year) "
    r"ELSE regexp_extract(trim(begin_de), '^(\d{4})', 1) END AS year FROM v_survey",
)
def year_from_fields(i: Inputs) -> DataFrame:
    y = values.year_from_survey(F.col("examin_year"), F.col("begin_de"))
    return i.survey().select("_ord", "source", "sci_name", y.alias("year"))


@query(
    "year_from_event",
    r"SELECT gbifID AS id, species, coalesce(nullif(regexp_extract(coalesce(CAST(year AS VARCHAR), ''), '^(\d{4})', 1), ''), regexp_extract(eventDate, '(\d{4})', 1)) AS year FROM v_occ",
)
def year_from_event(i: Inputs) -> DataFrame:
    y = values.year_from_event(F.col("year").cast("string"), F.col("eventDate"))
    return i.occ().select(F.col("gbifID").alias("id"), "species", y.alias("year"))


@query(
    "clean_year",
    "SELECT _ord, source, coalesce(CASE WHEN TRY_CAST(trim(examin_year) AS INT) BETWEEN 1900 AND 2026 THEN TRY_CAST(trim(examin_year) AS INT) END, 0) AS year FROM v_survey",
)
def clean_year(i: Inputs) -> DataFrame:
    y = values.clean_year(F.col("examin_year"), "2026-06-29")
    return i.survey().select("_ord", "source", F.coalesce(y, F.lit(0)).alias("year"))


@query(
    "parse_coord",
    """, c AS (SELECT _ord, source, TRY_CAST(trim(lon_text) AS DOUBLE) AS x, TRY_CAST(trim(lat_text) AS DOUBLE) AS y FROM v_survey)
    , f AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y) AS ok FROM c)
    SELECT _ord, source, CASE WHEN ok THEN x END AS lon, CASE WHEN ok THEN y END AS lat FROM f""",
)
def parse_coord(i: Inputs) -> DataFrame:
    x, y = values.coordinate(F.col("lon_text"), F.col("lat_text"))
    return i.survey().select("_ord", "source", x.alias("lon"), y.alias("lat"))


@query(
    "unify_name_fields",
    "SELECT gbifID AS id, coalesce(nullif(trim(scientificName), ''), nullif(trim(species), ''), '') AS name FROM v_occ",
)
def unify_name_fields(i: Inputs) -> DataFrame:
    name = names.first_filled(F.col("scientificName"), F.col("species"))
    return i.occ().select(F.col("gbifID").alias("id"), name.alias("name"))


@query("province_of_region", "SELECT substring(region, 1, 2) AS province, count(*) AS n FROM v_obs GROUP BY 1")
def province_of_region(i: Inputs) -> DataFrame:
    return i.obs().groupBy(values.province_of(F.col("region")).alias("province")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "round_by_dec",
    f"""SELECT var, "row", col, CASE var WHEN 'bio01' THEN {duck.half_even('value', 1)} WHEN 'dem' THEN {duck.half_even('value', 2)}
      ELSE {duck.half_even('value', 0)} END AS value
    FROM v_raster WHERE value IS NOT NULL""",
)
def round_by_dec(i: Inputs) -> DataFrame:
    v = values.round_by_decimals(F.col("value"), F.col("var"), {"bio01": 1, "dem": 2})
    return i.raster().where("value IS NOT NULL").select("var", "row", "col", v.alias("value"))


@query(
    "project_tm",
    duck.COORDS
    + duck.tm("coords", "lon", "lat", "lon, lat", "a", duck.TM_5186)
    + duck.tm("coords", "lon", "lat", "lon, lat", "b", duck.TM_5179)
    + " SELECT a.lon, a.lat, round(a.px, 3) AS x5186, round(a.py, 3) AS y5186, round(b.px, 3) AS x5179, round(b.py, 3) AS y5179 "
    "FROM a JOIN b ON a.lon = b.lon AND a.lat = b.lat",
)
def project_tm(i: Inputs) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    (ax, ay), (bx, by) = geo.tm_xy(lon, lat, geo.EPSG_5186), geo.tm_xy(lon, lat, geo.EPSG_5179)
    shown = {"x5186": ax, "y5186": ay, "x5179": bx, "y5179": by}
    return observe.distinct_coords(i.obs()).select("lon", "lat", *[F.round(c, 3).alias(n) for n, c in shown.items()])


@query(
    "project_webmercator",
    duck.COORDS + " SELECT lon, lat, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y FROM coords",
)
def project_webmercator(i: Inputs) -> DataFrame:
    x, y = geo.mercator_xy(F.col("lon"), F.col("lat"))
    return observe.distinct_coords(i.obs()).select("lon", "lat", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "filter_accepted_species",
    f"SELECT ktsn, {duck.field_key('gnus', 'specs', 'sspecs')} AS match_key FROM v_raw WHERE corsyn = 'Y' AND trim(gnus) <> '' AND trim(specs) <> ''",
)
def filter_accepted_species(i: Inputs) -> DataFrame:
    from lacuna.operators.checklist import accepted_species

    return accepted_species(i.raw()).select("ktsn", "match_key")


@query(
    "filter_occurrence_request",
    """SELECT gbifID AS id, taxonKey AS taxon_key, species FROM v_occ WHERE countryCode = 'KR' AND hasCoordinate AND NOT hasGeospatialIssue
    AND occurrenceStatus = 'PRESENT' AND basisOfRecord NOT IN ('FOSSIL_SPECIMEN', 'LIVING_SPECIMEN', 'MATERIAL_CITATION') AND year >= 1900
    AND taxonKey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)""",
)
def filter_occurrence_request(i: Inputs) -> DataFrame:
    keys = i.table("supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("taxonKey"))
    got = observe.occurrence_request(i.occ(), keys, "KR")
    return got.select(F.col("gbifID").alias("id"), F.col("taxonKey").alias("taxon_key"), "species")


_QUALITY = (
    "decimalLongitude IS NOT NULL AND decimalLatitude IS NOT NULL AND species IS NOT NULL AND species <> '' AND (year IS NULL OR year >= 1900) "
    "AND (coordinateUncertaintyInMeters IS NULL OR coordinateUncertaintyInMeters <= 5000)"
)


@query("filter_occurrence_quality", f"SELECT gbifID AS id, species, coalesce(year, 0) AS year FROM v_occ WHERE {_QUALITY}")
def filter_occurrence_quality(i: Inputs) -> DataFrame:
    return observe.occurrence_quality(i.occ()).select(
        F.col("gbifID").alias("id"), "species", F.coalesce("year", F.lit(0)).alias("year")
    )


@query(
    "filter_incremental",
    "SELECT event_id, event_type, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'",
)
def filter_incremental(i: Inputs) -> DataFrame:
    return ingest.filter_since(i.table("events"), "ts", "2024-01-15").select("event_id", "event_type", "user_id")


@query(
    "bbox_filter",
    "SELECT _ord, ktsn, lon, lat FROM v_obs WHERE lon BETWEEN 125.5 AND 127.25 AND lat BETWEEN 34 AND 35.5",
)
def bbox_filter(i: Inputs) -> DataFrame:
    return observe.inside_box(i.obs(), 125.5, 34.0, 127.25, 35.5).select("_ord", "ktsn", "lon", "lat")
