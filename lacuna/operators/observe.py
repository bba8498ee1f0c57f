"""Observations → distinct points → counts per region, year and source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import names, values
from lacuna.operators.joins import spread_join

POINT_KEY = ["ktsn", "source", "year", "region", "lon", "lat"]
AGG_KEY = ["ktsn", "region", "year", "source"]
OCCURRENCE_COLUMNS = (
    "gbifID", "species", "scientificName", "vernacularName", "class", "order", "family", "genus", "year",
    "eventDate", "decimalLongitude", "decimalLatitude", "coordinateUncertaintyInMeters", "basisOfRecord",
    "datasetKey", "publishingOrgKey", "institutionCode", "samplingProtocol", "taxon_group",
)
# Records of these kinds are not field observations.
EXCLUDED_BASIS = ("FOSSIL_SPECIMEN", "LIVING_SPECIMEN", "MATERIAL_CITATION")
MAX_UNCERTAINTY_M = 5000


def survey_rows(raw: DataFrame) -> DataFrame:
    """Survey records → common columns. The first filled vernacular field counts."""
    lon, lat = F.get("_coords", F.lit(0)), F.get("_coords", F.lit(1))
    x, y = values.coordinate(lon, lat)
    return raw.select(
        "_ord", F.trim(F.coalesce("spcs_scncenm", F.lit(""))).alias("sci_name"),
        names.vernacular_key(names.first_filled(F.col("spcs_korean_nm"), F.col("spcs_lcnm"))).alias("kor_name"),
        values.year_from_survey(F.col("examin_year"), F.col("examin_begin_de")).alias("year"),
        "source", x.alias("lon"), y.alias("lat"),
    )


def park_rows(raw: DataFrame) -> DataFrame:
    """Park records → common columns."""
    x, y = values.coordinate(F.col("경도"), F.col("위도"))
    return raw.select(
        "_ord", F.trim(F.coalesce("종명", F.lit(""))).alias("sci_name"),
        F.trim(F.coalesce("분류명", F.lit(""))).alias("kor_name"),
        values.year_from_date(F.col("조사일자")).alias("year"), F.lit("nps").alias("source"),
        x.alias("lon"), y.alias("lat"), F.trim(F.coalesce("생물분류", F.lit(""))).alias("hint"),
    )


def occurrence_rows(raw: DataFrame) -> DataFrame:
    """Occurrence records → common columns; rows without coordinates are dropped before matching."""
    x, y = values.coordinate(F.col("decimalLongitude"), F.col("decimalLatitude"))
    rows = raw.select(
        "_ord", names.first_filled(F.col("scientificName"), F.col("species")).alias("sci_name"),
        values.year_from_event(F.col("year"), F.col("eventDate")).alias("year"), F.lit("gbif").alias("source"),
        x.alias("lon"), y.alias("lat"), F.col("taxon_group").alias("file_group"),
    )
    return rows.where("lon IS NOT NULL")


def occurrence_request(
    occ: DataFrame, taxon_keys: DataFrame, country: str, year_min: int = values.YEAR_MIN
) -> DataFrame:
    """Occurrences a download request would return: country, key set, position, presence, basis and year."""
    wanted = occ.where(
        (F.col("countryCode") == country) & F.col("hasCoordinate") & ~F.col("hasGeospatialIssue")
        & (F.col("occurrenceStatus") == "PRESENT") & ~F.col("basisOfRecord").isin(*EXCLUDED_BASIS)
        & (F.col("year") >= year_min)
    )
    return wanted.join(taxon_keys.select("taxonKey").distinct(), "taxonKey", "left_semi")


def occurrence_quality(occ: DataFrame, year_min: int = values.YEAR_MIN) -> DataFrame:
    """Rows with position and species; unknown years and uncertainties pass, bad ones do not."""
    return occ.where(
        F.col("decimalLongitude").isNotNull() & F.col("decimalLatitude").isNotNull()
        & F.col("species").isNotNull() & (F.col("species") != "")
        & (F.col("year").isNull() | (F.col("year") >= year_min))
        & (F.col("coordinateUncertaintyInMeters").isNull()
           | (F.col("coordinateUncertaintyInMeters") <= MAX_UNCERTAINTY_M))
    )


def occurrence_columns(occ: DataFrame, group: str) -> DataFrame:
    """The 19 fixed columns: absent ones are NULL, a missing vernacular is '', the group is a literal."""
    have = set(occ.columns)
    shaped = [
        F.col(f"`{c}`").cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c)
        for c in OCCURRENCE_COLUMNS[:-1]
    ]
    return occ.select(*shaped).withColumns(
        {"vernacularName": F.coalesce("vernacularName", F.lit("")), "taxon_group": F.lit(group)}
    )


def dedup_occurrence(occ: DataFrame, order: str = "_ord") -> DataFrame:
    """First full row per (species, eventDate, lon, lat); combined map-side, so a hot key stays cheap."""
    key = ["species", "eventDate", "decimalLongitude", "decimalLatitude"]
    rest = [c for c in occ.columns if c not in key]
    first = F.min(F.struct(F.col(order).alias("_first"), F.struct(*rest).alias("rec"))).alias("m")
    return occ.groupBy(*key).agg(first).select(*key, "m.rec.*")


def distinct_coords(*tables: DataFrame) -> DataFrame:
    """Distinct known positions over all tables."""
    out = tables[0].select("lon", "lat")
    for t in tables[1:]:
        out = out.unionByName(t.select("lon", "lat"))
    return out.where("lon IS NOT NULL").distinct()


def distinct_points(obs: DataFrame) -> DataFrame:
    """One row per distinct point. Rows without coordinates collapse to one point per group."""
    return obs.select(*POINT_KEY).distinct()


def count_points(points: DataFrame) -> DataFrame:
    """Distinct points → obs_count. Counts combine map-side, so a hot species is no hot task."""
    return points.groupBy(*AGG_KEY).agg(F.count(F.lit(1)).alias("obs_count"))


def obs_count(obs: DataFrame) -> DataFrame:
    """Distinct coordinates per species, region, year and source; a missing coordinate counts once.

    De-duplicated on the full point first: that shuffle spreads even one species holding a third of all rows.
    """
    return count_points(distinct_points(obs))


def with_group(rows: DataFrame, checklist: DataFrame, how: str = "inner") -> DataFrame:
    """Add taxon_group by id. Meant for counted rows; spread for row-level tables too."""
    spread_on = [c for c in rows.columns if c != "ktsn"] or ["ktsn"]
    return spread_join(rows, checklist.select("ktsn", "taxon_group"), ["ktsn"], spread_on, how)


def union_sources(tables: list[DataFrame], district: DataFrame | None = None) -> DataFrame:
    """Union of per-source aggregates; a district table, where present, replaces them.

    Rows whose count is no whole number are dropped; years outside the plausible range become unknown.
    """
    cols = ["ktsn", "taxon_group", "region", "year", "source", "obs_count"]
    out = None
    for t in [district] if district is not None else tables:
        t = t.select(*cols)
        out = t if out is None else out.unionByName(t)
    whole = F.when(F.trim(F.col("obs_count").cast("string")).rlike(r"^[+-]?\d+$"), F.col("obs_count"))
    return (
        out.withColumn("obs_count", F.trim(whole.cast("string")).try_cast("bigint"))
        .where("obs_count IS NOT NULL")
        .withColumn("year", values.clean_year(F.col("year")))
    )


def region_rollup(agg: DataFrame) -> DataFrame:
    """District → province → national totals; totals carry '' in the columns they span."""
    keyed = agg.select(values.province_of(F.col("region")).alias("province"), "region", "obs_count")
    return (
        keyed.rollup("province", "region")
        .agg(F.sum("obs_count").alias("obs_count"), F.grouping_id().cast("bigint").alias("level"))
        .withColumns(
            {"province": F.coalesce("province", F.lit("")), "region": F.coalesce("region", F.lit(""))}
        )
    )


def observed_ids(*tables: DataFrame) -> DataFrame:
    """Distinct ids with any record in any source."""
    out = tables[0].select("ktsn")
    for t in tables[1:]:
        out = out.unionByName(t.select("ktsn"))
    return out.where(F.col("ktsn").isNotNull()).distinct()


def inside_box(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows inside a bounding box, borders included."""
    return df.where(F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax))
