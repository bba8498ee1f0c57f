"""Found, missing and dormant species: gap = checklist − observed, always computed as a complement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import values

# Red-list categories that count as threatened.
THREATENED = ("CR", "EN", "VU")
SPECIES_COLUMNS = ("ktsn", "taxon_group", "scientific_name", "korean_name", "grade", "redlist")
TABLE_CAP = 1500


def filter_group(df: DataFrame, group: str | None) -> DataFrame:
    return df if group is None else df.where(F.col("taxon_group") == group)


def filter_region_year(agg: DataFrame, region: str | None = None, year: int | None = None) -> DataFrame:
    """Optional equality filters; they reach the scan as pushed filters or partition pruning."""
    if region is not None:
        agg = agg.where(F.col("region") == region)
    if year is not None:
        agg = agg.where(F.col("year") == year)
    return agg


def found_counts(agg: DataFrame, region: str | None = None, year: int | None = None) -> DataFrame:
    """Summed counts per species after the filters."""
    return filter_region_year(agg, region, year).groupBy("ktsn").agg(F.sum("obs_count").alias("n_obs"))


def found_species(
    checklist: DataFrame, agg: DataFrame, group: str | None = None, region: str | None = None,
    year: int | None = None,
) -> DataFrame:
    species = filter_group(checklist, group).select(*SPECIES_COLUMNS)
    return species.join(found_counts(agg, region, year), "ktsn")


def gap_species(
    checklist: DataFrame, agg: DataFrame, group: str | None = None, region: str | None = None,
    year: int | None = None,
) -> DataFrame:
    """Listed species without a record under the filters. Observed ids are made distinct before the join."""
    species = filter_group(checklist, group).select(*SPECIES_COLUMNS)
    seen = filter_region_year(agg, region, year).select("ktsn").distinct()
    return species.join(seen, "ktsn", "left_anti")


def gap_headline(
    checklist: DataFrame, agg: DataFrame, group: str | None = None, region: str | None = None,
    year: int | None = None,
) -> DataFrame:
    """Listed, found, missing and graded-and-missing species."""
    species = filter_group(checklist, group).select("ktsn", "grade")
    seen = filter_region_year(agg, region, year).select("ktsn").distinct().withColumn("seen", F.lit(True))
    found = F.col("seen").isNotNull()
    return species.join(seen, "ktsn", "left").agg(
        F.count(F.lit(1)).alias("n_species"), F.count_if(found).alias("n_found"),
        F.count_if(~found).alias("n_gap"), F.count_if(~found & (F.col("grade") != "")).alias("n_graded_gap"),
    )


def gap_grid(
    checklist: DataFrame, agg: DataFrame, regions: DataFrame,
    groups: Sequence[str] | None = None, years: Sequence[int] | None = None,
) -> DataFrame:
    """Found and missing species for every group × region × year at once, empty cells included.

    Groups are those of the checklist and years those of the observations unless given: two short code lists,
    read by distinct aggregates. The complement is counted, not listed: species in the group minus distinct
    species found. The grid is built by exploding the code lists over the region list, so no join lacks an
    equality key.
    """
    if groups is None:
        groups = [r[0] for r in checklist.where("taxon_group IS NOT NULL").select("taxon_group").distinct().collect()]
    if years is None:
        years = [r[0] for r in agg.where("year IS NOT NULL").select("year").distinct().collect()]
    found = (
        agg.join(checklist.select("ktsn", "taxon_group"), "ktsn")
        .groupBy("taxon_group", "region", "year")
        .agg(F.count_distinct("ktsn").alias("n_found"))
    )
    totals = checklist.groupBy("taxon_group").agg(F.count(F.lit(1)).alias("n_species"))
    grid = (
        regions.select("region")
        .withColumn("year", F.explode(F.array(*[F.lit(y) for y in years]).cast("array<int>")))
        .withColumn("taxon_group", F.explode(F.array(*[F.lit(g) for g in groups]).cast("array<string>")))
    )
    n_found = F.coalesce("n_found", F.lit(0))
    return (
        grid.join(totals, "taxon_group")
        .join(found, ["taxon_group", "region", "year"], "left")
        .select(
            "taxon_group", "region", "year", "n_species", n_found.alias("n_found"),
            (F.col("n_species") - n_found).alias("n_gap"),
        )
    )


def grade_order(grade: Column) -> Column:
    return F.when(grade == "I", 0).when(grade == "II", 1).otherwise(2)


def korean(name: Column) -> Column:
    return F.collate(F.coalesce(name, F.lit("")), "ko")


def order_gap(gap: DataFrame) -> DataFrame:
    """Grade I, II, other; threatened first; then vernacular in Korean collation."""
    return gap.orderBy(
        grade_order(F.col("grade")), F.when(F.col("redlist").isin(*THREATENED), 0).otherwise(1),
        korean(F.col("korean_name")), "ktsn",
    )


def order_found(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("n_obs"), korean(F.col("korean_name")), "ktsn")


def table_cap(ordered: DataFrame, rows: int = TABLE_CAP) -> DataFrame:
    """On-screen cap; exports keep the full set."""
    return ordered.limit(rows)


def species_state(agg: DataFrame) -> DataFrame:
    """Latest year per observed species; 0 = observed, year unknown."""
    return agg.groupBy("ktsn").agg(F.max(F.coalesce("year", F.lit(0))).alias("last_year"))


def with_status(checklist: DataFrame, state: DataFrame, build_date: str | None = None) -> DataFrame:
    """found / dormant / undiscovered for every listed species."""
    return checklist.join(state, "ktsn", "left").withColumn(
        "status", values.discovery_status(F.col("last_year"), build_date)
    )


def rarely_found(agg: DataFrame, at_most: int) -> DataFrame:
    """Species with few records; the threshold is the caller's."""
    return agg.groupBy("ktsn").agg(F.sum("obs_count").alias("n_obs")).where(F.col("n_obs") <= at_most)


def list_red_list(checklist: DataFrame, observed: DataFrame) -> DataFrame:
    """Red-listed species and whether any source has a record."""
    seen = observed.select("ktsn").distinct().withColumn("_seen", F.lit(True))
    listed = checklist.where(F.coalesce("redlist", F.lit("")) != "").select(*SPECIES_COLUMNS)
    return listed.join(seen, "ktsn", "left").withColumn("observed", F.col("_seen").isNotNull()).drop("_seen")


def species_lookup(checklist: DataFrame, agg: DataFrame, text: str) -> DataFrame:
    """Search by any part of a name → species, regions found, link target by grade."""
    needle = text.lower()
    hit = F.lower(F.coalesce("korean_name", F.lit(""))).contains(needle) | F.lower("scientific_name").contains(needle)
    species = checklist.where(hit).select(*SPECIES_COLUMNS)
    seen = agg.groupBy("ktsn").agg(
        F.count_distinct("region").alias("n_regions"), F.sum("obs_count").alias("n_obs")
    )
    return species.join(seen, "ktsn", "left").select(
        *SPECIES_COLUMNS, F.coalesce("n_regions", F.lit(0)).alias("n_regions"),
        F.coalesce("n_obs", F.lit(0)).alias("n_obs"),
        F.when(F.col("grade").isin("I", "II"), "graded").otherwise("general").alias("link"),
    )
