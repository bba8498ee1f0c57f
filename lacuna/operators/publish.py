"""Service rules and the tables the service reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import names, values
from lacuna.operators.checklist import TAXON_GROUPS
from lacuna.operators.joins import spread_join
from lacuna.operators.ranking import number_rows
from lacuna.session import staged

# Mammal orders and families that live in the sea.
MARINE_ORDERS = ("Cetacea",)
MARINE_FAMILIES = ("Otariidae", "Phocidae", "Odobenidae", "Dugongidae", "Trichechidae")


def marine_keys(marine: DataFrame) -> DataFrame:
    return marine.select(F.trim("managed_key").alias("managed_key")).where("managed_key <> ''").distinct()


def service_flags(master: DataFrame, marine: DataFrame, observed: DataFrame) -> DataFrame:
    """in_service and exclude_reason per species: marine mammals, unrecorded marine fish, tunicates go out."""
    keyed = master.withColumn("managed_key", F.coalesce(names.managed_key(F.col("scientific_name")), F.lit("")))
    joined = spread_join(keyed, marine_keys(marine).withColumn("_sea", F.lit(True)), ["managed_key"], ["ktsn"])
    joined = joined.join(observed.select("ktsn").distinct().withColumn("_seen", F.lit(True)), "ktsn", "left")
    sea, seen = F.col("_sea").isNotNull(), F.col("_seen").isNotNull()
    by_taxonomy = F.trim("order_la").isin(*MARINE_ORDERS) | F.trim("family_la").isin(*MARINE_FAMILIES)
    listed = F.coalesce(F.trim("redlist"), F.lit("")) != ""
    group = F.trim("taxon_group")
    reason = (
        F.when((group == "MM") & (by_taxonomy | sea), "marine_mammal")
        .when((group == "-P") & sea & ~seen & ~listed, "marine_fish_unrecorded")
        .when(group == "UC", "tunicate_marine")
        .otherwise("")
    )
    return joined.select(
        "ktsn", group.alias("taxon_group"), F.trim(F.coalesce("korean_name", F.lit(""))).alias("korean_name"),
        F.trim("scientific_name").alias("scientific_name"), (reason == "").alias("in_service"),
        reason.alias("exclude_reason"),
    )


def in_service(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of species in service, in a named group."""
    out = flags.where(~F.col("in_service")).select("ktsn")
    return rows.where(F.coalesce("taxon_group", F.lit("")) != "").join(out, "ktsn", "left_anti")


def group_order(group: Column) -> Column:
    order = F.lit(len(TAXON_GROUPS))
    for i, code in enumerate(TAXON_GROUPS):
        order = F.when(group == code, i).otherwise(order)
    return order


def taxa_summary(checklist: DataFrame, agg: DataFrame) -> DataFrame:
    """Per group: species, observed species, records, has_data; fixed order first, then first appearance."""
    listed = checklist.groupBy("taxon_group").agg(
        F.count(F.lit(1)).alias("n_species"), F.min("_ord").alias("_first")
    )
    seen = agg.groupBy("taxon_group").agg(
        F.count_distinct("ktsn").alias("n_obs_species"), F.sum("obs_count").alias("n_records")
    )
    n = F.coalesce("n_records", F.lit(0))
    return (
        listed.join(seen, "taxon_group", "left")
        .orderBy(group_order(F.col("taxon_group")), "_first")
        .select(
            "taxon_group", "n_species", F.coalesce("n_obs_species", F.lit(0)).alias("n_obs_species"),
            n.alias("n_records"), (n > 0).alias("has_data"),
        )
    )


def obs_meta(agg: DataFrame) -> DataFrame:
    """Per group: sorted years, regions, sources, records and observed species.

    The collected sets are code lists (years since 1900, districts, sources), bounded whatever the data.
    """
    known_year = F.when(F.coalesce("year", F.lit(0)) > 0, F.col("year"))
    return agg.groupBy("taxon_group").agg(
        F.sort_array(F.collect_set(known_year)).alias("years"),
        F.sort_array(F.collect_set("region")).alias("regions"),
        F.sort_array(F.collect_set(F.nullif(F.col("source"), F.lit("")))).alias("sources"),
        F.sum("obs_count").alias("n_records"), F.count_distinct("ktsn").alias("n_obs_species"),
    )


def group_detail(checklist: DataFrame, agg: DataFrame, group: str) -> DataFrame:
    """One group's species, aggregate rows and records per source; the '' row is the total."""
    species = checklist.where(F.col("taxon_group") == group)
    rows = agg.drop("taxon_group").join(species.select("ktsn"), "ktsn")
    per_source = (
        rows.rollup("source")
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("obs_count").alias("n_records"),
            F.count_distinct("ktsn").alias("n_obs_species"), F.grouping_id().cast("bigint").alias("is_total"),
        )
        .withColumn("source", F.coalesce("source", F.lit("")))
    )
    return per_source.withColumn("taxon_group", F.lit(group))


def species_index(checklist: DataFrame) -> DataFrame:
    """Search index in (group, vernacular or scientific name) order."""
    return checklist.select(
        "ktsn", F.coalesce("korean_name", F.lit("")).alias("korean_name"), "scientific_name", "taxon_group",
        "grade", "redlist",
    ).orderBy("taxon_group", F.coalesce(F.nullif(F.col("korean_name"), F.lit("")), F.col("scientific_name")), "ktsn")


def dense_index(rows: DataFrame, value: str, order: str = "_ord", group: str = "taxon_group") -> DataFrame:
    """0-based dictionary index of `value` per group, by first appearance."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("_first"))
    return number_rows(first, [group], "_first", "idx", ties=[value]).drop("_first")


@dataclass(frozen=True)
class Encoded:
    """Dictionary-encoded observations with their species and region dictionaries."""

    rows: DataFrame
    species: DataFrame
    regions: DataFrame


def encode_observations(rows: DataFrame, order: str = "_ord") -> Encoded:
    """Species and region replaced by their dictionary index, the year by 0 when unknown.

    The dictionaries are written first: both directions read them, and their size decides the joins.
    """
    species = staged(dense_index(rows, "ktsn", order), "species-index")
    regions = staged(dense_index(rows, "region", order), "region-index")
    spread_on = [c for c in rows.columns if c not in ("taxon_group", "region")]
    coded = spread_join(rows, species.withColumnRenamed("idx", "k_idx"), ["taxon_group", "ktsn"], spread_on, "inner")
    coded = spread_join(coded, regions.withColumnRenamed("idx", "s_idx"), ["taxon_group", "region"], spread_on, "inner")
    shown = coded.select("taxon_group", "k_idx", "s_idx", F.coalesce("year", F.lit(0)).alias("year"), "obs_count")
    return Encoded(shown, species, regions)


def decode_observations(coded: Encoded) -> DataFrame:
    """Inverse of encode_observations; the year 0 becomes unknown (NULL)."""
    k = coded.species.withColumnRenamed("idx", "k_idx")
    s = coded.regions.withColumnRenamed("idx", "s_idx")
    spread_on = coded.rows.columns
    out = spread_join(coded.rows, k, ["taxon_group", "k_idx"], spread_on, "inner")
    out = spread_join(out, s, ["taxon_group", "s_idx"], spread_on, "inner")
    return out.select("taxon_group", "ktsn", "region", F.nullif(F.col("year"), F.lit(0)).alias("year"), "obs_count")


def serve_observations(agg: DataFrame, build_date: str | None = None) -> DataFrame:
    """Aggregate in served form: plausible years only, source dropped but not re-summed."""
    return agg.select(
        "taxon_group", "ktsn", "region", values.clean_year(F.col("year"), build_date).alias("year"), "obs_count"
    )
