"""Checklist master, folded aliases, synonyms and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import names
from lacuna.operators.joins import spread_join

# Taxon group codes in display order with their Korean names.
TAXON_GROUPS = {
    "MM": "포유류", "AV": "조류", "RP": "파충류", "AM": "양서류", "-P": "어류", "UC": "미삭동물",
    "CC": "두삭동물", "IV": "무척추동물(곤충제외)", "IN": "곤충류", "VP": "관속식물", "MS": "선태류",
}
RANK_SPECIES, RANK_SUBSPECIES = "종", "아종"
FOLD_RANK = "변종/품종"


def with_keys(raw: DataFrame) -> DataFrame:
    """Add match_key (NULL below species level) to raw checklist records."""
    return raw.withColumn("match_key", names.field_key(F.col("gnus"), F.col("specs"), F.col("sspecs")))


def accepted_species(raw: DataFrame) -> DataFrame:
    """Accepted records that name at least genus and species."""
    return with_keys(raw.where(F.col("corsyn") == "Y")).where(F.col("match_key").isNotNull())


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def canonical_score() -> Column:
    """2 for a record without a variety, 1 more when its rank fits the key."""
    is_subspecies_key = F.size(F.split("match_key", " ")) == 3
    fits = is_subspecies_key != _blank(F.col("sspecs"))
    return F.when(_blank(F.col("vrty")), 2).otherwise(0) + F.when(fits, 1).otherwise(0)


def canonical_pick(accepted: DataFrame) -> DataFrame:
    """One record per match_key: best score, then lowest id, then first read.

    A maximum over an ordering struct is combined map-side, so a key with very many members does not
    gather in one task as it would under a ranking window.
    """
    rest = [c for c in accepted.columns if c != "match_key"]
    best = F.max(
        F.struct(
            canonical_score().alias("score"), (-F.col("ktsn")).alias("low_id"), (-F.col("_ord")).alias("first"),
            F.struct(*rest).alias("rec"),
        )
    )
    picked = accepted.groupBy("match_key").agg(best.alias("b")).select("match_key", "b.score", "b.rec.*")
    return picked


def scientific_name() -> Column:
    is_sub = F.size(F.split("match_key", " ")) == 3
    return F.concat_ws(
        " ", F.trim("gnus"), F.trim("specs"), F.when(is_sub, F.nullif(F.trim("sspecs"), F.lit("")))
    )


def rank() -> Column:
    return F.when(F.size(F.split("match_key", " ")) == 3, RANK_SUBSPECIES).otherwise(RANK_SPECIES)


def group_label(group: Column) -> Column:
    out = group
    for code, label in TAXON_GROUPS.items():
        out = F.when(group == code, label).otherwise(out)
    return out


def build_master(raw: DataFrame) -> DataFrame:
    """Checklist master without ratings."""
    return canonical_pick(accepted_species(raw)).select(
        "_ord", "ktsn", scientific_name().alias("scientific_name"), "match_key",
        F.coalesce("krn", F.lit("")).alias("korean_name"),
        F.coalesce("txgrp", F.lit("")).alias("taxon_group"),
        group_label(F.coalesce("txgrp", F.lit(""))).alias("taxon_group_kor"), rank().alias("rank"),
        F.coalesce("class_la", F.lit("")).alias("class_la"), F.coalesce("order_la", F.lit("")).alias("order_la"),
        F.coalesce("family_la", F.lit("")).alias("family_la"), F.trim("gnus").alias("genus_la"),
        F.coalesce("egspcs", F.lit("")).alias("egspcs_yn"),
    )


def fold_aliases(raw: DataFrame) -> DataFrame:
    """Names of records folded into another accepted record, as (alias_name, alias_type, accepted …).

    Only names that differ from the accepted one and that no master record bears.
    """
    accepted = accepted_species(raw)
    master = build_master(raw)
    canon = master.select(
        "match_key", F.col("ktsn").alias("accepted_ktsn"), F.col("korean_name").alias("accepted_korean"),
        F.col("scientific_name").alias("accepted_scientific"), "taxon_group",
    )
    members = spread_join(accepted, canon, ["match_key"], ["ktsn", "_ord"], "inner").where(
        F.col("ktsn") != F.col("accepted_ktsn")
    )
    lower = F.coalesce(F.nullif(F.col("vrty"), F.lit("")), F.col("sspecs"), F.lit(""))
    sci_name = F.concat_ws(
        " ", *[F.nullif(F.trim(c), F.lit("")) for c in (F.col("gnus"), F.col("specs"), lower)]
    )
    kept = ["accepted_ktsn", "accepted_korean", "accepted_scientific", "taxon_group"]
    kor = members.select(
        F.lit("kor").alias("alias_type"), F.trim(F.coalesce("krn", F.lit(""))).alias("alias_name"),
        names.vernacular_key(F.col("krn")).alias("key"), names.vernacular_key(F.col("accepted_korean")).alias("own"),
        "_ord", *kept,
    )
    sci = members.select(
        F.lit("sci").alias("alias_type"), sci_name.alias("alias_name"),
        F.coalesce(names.managed_key(sci_name), F.lit("")).alias("key"), F.col("match_key").alias("own"),
        "_ord", *kept,
    )
    differing = kor.unionByName(sci).where((F.col("key") != "") & (F.col("key") != F.col("own")))
    unique = differing.groupBy("alias_type", "key", *kept).agg(
        F.min_by("alias_name", "_ord").alias("alias_name"), F.min("_ord").alias("_ord")
    )
    taken = (
        master.select(F.lit("sci").alias("alias_type"), F.col("match_key").alias("key"))
        .unionByName(
            master.select(
                F.lit("kor").alias("alias_type"), names.vernacular_key(F.col("korean_name")).alias("key")
            )
        )
        .distinct()
    )
    return unique.join(taken, ["alias_type", "key"], "left_anti").withColumn("alias_rank", F.lit(FOLD_RANK))


def synonyms(raw: DataFrame, master: DataFrame) -> DataFrame:
    """Names of non-accepted records that point to an accepted species in the master."""
    pointing = raw.where(
        (F.col("corsyn") == "N") & F.col("specs_ktsn").isNotNull() & (F.col("specs_ktsn") != F.col("ktsn"))
    ).withColumnRenamed("specs_ktsn", "accepted_ktsn")
    target = master.select(
        F.col("ktsn").alias("accepted_ktsn"), F.trim("korean_name").alias("accepted_korean"),
        F.trim("scientific_name").alias("accepted_scientific"), "taxon_group",
    )
    joined = spread_join(pointing, target, ["accepted_ktsn"], ["ktsn", "_ord"], "inner")
    kept = ["accepted_ktsn", "accepted_korean", "accepted_scientific", "taxon_group"]
    kor = joined.select(
        F.lit("kor").alias("alias_type"), F.trim(F.coalesce("krn", F.lit(""))).alias("alias_name"),
        names.vernacular_key(F.col("krn")).alias("key"), names.vernacular_key(F.col("accepted_korean")).alias("own"),
        "_ord", *kept,
    )
    sci = joined.select(
        F.lit("sci").alias("alias_type"), F.trim("stnm").alias("alias_name"),
        F.coalesce(names.managed_key(F.col("stnm")), F.lit("")).alias("key"),
        F.coalesce(names.managed_key(F.col("accepted_scientific")), F.lit("")).alias("own"), "_ord", *kept,
    )
    differing = kor.unionByName(sci).where((F.col("key") != "") & (F.col("key") != F.col("own")))
    return (
        differing.groupBy("key", *kept)
        .agg(
            F.min_by("alias_type", F.struct("_ord", "alias_type")).alias("alias_type"),
            F.min_by("alias_name", F.struct("_ord", "alias_type")).alias("alias_name"),
            F.min("_ord").alias("_ord"),
        )
        .withColumn("alias_rank", F.lit("corsyn"))
        .withColumn("source", F.lit("ktsn_corsyn"))
    )


def rating_lookup(rows: DataFrame, value: str, sci: str = "sci_name", kor: str = "kor_name") -> DataFrame:
    """(key_type, key) → value, first row wins."""
    keyed = rows.select(
        "_ord", F.trim(F.coalesce(value, F.lit(""))).alias("value"),
        F.coalesce(names.managed_key(F.col(sci)), F.lit("")).alias("sci"),
        names.vernacular_key(F.col(kor)).alias("kor"),
    )
    both = keyed.select("_ord", "value", F.lit("sci").alias("key_type"), F.col("sci").alias("key")).unionByName(
        keyed.select("_ord", "value", F.lit("kor").alias("key_type"), F.col("kor").alias("key"))
    )
    return both.where("key <> ''").groupBy("key_type", "key").agg(F.min_by("value", "_ord").alias("value"))


def join_rating(master: DataFrame, lookup: DataFrame, out: str) -> DataFrame:
    """Add `out` and `out_by` (sci / kor / ''): the name key first, the vernacular when that has no value."""
    by_sci = lookup.where("key_type = 'sci'").select(F.col("key").alias("match_key"), F.col("value").alias("_s"))
    by_kor = lookup.where("key_type = 'kor'").select(F.col("key").alias("_kor"), F.col("value").alias("_k"))
    keyed = master.withColumn("_kor", names.vernacular_key(F.col("korean_name")))
    joined = spread_join(keyed, by_sci, ["match_key"], ["ktsn"])
    joined = spread_join(joined, by_kor, ["_kor"], ["ktsn"])
    value = F.coalesce(F.nullif(F.col("_s"), F.lit("")), F.col("_k"), F.lit(""))
    by = F.when(value == "", "").when(F.col("_s").isNotNull(), "sci").otherwise("kor")
    return joined.withColumn(out, value).withColumn(f"{out}_by", by).drop("_s", "_k", "_kor")


def master_profile(master: DataFrame) -> DataFrame:
    """Species, endangered, red-listed, rank and provenance counts per group."""
    return master.groupBy("taxon_group").agg(
        F.count(F.lit(1)).alias("n_species"),
        F.count_if(F.col("endangered_grade") != "").alias("n_endangered"),
        F.count_if(F.col("redlist") != "").alias("n_redlisted"),
        F.count_if(F.col("rank") == RANK_SPECIES).alias("n_rank_species"),
        F.count_if(F.col("rank") == RANK_SUBSPECIES).alias("n_rank_subspecies"),
        F.count_if(F.col("endangered_grade_by") == "sci").alias("n_grade_by_sci"),
        F.count_if(F.col("endangered_grade_by") == "kor").alias("n_grade_by_kor"),
        F.count_if(F.col("redlist_by") == "sci").alias("n_redlist_by_sci"),
        F.count_if(F.col("redlist_by") == "kor").alias("n_redlist_by_kor"),
    )


def coverage_missing(rated: DataFrame, master: DataFrame) -> DataFrame:
    """Rated rows (sci_name, kor_name) whose name key and vernacular are both absent from the master."""
    keyed = rated.withColumn("_sci", names.managed_key(F.col("sci_name"))).withColumn(
        "_kor", names.vernacular_key(F.col("kor_name"))
    )
    keys = master.select(F.col("match_key").alias("_sci")).distinct()
    kors = master.select(names.vernacular_key(F.col("korean_name")).alias("_kor")).distinct()
    left = spread_join(keyed, keys, ["_sci"], rated.columns, "left_anti")
    return spread_join(left, kors, ["_kor"], rated.columns, "left_anti").drop("_sci", "_kor")
