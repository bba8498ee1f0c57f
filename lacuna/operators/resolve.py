"""Names → checklist ids: lookups, verdicts and the reports drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import names
from lacuna.operators.joins import planned_small, sized, spread_join
from lacuna.session import staged

VERDICTS = ("override", "both", "sci", "kor", "conflict", "none")
MATCHED = ("override", "both", "sci", "kor")


def override_lookup(overrides: DataFrame) -> DataFrame:
    """Curated rows (match_name, match_type, accepted_ktsn) → (key_type, key, ktsn), last row wins."""
    kind = F.lower(F.trim("match_type"))
    key = F.when(kind == "sci", names.managed_key(F.col("match_name"))).when(
        kind == "kor", F.nullif(names.vernacular_key(F.col("match_name")), F.lit(""))
    )
    rows = overrides.select("_ord", kind.alias("key_type"), key.alias("key"), F.col("accepted_ktsn").alias("ktsn"))
    usable = rows.where(F.col("key").isNotNull() & F.col("ktsn").isNotNull())
    return usable.groupBy("key_type", "key").agg(F.max_by("ktsn", "_ord").alias("ktsn"))


def _alias_keys(aliases: DataFrame, priority: int) -> DataFrame:
    key = F.when(F.col("alias_type") == "sci", names.managed_key(F.col("alias_name"))).otherwise(
        names.vernacular_key(F.col("alias_name"))
    )
    return aliases.select(
        F.col("alias_type").alias("key_type"), key.alias("key"), F.col("accepted_ktsn").alias("ktsn"),
        F.lit(priority).alias("prio"), "_ord",
    )


def name_lookup(master: DataFrame, *alias_tables: DataFrame) -> DataFrame:
    """(key_type, key) → ktsn. Master names win, alias tables fill gaps in the order given, first row wins."""
    rows = master.select(
        F.lit("sci").alias("key_type"), F.trim("match_key").alias("key"), "ktsn", F.lit(0).alias("prio"), "_ord"
    ).unionByName(
        master.select(
            F.lit("kor").alias("key_type"), names.vernacular_key(F.col("korean_name")).alias("key"), "ktsn",
            F.lit(0).alias("prio"), "_ord",
        )
    )
    for priority, table in enumerate(alias_tables, 1):
        rows = rows.unionByName(_alias_keys(table, priority))
    return (
        rows.where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("key_type", "key")
        .agg(F.min_by("ktsn", F.struct("prio", "_ord")).alias("ktsn"))
    )


def _side(lookup: DataFrame, key_type: str, key: str, out: str) -> DataFrame:
    return lookup.where(F.col("key_type") == key_type).select(F.col("key").alias(key), F.col("ktsn").alias(out))


def judge(pairs: DataFrame, lookup: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add ktsn, how, ktsn_sci, ktsn_kor to rows carrying sci_key and kor_key ('' = missing)."""
    # A missing name gets a probe no lookup holds (keys never start with a space), spread over many values,
    # so that nameless rows neither match nor meet in one task.
    missing = F.concat(F.lit(" "), F.pmod(F.xxhash64("sci_key", "kor_key"), F.lit(4096)).cast("string"))
    out = pairs.withColumns(
        {f"_p_{k}": F.when(F.col(f"{k}_key") == "", missing).otherwise(F.col(f"{k}_key")) for k in ("sci", "kor")}
    )
    overrides = sized(overrides)
    for kind in ("sci", "kor"):
        probe = f"_p_{kind}"
        out = out.join(_side(overrides, kind, probe, f"_ov_{kind}"), probe, "left")
        out = spread_join(out, _side(lookup, kind, probe, f"ktsn_{kind}"), [probe], ["sci_key", "kor_key"])
    out = out.drop("_p_sci", "_p_kor")
    forced = F.coalesce("_ov_sci", "_ov_kor")
    s, k = F.col("ktsn_sci"), F.col("ktsn_kor")
    how = (
        F.when(forced.isNotNull(), "override")
        .when(s.isNotNull() & k.isNotNull(), F.when(s == k, "both").otherwise("conflict"))
        .when(s.isNotNull(), "sci")
        .when(k.isNotNull(), "kor")
        .otherwise("none")
    )
    ktsn = F.coalesce(forced, F.when(s.isNull() | k.isNull() | (s == k), F.coalesce(s, k)))
    return out.withColumn("how", how).withColumn("ktsn", ktsn).drop("_ov_sci", "_ov_kor")


def with_name_keys(obs: DataFrame, sci: str | None, kor: str | None) -> DataFrame:
    sci_key = F.coalesce(names.managed_key(F.col(sci)), F.lit("")) if sci else F.lit("")
    kor_key = names.vernacular_key(F.col(kor)) if kor else F.lit("")
    return obs.withColumn("sci_key", sci_key).withColumn("kor_key", kor_key)


def resolve_names(
    obs: DataFrame, lookup: DataFrame, overrides: DataFrame, sci: str = "sci_name", kor: str | None = "kor_name"
) -> DataFrame:
    """Observations with ktsn (NULL when discarded) and verdict.

    A lookup small enough to broadcast is probed in place: the observations are read once and never moved.
    With a larger one, keys and lookups are worked out once per distinct pair of names, kept as a table and
    joined back, so that the observations are moved once instead of once per lookup.
    """
    added = ("ktsn", "how", "ktsn_sci", "ktsn_kor")
    if planned_small(lookup):
        return judge(with_name_keys(obs, sci, kor), lookup, overrides).select(*obs.columns, *added)
    columns = [sci] + ([kor] if kor else [])
    # '' and NULL both mean a missing name; one form, beside the names as they are, lets them be joined back.
    probes = {f"_name_{i}": F.coalesce(c, F.lit("")) for i, c in enumerate(columns)}
    probed = obs.withColumns(probes)
    asked = probed.select(*probes).distinct()
    pairs = judge(with_name_keys(asked, "_name_0", "_name_1" if kor else None), lookup, overrides)
    joined = spread_join(probed, staged(pairs.select(*probes, *added), "resolved-names"), list(probes), obs.columns)
    return joined.select(*obs.columns, *added)


def species_per_group(resolved: DataFrame, checklist: DataFrame) -> DataFrame:
    """Species found and records matched per species group; only counted ids are joined to the checklist."""
    found = resolved.where(F.col("how").isin(*MATCHED)).groupBy("ktsn").agg(F.count(F.lit(1)).alias("n"))
    grouped = found.join(checklist.select("ktsn", "taxon_group"), "ktsn")
    return grouped.groupBy("taxon_group").agg(F.count(F.lit(1)).alias("n_species"), F.sum("n").alias("n_records"))


def coverage_report(
    obs: DataFrame, lookup: DataFrame, overrides: DataFrame, by: str = "source",
    sci: str = "sci_name", kor: str | None = "kor_name", year: str = "year",
) -> DataFrame:
    """Totals, verdict counts, match rate and year range per source.

    Rows are counted per name pair first: keys are computed and lookups probed per name, not per record.
    """
    columns = [by, sci] + ([kor] if kor else [])
    counted = obs.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n"), F.min(year).alias("y0"), F.max(year).alias("y1")
    )
    judged = judge(with_name_keys(counted, sci, kor), lookup, overrides)
    n = F.col("n")
    matched = F.col("how").isin(*MATCHED)
    return judged.groupBy(by).agg(
        F.sum(n).alias("n_all"),
        *[F.sum(F.when(F.col("how") == v, n).otherwise(0)).alias(f"n_{v}") for v in VERDICTS],
        F.sum(F.when(~matched, n).otherwise(0)).alias("n_discarded"),
        F.bround(F.sum(F.when(matched, n).otherwise(0)) * 100.0 / F.sum(n), 1).alias("match_rate"),
        F.min("y0").alias("first_year"),
        F.max("y1").alias("last_year"),
        F.count_distinct(F.when(matched, F.col("ktsn"))).alias("n_species"),
    )


def discard_list(
    obs: DataFrame, lookup: DataFrame, overrides: DataFrame, hint: str,
    sci: str = "sci_name", kor: str = "kor_name",
) -> DataFrame:
    """Discarded (sci, kor) names with reason, both readings, first hint and count."""
    counted = obs.groupBy(F.col(sci).alias("sci_name"), F.col(kor).alias("kor_name")).agg(
        F.count(F.lit(1)).alias("n_discarded"), F.min_by(hint, "_ord").alias("hint")
    )
    judged = judge(with_name_keys(counted, "sci_name", "kor_name"), lookup, overrides)
    conflict = F.col("how") == "conflict"
    return judged.where(F.col("how").isin("conflict", "none")).select(
        "sci_name", "kor_name", "hint", F.when(conflict, "충돌").otherwise("미매칭").alias("reason"),
        F.when(conflict, F.col("ktsn_sci")).alias("ktsn_sci"),
        F.when(conflict, F.col("ktsn_kor")).alias("ktsn_kor"), "n_discarded",
    )


def top_unmatched(
    obs: DataFrame, lookup: DataFrame, overrides: DataFrame, k: int,
    sci: str = "sci_name", kor: str | None = "kor_name",
) -> DataFrame:
    """The k most frequent discarded names; ties by name."""
    columns = [sci] + ([kor] if kor else [])
    counted = obs.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    judged = judge(with_name_keys(counted, sci, kor), lookup, overrides).where(~F.col("how").isin(*MATCHED))
    shown = [F.nullif(F.col(sci), F.lit(""))] + ([F.nullif(F.col("kor_key"), F.lit(""))] if kor else [])
    name = F.coalesce(*shown, F.lit("(빈값)"))
    return judged.groupBy(name.alias("name")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def group_mismatch(resolved: DataFrame, groups: DataFrame, file_group: str = "file_group") -> DataFrame:
    """(group of the file, group of the matched id) counts where they differ.

    Counted per id first; the join with the checklist then sees one row per (id, file group).
    """
    counted = (
        resolved.where(F.col("ktsn").isNotNull()).groupBy("ktsn", file_group).agg(F.count(F.lit(1)).alias("n"))
    )
    joined = counted.join(groups.select("ktsn", "taxon_group"), "ktsn")
    differs = (F.col("taxon_group") != "") & (F.col("taxon_group") != F.col(file_group))
    return joined.where(differs).groupBy(file_group, "taxon_group").agg(F.sum("n").alias("n"))
