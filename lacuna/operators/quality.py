"""Audits and set rules over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.joins import spread_join


def reconcile(derived: DataFrame, stored: DataFrame, keys: Sequence[str], count: str = "obs_count") -> DataFrame:
    """Keys whose derived and stored counts differ, or that one side lacks.

    One union and one grouped sum; unlike an outer join it also compares unknown (NULL) key parts.
    """
    keys = list(keys)
    a = derived.select(*keys, F.col(count).alias("derived"), F.lit(0).cast("bigint").alias("stored"))
    b = stored.select(*keys, F.lit(0).cast("bigint").alias("derived"), F.col(count).alias("stored"))
    both = a.unionByName(b).groupBy(*keys).agg(F.sum("derived").alias("derived"), F.sum("stored").alias("stored"))
    return both.where("derived <> stored")


def total_preserved(district: DataFrame, province: DataFrame) -> DataFrame:
    """District total, province total and their difference."""
    both = district.select(F.col("obs_count").alias("d"), F.lit(0).cast("bigint").alias("p")).unionByName(
        province.select(F.lit(0).cast("bigint").alias("d"), F.col("obs_count").alias("p"))
    )
    return both.agg(
        F.sum("d").alias("district_total"), F.sum("p").alias("province_total"),
        (F.sum("d") - F.sum("p")).alias("difference"),
    )


def layer_census(features: DataFrame) -> DataFrame:
    """Features per layer and in total ('' = all layers)."""
    return (
        features.rollup("layer")
        .agg(F.count(F.lit(1)).alias("n_features"), F.grouping_id().cast("bigint").alias("is_total"))
        .withColumn("layer", F.coalesce("layer", F.lit("")))
    )


def dedup_features(features: DataFrame, key: str, order: str) -> DataFrame:
    """First feature per id, for overlapping tiles."""
    rest = [c for c in features.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(order)).alias("rec")
    return features.groupBy(key).agg(first).select(key, "rec.*")


def usable_keys(class_keys: DataFrame, order_keys: DataFrame, bad: Sequence[str] = ("NONE", "HIGHERRANK")) -> DataFrame:
    """Distinct usable (taxon_group, taxon_key) of classes and of orders below unresolved classes."""
    ok = F.col("gbif_key").isNotNull() & ~F.coalesce("gbif_match", F.lit("")).isin(*bad)
    failed = class_keys.where(~ok).select("taxon_group", "class_la").distinct()
    fallback = order_keys.join(failed, ["taxon_group", "class_la"], "left_semi")
    cols = ["taxon_group", F.col("gbif_key").alias("taxon_key")]
    return class_keys.where(ok).select(*cols).unionByName(fallback.where(ok).select(*cols)).distinct()


def match_equal_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each l_id with the first r_id whose set of `k` is identical.

    Sets are fingerprinted by size and two hashes, then verified element by element, so no set is collected
    and a collision can neither make nor lose a match. Equal right-hand sets are first reduced to one, so a
    set that occurs very often on both sides yields one row per l_id, not all pairs.
    """

    def prints(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(name).agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("k")).alias("f1"),
            F.bit_xor(F.xxhash64("k", F.lit(1))).alias("f2"),
        )

    def verified(pairs: DataFrame, sets: DataFrame, other: DataFrame, a: str, b: str) -> DataFrame:
        # One set on the other side may stand for most ids here: its members are spread over them.
        members = spread_join(spread_join(sets, pairs, [a], ["k"], "inner"), other, [b, "k"], [a], "left_semi")
        return members.groupBy(a, b, "n").agg(F.count(F.lit(1)).alias("_same")).where("_same = n").drop("_same")

    lset, rset = left.select("l_id", "k").distinct(), right.select("r_id", "k").distinct()
    fp = ["n", "f1", "f2"]
    rights = prints(rset, "r_id")
    first = rights.groupBy(*fp).agg(F.min("r_id").alias("first_id"))
    to_first = spread_join(rights, first, fp, ["r_id"], "inner").select("r_id", "first_id", "n")
    firsts = rset.withColumnRenamed("r_id", "first_id")
    same = verified(to_first, rset, firsts, "r_id", "first_id")
    # A right-hand set that only shares the fingerprint of the first one stands for itself.
    collided = rights.join(same.select("r_id"), "r_id", "left_anti").select("r_id", *fp)
    reps = first.select(F.col("first_id").alias("r_id"), *fp).unionByName(collided)
    pairs = spread_join(prints(lset, "l_id"), reps, fp, ["l_id"], "inner").select("l_id", "r_id", "n")
    hits = verified(pairs, lset, rset, "l_id", "r_id")
    return hits.groupBy("l_id").agg(F.min("r_id").alias("r_id"), F.min("n").alias("n_keys"))
