"""Exact quantiles of very large groups.

The built-in exact percentile keeps every distinct value of a group in one task. Here values are counted
first and dealt out in ranges of (group, value) with about equal numbers of them, whatever the groups and
distributions. Ranks are worked out inside a range; the counts of a group's earlier ranges are its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.ranking import in_ranges, join_back


def finite_counts(samples: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Finite values with their number of rows (or summed weight) per group."""
    v = F.col(value)
    usable = samples.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return usable.groupBy(*keys, v.alias("_v")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")
    )


def summarise(
    samples: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Per group: n, min, max, mean, sd (0 for one value) and interpolated (type-7) quantiles; a missing key is a group."""
    keys = list(keys)
    counts = in_ranges(finite_counts(samples, keys, value, weight), [*keys, "_v"], "value-ranges", pieces)
    parts = counts.groupBy(*keys, "_piece").agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.sum(F.col("_v") * F.col("_c")).alias("_sum"),
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.select(
        *keys, "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("n"), F.min("_min").over(whole).alias("min"), F.max("_max").over(whole).alias("max"),
        (F.sum("_sum").over(whole) / F.sum("_n").over(whole)).alias("mean"),
    )
    inner = Window.partitionBy(*keys, "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_inside", F.coalesce(F.sum("_c").over(inner), F.lit(0)))
    ranked = join_back(inside, totals, [*keys, "_piece"]).withColumn("_first", F.col("_before") + F.col("_inside"))

    def at(rank):
        holds = (F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_c"))
        return F.max(F.when(holds, F.col("_v")))

    last = F.col("n") - 1
    picks = []
    for name, p in probs.items():
        picks += [at(F.floor(last * p)).alias(f"_lo_{name}"), at(F.ceil(last * p)).alias(f"_hi_{name}")]
    off = F.col("_v") - F.col("mean")
    out = ranked.groupBy(*keys, "n", "min", "max", "mean").agg(F.sum(off * off * F.col("_c")).alias("_ss"), *picks)
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / last)).otherwise(F.lit(0.0))
    quantiles = [
        (
            F.col(f"_lo_{name}")
            + (last * p - F.floor(last * p)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
        ).alias(name)
        for name, p in probs.items()
    ]
    return out.select(*keys, "n", "min", "max", "mean", sd.alias("sd"), *quantiles)
