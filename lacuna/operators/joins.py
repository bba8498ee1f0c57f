"""Joins that stay safe when one key holds a large share of the rows, and checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table is hinted for broadcast only when a count proved it has at most this many rows.
BROADCAST_ROWS = 200_000
# A key is hot when it holds at least this share of all rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 64
SALTS = 256
# Counters of the heavy-hitter sketch; far more than 1 / HOT_SHARE, so its error is a small part of a hot count.
SKETCH_ITEMS = 10_000


def sized(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `dim` when a bounded count proves it small, else forbid broadcasting it."""
    rows = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if rows <= max_rows else dim.hint("merge")


def planned_small(df: DataFrame) -> bool:
    """Whether Catalyst's own size estimate is below its broadcast threshold (no job is run)."""
    limit = df._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def hot_hashes(facts: DataFrame, hashed: Column) -> list[int]:
    """Hashes of the keys holding at least HOT_SHARE of the rows, from one narrow pass without a shuffle.

    The sketch may overstate a count, never hide such a key; a key salted needlessly only costs copies.
    """
    top = int(1 / HOT_SHARE)
    row = (
        facts.select(hashed.alias("_h"))
        .agg(F.expr(f"approx_top_k(_h, {top}, {SKETCH_ITEMS})").alias("top"), F.count(F.lit(1)).alias("n"))
        .first()
    )
    return [item.item for item in row.top if item["count"] >= row.n * HOT_SHARE]


def spread_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Join `facts` with `dim` (few rows per key) without sending a hot key to one task.

    A `dim` Catalyst holds for small is left to it: it is broadcast and nothing is shuffled. Otherwise hot
    keys are looked for; rows of a hot key get a salt from a hash of `spread_on` (the same on every retry),
    and only the `dim` rows of hot keys are repeated once per salt.
    """
    keys = list(keys)
    if facts.isStreaming or planned_small(dim):
        return facts.join(dim, keys, how)
    kinds = {k: dim.schema[k].dataType for k in keys}
    hashed = F.xxhash64(*[F.col(f"`{k}`").cast(kinds[k]) for k in keys])
    hot = hot_hashes(facts, hashed)
    if not hot:
        return facts.join(dim, keys, how)
    is_hot = hashed.isin(hot)
    salt = F.pmod(F.xxhash64(*spread_on), F.lit(SALTS))
    salted = facts.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = dim.withColumn("_salt", F.explode(copies))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
