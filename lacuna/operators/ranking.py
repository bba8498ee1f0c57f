"""Numbering and carrying forward along an order, without one task per group.

A window over a whole group puts the group into one task. Here the order is cut first: numbering runs inside ranges
of (group, order) with about equal numbers of rows, carrying forward inside chunks of equal width of the order column.
One row per group and range (or chunk) enters a second window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import staged

CHUNK = 65_536


def _chunk(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def join_back(df: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row with the line of its chunk or range; missing groups and missing orders find each other."""
    renamed = chunks.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [df[k].eqNullSafe(renamed[f"_of_{k}"]) for k in keys]
    return df.join(renamed, same).drop(*[f"_of_{k}" for k in keys])


def in_ranges(df: DataFrame, order: Sequence[str], label: str, pieces: int | None = None) -> DataFrame:
    """Rows written in ranges of an order, with the number of their range in `_piece`.

    Ranges are cut at sampled quantiles of the whole order, so they hold about as many rows each, however the groups
    are spread; there are as many as the session has shuffle partitions, fewer where they would be small.
    """
    dealt = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    return staged(dealt.withColumn("_piece", F.spark_partition_id()), label)


def number_rows(
    df: DataFrame, group: Sequence[str], order: str, out: str, ties: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    """0-based position of every row within its group, by an order column; missing orders come first.

    Rows are numbered inside ranges of (group, order); of each range and group only a count enters the second window.
    """
    group = list(group)
    dealt = in_ranges(df, [*group, order, *ties], "numbered", pieces)
    inner = Window.partitionBy(*group, "_piece").orderBy(order, *ties)
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*group, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        join_back(dealt.withColumn("_in_piece", F.row_number().over(inner) - 1), offsets, [*group, "_piece"])
        .withColumn(out, (F.col("_before") + F.col("_in_piece")).cast("bigint"))
        .drop("_piece", "_before", "_in_piece")
    )


def carry_forward(
    df: DataFrame, group: Sequence[str], order: str, value: Column, out: str, width: int = CHUNK
) -> DataFrame:
    """Last non-NULL `value` at or before each row of its group."""
    group = list(group)
    df = df.withColumn("_chunk", _chunk(order, width)).withColumn("_value", value)
    upto = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        df.groupBy(*group, "_chunk")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(before))
        .drop("_last")
    )
    return (
        join_back(df.withColumn("_own", F.last("_value", ignorenulls=True).over(upto)), chunks, [*group, "_chunk"])
        .withColumn(out, F.coalesce("_own", "_carried"))
        .drop("_chunk", "_value", "_own", "_carried")
    )
