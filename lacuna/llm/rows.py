"""Tables, row order and row numbers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many chunks, so that their bounds and counts may pass through the driver.
MAX_CHUNKS = 10_000
#: A missing id sorts before all others.
LOWEST = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_rest(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number; a missing id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def chunk_bounds(df: DataFrame, column: str, rows_per_chunk: int) -> list[int]:
    """Values that cut a long column into chunks of about equal size: quantiles, at most MAX_CHUNKS of them."""
    rows = df.count()
    chunks = max(1, min(MAX_CHUNKS, -(-rows // rows_per_chunk)))
    if chunks == 1:
        return []
    steps = ", ".join(f"{i / chunks:.8f}D" for i in range(1, chunks))
    found = df.select(F.col(column).alias("v")).agg(F.expr(f"approx_percentile(v, array({steps}), 100000)").alias("q"))
    return sorted(set(found.first().q or []))


def long_array(values: Sequence[int]) -> Column:
    """A literal array of longs."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def chunk_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the value, found in two steps of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    starts = long_array([g[0] for g in groups])
    text = "[" + ",".join("[" + ",".join(map(str, g)) + "]" for g in groups) + "]"
    nested = F.from_json(F.lit(text), "array<array<bigint>>")
    group = F.size(F.filter(starts, lambda b: b <= value))
    inside = F.size(F.filter(F.element_at(nested, group), lambda b: b <= value))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside).cast("int")
