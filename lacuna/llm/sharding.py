"""Sharding by a Feistel permutation over global row numbers.

Rows get gapless numbers in the order of their ids (ties by text hash). A Feistel network on pairs of residues
modulo a = ceil(sqrt(N)) permutes 0 … a²-1; cycle walking applies it again while the value is not below N, which makes
a permutation of 0 … N-1. Shard and slot follow from the permuted number p by arithmetic alone: p mod shards and
p div shards. So counts differ by at most one (law `rows`), and anyone who knows (N, seed) can compute the place of row n.

Defined results: a missing id sorts first, a missing text has 0 bytes and crc 0, repeated rows get places of their
own, an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm import rows

ROUNDS = 6
ROWS_PER_CHUNK = 200_000
#: Walks are unrolled in the row. A walk leaves 0 … N-1 again with a chance below 2 / sqrt(N), so that 48 of them are
#: more than enough from N = 2500; below that, a² - N + 1 of them always are.
WALKS = 48


def number_rows(df: DataFrame, id_column: str, tie: Column, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add `row_number` (0 … N-1): ids are cut into chunks at quantiles, numbered inside, and offset by counts before."""
    keyed = df.withColumn("_id", F.coalesce(F.col(id_column), F.lit(rows.LOWEST))).withColumn("_tie", tie)
    bounds = rows.chunk_bounds(keyed, "_id", rows_per_chunk)
    keyed = keyed.withColumn("_chunk", rows.chunk_of(F.col("_id"), bounds))
    counts = {r._chunk: r["count"] for r in keyed.groupBy("_chunk").count().collect()}  # one per chunk: MAX_CHUNKS at most
    before, total = [], 0
    for chunk in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(chunk, 0)
    order = Window.partitionBy("_chunk").orderBy("_id", "_tie")
    number = F.element_at(rows.long_array(before), F.col("_chunk") + 1) + F.row_number().over(order) - 1
    return keyed.withColumn("row_number", number).drop("_id", "_tie", "_chunk")


def permuted(column: str, total: int, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """Place of row number `column` after the permutation of 0 … total-1."""
    side = max(1, math.isqrt(max(total, 1) - 1) + 1)
    keys = ", ".join(f"{seed * 1000003 + r}L" for r in range(rounds))

    def network(x: str) -> str:
        return (
            f"aggregate(array({keys}), named_struct('l', {x} div {side}L, 'r', {x} % {side}L), "
            f"(s, k) -> named_struct('l', s.r, 'r', pmod(s.l + pmod(xxhash64(s.r, k), {side}L), {side}L)), "
            f"s -> s.l * {side}L + s.r)"
        )

    walks = min(side * side - total + 1, WALKS)
    walked = f"aggregate(sequence(1, {walks}), {network(column)}, (p, i) -> if(p < {total}L, p, {network('p')}))"
    return F.expr(f"transform(array({walked}), q -> if(q < {total}L, q, raise_error('the walk did not end')))[0]")


def shard(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number) of each row."""
    light = docs.select(
        "doc_id",
        (F.octet_length(rows.text_of()) + F.lit(16)).cast("long").alias("size"),
        F.crc32(rows.text_of()).alias("text_crc32"),
        F.xxhash64("text").alias("_hash"),
    )
    total = docs.count()
    numbered = number_rows(light, "doc_id", F.col("_hash"))
    placed = numbered.withColumn("_p", permuted("row_number", max(total, 1), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
