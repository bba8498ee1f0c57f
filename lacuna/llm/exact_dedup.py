"""Exact duplicates by progressive refinement: equal lengths, then equal beginnings, then equal whole texts.

Each step only asks for more of a text where the step before found company. What a step found is handed to the next as a
bit mask of fixed size, so no text is ever shuffled: masks are broadcast, rows that pass them are hashed where they are read,
and only ids, lengths and hashes move. A mask may let a row through needlessly, which costs a hash; groups are formed by the
whole hash alone, so results do not depend on the mask.

Defined results: a missing text counts as empty, and empty texts are equal. A row without an id is kept only where all rows
of its group lack one. Of rows with the same id and equal texts one stays. Other columns, whatever their names, are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.joins import spread_join
from lacuna.session import staged

#: Runs of these count as one space (fixed value).
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Characters of the beginning that the second step looks at.
HEAD = 64
#: Bits in a mask for each key, and the bound of a mask: 2**25 bits are 2**19 words of 64 bits.
BITS_PER_KEY = 16
LEAST_BITS = 2**12
MOST_BITS = 2**25


def normal(text: Column) -> Column:
    """The text with every run of blanks as one space; empty where it is missing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def whole_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Mask:
    """Which hashes may belong to a set of keys: a table of 64-bit words, small enough to be broadcast at any input size."""

    def __init__(self, keys: DataFrame, hashed: Column, most_bits: int = MOST_BITS):
        self.bits = LEAST_BITS
        wanted = min(most_bits, BITS_PER_KEY * keys.count())
        while self.bits < wanted:
            self.bits *= 2
        bit = F.pmod(hashed, F.lit(self.bits))
        one = F.expr("shiftleft(1L, CAST(_bit % 64 AS INT))")
        words = keys.select(bit.alias("_bit")).groupBy(F.expr("_bit DIV 64").alias("_word")).agg(F.bit_or(one).alias("_set"))
        self.words = staged(words, "mask")

    def mark(self, rows: DataFrame, hashed: Column, out: str) -> DataFrame:
        """Rows with a column that tells whether their hash may be in the set."""
        bit = F.pmod(hashed, F.lit(self.bits))
        held = rows.withColumn("_word", F.call_function("div", bit, F.lit(64).cast("bigint")))
        joined = held.join(F.broadcast(self.words), "_word", "left")
        found = F.expr("_set").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))) != 0
        return joined.withColumn(out, F.coalesce(found, F.lit(False))).drop("_word", "_set")


def duplicates(docs: DataFrame, digests: dict[str, Column] | None = None, head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, keep_id (of the row that stays), group_size, kept.

    `digests` names further columns to hand through, as expressions over doc_id and `normal_text`.
    """
    digests = digests or {}
    texts = docs.select(F.col("doc_id"), normal(F.col("text")).alias("normal_text"))
    size = F.octet_length("normal_text").alias("_size")
    begin = F.xxhash64(F.substring("normal_text", 1, head)).alias("_head")
    sizes, heads = F.xxhash64("_size"), F.xxhash64("_size", "_head")

    seen = staged(texts.select(size, begin), "sizes")
    several = F.count(F.lit(1)).alias("_n")
    by_size = Mask(seen.groupBy("_size").agg(several).where("_n > 1"), sizes)
    like = by_size.mark(seen, sizes, "_like").where("_like")
    by_head = Mask(like.groupBy("_size", "_head").agg(several).where("_n > 1"), heads)

    sized = texts.select("doc_id", "normal_text", size, begin)
    whole = F.when(F.col("_like"), whole_hash(F.col("normal_text"))).alias("_whole")
    rows = by_head.mark(sized, heads, "_like").select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "_size", "_head", whole,
        *[value.alias(f"_digest_{name}") for name, value in digests.items()],
    )
    rows = staged(rows, "whole-hashes")
    groups = rows.where("_whole IS NOT NULL").groupBy("_size", "_head", "_whole").agg(
        F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("_row", "doc_id"), F.min("_row")).alias("_stays"),
    )
    groups = staged(groups.where("group_size > 1"), "equal-texts")
    joined = spread_join(rows, groups, ["_size", "_head", "_whole"], ["_row"])
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("_row") == F.col("_stays"))).alias("kept"),
        *[F.col(f"_digest_{name}").alias(name) for name in digests],
    )
