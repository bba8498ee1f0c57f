"""I-Match document fingerprints over randomised lexicon subsets.

Terms (runs of letters and digits, lower-cased) whose inverse document frequency over all documents lies in a band
form the lexicon. Every term falls at random into one of `subsets` parts of the lexicon, and into each other one with
chance 1 / `thinning`, so no term of the band is left out and parts overlap at random. A document's
distinct terms in a part, sorted and hashed, give one field of its fingerprint; likeness is the share of fields that
agree among those which either side fills. A text without any term of the lexicon is hashed whole into the first field.

A band ends at a document share e^-max_idf, so the lexicon has at most (mean distinct terms) · e^max_idf terms, however
large the corpus: a size that is known, and checked before it is broadcast.

Defined results: a missing text is empty; repeated rows and equal texts get equal fingerprints; an empty table gives no
rows; a missing id sorts last among the documents in descending order. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm import rows
from lacuna.session import staged

SUBSETS = 32
THINNING = 192
IDF_BAND = (1.5, 8.0)
BROADCAST_TERMS = 1_000_000
ROWS_PER_CHUNK = 2_000
FIELD = 6


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND, subsets: int = SUBSETS, thinning: int = THINNING) -> DataFrame:
    """(term, subset): hashed terms in the band, once for each subset that holds them; counted over all documents."""
    total = docs.count()
    least, most = total * math.exp(-band[1]), total * math.exp(-band[0])
    counted = (
        docs.select(F.explode_outer(terms(rows.text_of())).alias("t")).where("t <> ''")
        .groupBy(F.xxhash64("t").alias("term")).count()
        .where(F.col("count").between(least, max(most, 1.0)))
    )
    own = F.pmod(F.xxhash64("term", F.lit(subsets)), F.lit(subsets)).cast("int")
    held = F.filter(
        F.sequence(F.lit(0), F.lit(subsets - 1)), lambda j: (j == own) | (F.pmod(F.xxhash64("term", j), F.lit(thinning)) == 0))
    return staged(counted.select("term", F.explode(held).alias("subset")), "lexicon")


def _fields(found: Column, whole: Column, subsets: int) -> Column:
    """One hash for each subset, empty where the text has no term of it."""

    def field(j: Column) -> Column:
        own = F.transform(F.filter(found, lambda x: x["subset"] == j), lambda x: x["term"])
        return F.when(F.size(own) > 0, F.substring(F.lpad(F.lower(F.hex(F.xxhash64(own))), 16, "0"), 1, FIELD)).otherwise("")

    hashed = F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), field)
    lone = F.array(F.concat(F.lit("="), whole), *[F.lit("")] * (subsets - 1))
    return F.when(F.size(found) > 0, hashed).otherwise(lone)


def likeness(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == "") & (y == ""), F.lit(None)).otherwise((x == y).cast("int")))
    counted = F.array_compact(pairs)
    return F.aggregate(counted, F.lit(0), lambda s, x: s + x) / F.size(counted)


def fingerprints(
    docs: DataFrame, band: tuple[float, float] = IDF_BAND, subsets: int = SUBSETS, thinning: int = THINNING,
    broadcast_terms: int = BROADCAST_TERMS, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Fingerprint of every document and of its edited text (last half replaced by the next document's start)."""
    words = lexicon(docs, band, subsets, thinning)
    small = words.limit(broadcast_terms + 1).count() <= broadcast_terms
    keyed = docs.select("doc_id", rows.text_of().alias("text"), F.coalesce("doc_id", F.lit(rows.LOWEST)).alias("key"))
    bounds = rows.chunk_bounds(keyed, "key", rows_per_chunk)
    keyed = keyed.withColumn("chunk", rows.chunk_of(F.col("key"), bounds))
    # The first document of each chunk also follows the last one of the chunk before it (in descending order).
    heads = sorted((r.chunk, r.top) for r in keyed.groupBy("chunk").agg(F.max("key").alias("top")).collect())
    if heads:
        above = dict(zip([c for c, _ in heads], [c for c, _ in heads[1:]] + [heads[0][0]], strict=True))
        tops = dict(heads)
        first = F.element_at(rows.long_array([tops.get(c, 0) for c in range(len(bounds) + 1)]), F.col("chunk") + 1)
        guest = F.element_at(rows.long_array([above.get(c, 0) for c in range(len(bounds) + 1)]), F.col("chunk") + 1)
        own = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("guest"))
        copy = F.struct(guest.cast("int").alias("chunk"), F.lit(True).alias("guest"))
        keyed = keyed.withColumn("at", F.explode(F.when(F.col("key") == first, F.array(own, copy)).otherwise(F.array(own))))
        keyed = keyed.select("doc_id", "text", "key", "at.chunk", "at.guest")
    else:
        keyed = keyed.withColumn("guest", F.lit(False))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("chunk").orderBy("guest", F.desc("key"), "tie")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    followed = (
        keyed.withColumn("place", F.row_number().over(order)).withColumn("follower", F.lead("text").over(order))
        .withColumn("edited", F.concat(F.substr("text", F.lit(1), size - half), F.substr(F.coalesce("follower", F.lit("")), F.lit(1), half)))
    )
    meta = F.struct(
        "doc_id", "guest", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.substring(F.sha2("text", 256), 1, 16).alias("whole"),
    )
    marked = F.concat(F.array(F.lit("")), terms(F.col("text")))
    both = F.array(marked, F.when(F.col("guest"), F.array().cast("array<string>")).otherwise(terms(F.col("edited"))))
    spread = (
        followed.select("chunk", "place", meta.alias("meta"), both.alias("both"))
        .select("chunk", "place", "meta", F.posexplode_outer("both").alias("edit", "words"))
        .select("chunk", "place", "meta", "edit", F.explode("words").alias("word"))
        .withColumn("term", F.xxhash64("word"))
    )
    hit = F.struct("subset", "term")
    grouped = (
        spread.join(F.broadcast(words) if small else words, "term", "left")
        .where("subset IS NOT NULL OR (word = '' AND edit = 0)")
        .groupBy("chunk", "place")
        .agg(
            F.first("meta").alias("meta"),
            F.sort_array(F.collect_set(F.when(F.col("subset").isNotNull() & (F.col("edit") == 0), hit))).alias("own"),
            F.sort_array(F.collect_set(F.when(F.col("subset").isNotNull() & (F.col("edit") == 1), hit))).alias("other"),
        )
        .select(
            "chunk", "place", "meta.*",
            _fields(F.col("own"), F.col("meta.whole"), subsets).alias("own"),
            _fields(F.col("other"), F.substring("meta.edited_sha256", 1, 16), subsets).alias("other"),
        )
        .withColumn("next", F.lead("own").over(Window.partitionBy("chunk").orderBy("place")))
    )
    return grouped.where("NOT guest").select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("own", "-").alias("fingerprint"), F.array_join("other", "-").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
