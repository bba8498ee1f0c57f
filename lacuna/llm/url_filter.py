"""URL filter: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Every URL is expanded into the expressions that a rule of the list could have: for each shape (number of host
labels, length of the path) found in the rules, its last labels with the first characters of its path. Rules and
expressions meet in an equality join on the first 32 bits of their SHA-256; the full digest then confirms a hit.
Of several rules that fit, the longest wins, then the longer host, then `block`.

Defined results: a missing URL, or one without `://`, has an empty host and path and no rule. Rows are kept as they
are, repeated ones too. A rule without a host or verdict is ignored; an empty path fits every path. URLs without a
rule get the `default` verdict. Extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule list with at most so many rows is broadcast; a longer one is shuffled by its hash prefix.
BROADCAST_RULES = 100_000
#: A URL that many rows share is looked up in so many parts.
SALTS = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages`; `rules` has host, path, verdict."""
    host, path = host_and_path(F.col("url"))
    listed = (
        rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), "verdict")
        .where("rh IS NOT NULL AND verdict IS NOT NULL")
        .withColumn("digest", F.sha2(F.concat("rh", "rp"), 256))
        .withColumn("prefix", _prefix(F.col("digest")))
    )
    shapes = [(r.n, r.p) for r in listed.select(_labels(F.col("rh")).alias("n"), F.length("rp").alias("p")).distinct().collect()]
    keyed = pages.select("page_id", "url", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    if not shapes:
        hits = keyed.select("url", "salt", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("said")).limit(0)
    else:
        small = listed.limit(broadcast_rules + 1).count() <= broadcast_rules
        listed = F.broadcast(listed) if small else listed.hint("shuffle_hash")
        expressions = F.array(*[
            F.when(
                (_labels(F.col("host")) >= n) & (F.length("path") >= p),
                F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, p)),
            )
            for n, p in sorted(shapes)
        ])
        hits = (
            keyed.where("url IS NOT NULL").select("url", "salt").distinct()
            .select("url", "salt", host.alias("host"), path.alias("path"))
            .select("url", "salt", F.explode(F.array_compact(expressions)).alias("e"))
            .withColumn("own", F.sha2("e", 256))
            .withColumn("prefix", _prefix(F.col("own")))
            .join(listed, "prefix")
            .where("own = digest")
            .groupBy("url", "salt")
            .agg(F.max(F.struct(
                F.length(F.concat("rh", "rp")).alias("size"), F.length("rh").alias("host_size"),
                F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"),
                F.concat("rh", "rp").alias("rule"), F.col("verdict").alias("said"),
            )).alias("best"))
            .select("url", "salt", "best.rule", "best.said")
        )
    return keyed.join(hits, ["url", "salt"], "left").select(
        "page_id", host.alias("host"), path.alias("path"), "rule",
        F.coalesce("said", F.lit(default)).alias("verdict"),
    )
