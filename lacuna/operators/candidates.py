"""Checklist candidates for names that did not match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import names
from lacuna.operators.joins import spread_join

MIN_LENGTH = 2
BY_PART, BY_GENUS = "국명부분일치", "동일속"


def unmatched_vernacular(unmatched: DataFrame) -> Column:
    """The vernacular column, else the name column when it holds Hangul, without white space."""
    kor, sci = unmatched["kor_name"], unmatched["sci_name"]
    text = F.when(kor.rlike(r"(?U)\S"), kor).when(sci.rlike("[가-힣]"), sci).otherwise("")
    return names.vernacular_key(text)


def _bigrams(text: str) -> Column:
    """All different pairs of neighbouring characters of a text with two characters at least."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda k: F.substring(F.col(text), k, 2))
    return F.array_distinct(pairs)


def _first_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """First k rows per key in checklist order; partial limits run before the shuffle."""
    w = Window.partitionBy(key).orderBy("_ord", "ktsn")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _containments(short: DataFrame, long: DataFrame) -> DataFrame:
    """All (short, long) with the first contained in the second; both columns hold different texts of two characters or more.

    A text that contains another holds all its bigrams. So each short text is looked up by the one of its bigrams that
    fewest long texts hold, and each long text stands under all of its bigrams, as many as it has characters.
    """
    under = long.select("long", F.explode(_bigrams("long")).alias("gram"))
    held = under.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = short.select("short", F.explode(_bigrams("short")).alias("gram")).join(held, "gram", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")
    keys = asked.groupBy("short").agg(rarest).where("best.n > 0").select("short", F.col("best.gram").alias("gram"))
    met = spread_join(under, keys, ["gram"], ["long"], "inner")
    return met.where(F.contains("long", "short")).select("short", "long")


def by_substring(queries: DataFrame, master: DataFrame, k: int | None = None) -> DataFrame:
    """(u_kor, ktsn, _ord): checklist names containing u_kor or contained in it, all of them or the first k."""
    m = master.select("ktsn", "_ord", names.vernacular_key(F.col("korean_name")).alias("m_kor")).where(
        F.length("m_kor") >= MIN_LENGTH
    )
    u = queries.select("u_kor").where(F.length("u_kor") >= MIN_LENGTH).distinct()
    listed = m.select("m_kor").distinct()
    in_master = _containments(u.toDF("short"), listed.toDF("long")).toDF("u_kor", "m_kor")
    in_query = _containments(listed.toDF("short"), u.toDF("long")).toDF("m_kor", "u_kor")
    pairs = in_master.unionByName(in_query).distinct()
    found = spread_join(pairs, m, ["m_kor"], ["u_kor"], "inner").select("u_kor", "ktsn", "_ord")
    return found if k is None else _first_k(found, "u_kor", k)


def query_genus() -> Column:
    """First Latin run of the unmatched name, lower-cased."""
    return F.lower(F.regexp_extract("sci_name", "[A-Za-z]+", 0))


def by_genus(queries: DataFrame, master: DataFrame, k: int | None = None) -> DataFrame:
    """(genus, ktsn, _ord): checklist rows of every genus asked for, all of them or the first k."""
    wanted = queries.select("genus").where("genus <> ''").distinct()
    m = master.select("ktsn", "_ord", F.lower(F.trim("genus_la")).alias("genus")).where("genus <> ''")
    found = m.join(wanted, "genus", "left_semi")
    return found if k is None else _first_k(found, "genus", k)


def rank_candidates(unmatched: DataFrame, master: DataFrame, k: int) -> DataFrame:
    """Up to k candidates per unmatched name: name parts first, then the genus, no id twice.

    Of the genus list 2k rows are enough: at most k of them can repeat an earlier candidate.
    """
    q = unmatched.withColumn("u_kor", unmatched_vernacular(unmatched)).withColumn("genus", query_genus())
    asked = q.select("sci_name", "kor_name", "u_kor", "genus").distinct()
    parts = spread_join(asked, by_substring(asked, master, k), ["u_kor"], ["sci_name", "kor_name"], "inner")
    genera = spread_join(asked, by_genus(asked, master, 2 * k), ["genus"], ["sci_name", "kor_name"], "inner")
    both = parts.select("sci_name", "kor_name", "ktsn", "_ord", F.lit(0).alias("basis_no")).unionByName(
        genera.select("sci_name", "kor_name", "ktsn", "_ord", F.lit(1).alias("basis_no"))
    )
    once = both.groupBy("sci_name", "kor_name", "ktsn", "_ord").agg(F.min("basis_no").alias("basis_no"))
    w = Window.partitionBy("sci_name", "kor_name").orderBy("basis_no", "_ord", "ktsn")
    ranked = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    basis = F.when(F.col("basis_no") == 0, BY_PART).otherwise(BY_GENUS)
    return ranked.withColumn("basis", basis).select("sci_name", "kor_name", "rank", "basis", "ktsn")


def by_impact(candidates: DataFrame, count: str) -> DataFrame:
    """Candidates of the most often discarded names first; an unreadable count is 0."""
    n = F.coalesce(F.col(count).cast("string").try_cast("bigint"), F.lit(0))
    return candidates.orderBy(F.desc(n), "sci_name", "kor_name", "rank")
