"""Checklist master, aliases, ratings, name resolution and candidate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import candidates, checklist, redlist, resolve
from lacuna.plans import duck
from lacuna.plans.registry import query
from lacuna.plans.standin import Inputs

CANON = f"""
, acc AS (SELECT *, {duck.field_key('gnus', 'specs', 'sspecs')} AS match_key FROM v_raw WHERE corsyn = 'Y')
, scored AS (
  SELECT *, CASE WHEN trim(vrty) = '' THEN 2 ELSE 0 END
    + CASE WHEN (len(string_split(match_key, ' ')) = 3) <> (trim(sspecs) = '') THEN 1 ELSE 0 END AS score
  FROM acc WHERE match_key IS NOT NULL
), canon AS (
  SELECT *, CASE WHEN len(string_split(match_key, ' ')) = 3 THEN gnus || ' ' || specs || ' ' || sspecs ELSE gnus || ' ' || specs END AS scientific_name,
    CASE WHEN len(string_split(match_key, ' ')) = 3 THEN '아종' ELSE '종' END AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY score DESC, ktsn, _ord) AS rn FROM scored) WHERE rn = 1
)"""


@query("canonical_pick", CANON + " SELECT match_key, ktsn, CAST(score AS INT) AS score, vrty, krn FROM canon")
def canonical_pick(i: Inputs) -> DataFrame:
    picked = checklist.canonical_pick(checklist.accepted_species(i.raw()))
    return picked.select("match_key", "ktsn", "score", "vrty", "krn")


@query(
    "alias_from_fold",
    CANON
    + f""", m AS (
      SELECT s.*, c.ktsn AS accepted_ktsn, c.krn AS akrn, c.txgrp AS agrp,
        concat_ws(' ', nullif(trim(s.gnus), ''), nullif(trim(s.specs), ''), nullif(trim(coalesce(nullif(s.vrty, ''), s.sspecs)), '')) AS asci
      FROM scored s JOIN canon c ON s.match_key = c.match_key WHERE s.ktsn <> c.ktsn
    ), a AS (
      SELECT 'kor' AS alias_type, trim(krn) AS alias_name, {duck.vern('krn')} AS key, {duck.vern('akrn')} AS own, accepted_ktsn, agrp, _ord FROM m
      UNION ALL SELECT 'sci', asci, {duck.managed('asci')}, match_key, accepted_ktsn, agrp, _ord FROM m
    ), taken AS (
      SELECT 'sci' AS alias_type, match_key AS key FROM canon UNION SELECT 'kor', {duck.vern('krn')} FROM canon
    )
    SELECT a.alias_type, a.key, arg_min(a.alias_name, a._ord) AS alias_name, a.accepted_ktsn, a.agrp AS taxon_group
    FROM a LEFT JOIN taken t ON a.alias_type = t.alias_type AND a.key = t.key
    WHERE a.key IS NOT NULL AND a.key <> '' AND a.key <> a.own AND t.key IS NULL GROUP BY a.alias_type, a.key, a.accepted_ktsn, a.agrp""",
)
def alias_from_fold(i: Inputs) -> DataFrame:
    return checklist.fold_aliases(i.raw()).select("alias_type", "key", "alias_name", "accepted_ktsn", "taxon_group")


@query(
    "synonym_build",
    CANON
    + f""", p AS (
      SELECT r.*, c.ktsn AS accepted_ktsn, c.krn AS akrn, c.scientific_name AS asci, c.txgrp AS agrp
      FROM v_raw r JOIN canon c ON r.specs_ktsn = c.ktsn WHERE r.corsyn = 'N' AND r.specs_ktsn <> r.ktsn
    ), a AS (
      SELECT 'kor' AS alias_type, trim(krn) AS alias_name, {duck.vern('krn')} AS key, {duck.vern('akrn')} AS own, accepted_ktsn, agrp, _ord FROM p
      UNION ALL SELECT 'sci', trim(stnm), {duck.managed('stnm')}, {duck.managed('asci')}, accepted_ktsn, agrp, _ord FROM p
    ), f AS (
      SELECT *, row_number() OVER (PARTITION BY key, accepted_ktsn ORDER BY _ord, alias_type) AS rn FROM a
      WHERE key IS NOT NULL AND key <> '' AND key <> own
    ) SELECT alias_type, alias_name, key, accepted_ktsn, agrp AS taxon_group, 'corsyn' AS alias_rank FROM f WHERE rn = 1""",
)
def synonym_build(i: Inputs) -> DataFrame:
    rows = checklist.synonyms(i.raw(), checklist.build_master(i.raw()))
    return rows.select("alias_type", "alias_name", "key", "accepted_ktsn", "taxon_group", "alias_rank")


def rated_master(i: Inputs) -> DataFrame:
    master = checklist.build_master(i.raw())
    master = checklist.join_rating(master, checklist.rating_lookup(i.rated(), "grade"), "endangered_grade")
    return checklist.join_rating(master, checklist.rating_lookup(i.rated(), "redlist"), "redlist")


RATINGS = CANON + f"""
, rk AS (
  SELECT _ord, trim(grade) AS grade, redlist, 'sci' AS key_type, {duck.managed('sci_name')} AS key FROM v_rated
  UNION ALL SELECT _ord, trim(grade), redlist, 'kor', {duck.vern('kor_name')} FROM v_rated
), rl AS (
  SELECT key_type, key, arg_min(grade, _ord) AS grade, arg_min(redlist, _ord) AS redlist FROM rk
  WHERE key IS NOT NULL AND key <> '' GROUP BY key_type, key
), rm AS (
  SELECT c.*, coalesce(nullif(s.grade, ''), k.grade, '') AS endangered_grade, coalesce(nullif(s.redlist, ''), k.redlist, '') AS red,
    CASE WHEN coalesce(nullif(s.grade, ''), k.grade, '') = '' THEN '' WHEN s.key IS NOT NULL THEN 'sci' ELSE 'kor' END AS grade_by,
    CASE WHEN coalesce(nullif(s.redlist, ''), k.redlist, '') = '' THEN '' WHEN s.key IS NOT NULL THEN 'sci' ELSE 'kor' END AS red_by
  FROM canon c LEFT JOIN rl s ON s.key_type = 'sci' AND s.key = c.match_key
    LEFT JOIN rl k ON k.key_type = 'kor' AND k.key = {duck.vern('c.krn')}
)"""


@query(
    "join_ratings",
    RATINGS + " SELECT ktsn, match_key, endangered_grade, red AS redlist, grade_by, red_by FROM rm",
)
def join_ratings(i: Inputs) -> DataFrame:
    return rated_master(i).select(
        "ktsn", "match_key", "endangered_grade", "redlist", F.col("endangered_grade_by").alias("grade_by"),
        F.col("redlist_by").alias("red_by"),
    )


@query(
    "master_profile",
    RATINGS
    + """ SELECT txgrp AS taxon_group, count(*) AS n_species, count(*) FILTER (endangered_grade <> '') AS n_endangered,
      count(*) FILTER (red <> '') AS n_redlisted, count(*) FILTER (rank = '종') AS n_rank_species,
      count(*) FILTER (rank = '아종') AS n_rank_subspecies, count(*) FILTER (grade_by = 'sci') AS n_grade_by_sci,
      count(*) FILTER (grade_by = 'kor') AS n_grade_by_kor, count(*) FILTER (red_by = 'sci') AS n_redlist_by_sci,
      count(*) FILTER (red_by = 'kor') AS n_redlist_by_kor FROM rm GROUP BY txgrp""",
)
def master_profile(i: Inputs) -> DataFrame:
    return checklist.master_profile(rated_master(i))


@query(
    "coverage_missing",
    CANON
    + f""" SELECT _ord, sci_name, kor_name FROM v_rated r
    WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE c.match_key = {duck.managed('r.sci_name')})
      AND NOT EXISTS (SELECT 1 FROM canon c WHERE {duck.vern('c.krn')} = {duck.vern('r.kor_name')})""",
)
def coverage_missing(i: Inputs) -> DataFrame:
    missing = checklist.coverage_missing(i.rated(), checklist.build_master(i.raw()))
    return missing.select("_ord", "sci_name", "kor_name")


def lookups(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Name lookup (checklist, then scientific and vernacular names of non-accepted records) and overrides."""
    other = i.raw().where("corsyn = 'N'")
    cols = [F.col("specs_ktsn").alias("accepted_ktsn"), "_ord"]
    sci = other.select(F.lit("sci").alias("alias_type"), F.col("stnm").alias("alias_name"), *cols)
    kor = other.select(F.lit("kor").alias("alias_type"), F.col("krn").alias("alias_name"), *cols)
    return resolve.name_lookup(i.check(), sci, kor), resolve.override_lookup(i.overrides())


@query("name_lookup_build", duck.LOOKUP + " SELECT key_type, key, ktsn FROM lk")
def name_lookup_build(i: Inputs) -> DataFrame:
    return lookups(i)[0]


# Overrides at table scale: every checklist row proposes names, later rows win.
@query(
    "override_lookup_build",
    f""", o AS (
      SELECT _ord, 'sci' AS key_type, {duck.managed('stnm')} AS key, ktsn FROM v_raw
      UNION ALL SELECT _ord, 'kor', {duck.vern('krn')}, ktsn FROM v_raw
      UNION ALL SELECT -_ord, match_type, CASE WHEN match_type = 'sci' THEN {duck.managed('match_name')} ELSE {duck.vern('match_name')} END, accepted_ktsn FROM v_over)
    SELECT key_type, key, arg_max(ktsn, _ord) AS ktsn FROM o WHERE key IS NOT NULL AND key <> '' GROUP BY key_type, key""",
)
def override_lookup_build(i: Inputs) -> DataFrame:
    raw = i.raw()
    rows = (
        raw.select("_ord", F.col("stnm").alias("match_name"), F.lit(" SCI ").alias("match_type"), F.col("ktsn").alias("accepted_ktsn"))
        .unionByName(
            raw.select("_ord", F.col("krn").alias("match_name"), F.lit("kor").alias("match_type"), F.col("ktsn").alias("accepted_ktsn"))
        )
        .unionByName(i.overrides().select((-F.col("_ord")).alias("_ord"), "match_name", "match_type", "accepted_ktsn"))
    )
    return resolve.override_lookup(rows)


_SURVEY_COLS = "_ord, source, sci_name, kor_name, file_group, hint, year, lon, lat"


@query(
    "resolve_names",
    duck.LOOKUP
    + duck.judged("v_survey", "sci_name", "kor_name", _SURVEY_COLS)
    + " SELECT _ord, source, sci_name, kor_name, ktsn, how FROM judged",
)
def resolve_names(i: Inputs) -> DataFrame:
    lookup, overrides = lookups(i)
    return resolve.resolve_names(i.survey(), lookup, overrides).select("_ord", "source", "sci_name", "kor_name", "ktsn", "how")


@query(
    "resolve_names_sci_only",
    duck.LOOKUP
    + duck.judged("v_survey", "sci_name", None, _SURVEY_COLS)
    + " SELECT _ord, source, sci_name, ktsn, how FROM judged",
)
def resolve_names_sci_only(i: Inputs) -> DataFrame:
    lookup, overrides = lookups(i)
    return resolve.resolve_names(i.survey(), lookup, overrides, kor=None).select("_ord", "source", "sci_name", "ktsn", "how")


@query(
    "coverage_report",
    duck.LOOKUP
    + duck.judged("v_survey", "sci_name", "kor_name", _SURVEY_COLS)
    + " SELECT source, count(*) AS n_all, "
    + ", ".join(f"count(*) FILTER (how = '{v}') AS n_{v}" for v in resolve.VERDICTS)
    + """, count(*) FILTER (how IN ('conflict', 'none')) AS n_discarded,
      round_even(count(*) FILTER (how NOT IN ('conflict', 'none')) * 100.0::DOUBLE / count(*), 1) AS match_rate,
      min(year) AS first_year, max(year) AS last_year, count(DISTINCT ktsn) AS n_species FROM judged GROUP BY source""",
)
def coverage_report(i: Inputs) -> DataFrame:
    lookup, overrides = lookups(i)
    return resolve.coverage_report(i.survey(), lookup, overrides)


@query(
    "coverage_by_group",
    duck.LOOKUP
    + duck.judged("v_survey", "sci_name", "kor_name", _SURVEY_COLS)
    + """ SELECT c.taxon_group, count(DISTINCT j.ktsn) AS n_species, count(*) AS n_records FROM judged j JOIN v_check c ON c.ktsn = j.ktsn
      WHERE j.how NOT IN ('conflict', 'none') GROUP BY c.taxon_group""",
)
def coverage_by_group(i: Inputs) -> DataFrame:
    lookup, overrides = lookups(i)
    return resolve.species_per_group(resolve.resolve_names(i.survey(), lookup, overrides), i.check())


@query(
    "discard_list",
    duck.LOOKUP
    + duck.judged("v_survey", "sci_name", "kor_name", _SURVEY_COLS)
    + """ SELECT sci_name, kor_name, arg_min(hint, _ord) AS hint, CASE WHEN how = 'conflict' THEN '충돌' ELSE '미매칭' END AS reason,
      CASE WHEN how = 'conflict' THEN ktsn_sci END AS ktsn_sci, CASE WHEN how = 'conflict' THEN ktsn_kor END AS ktsn_kor, count(*) AS n_discarded
      FROM judged WHERE how IN ('conflict', 'none') GROUP BY sci_name, kor_name, how, ktsn_sci, ktsn_kor""",
)
def discard_list(i: Inputs) -> DataFrame:
    lookup, overrides = lookups(i)
    return resolve.discard_list(i.survey(), lookup, overrides, "hint")


@query(
    "top_unmatched",
    duck.LOOKUP
    + duck.judged("v_survey", "sci_name", "kor_name", _SURVEY_COLS)
    + """ SELECT coalesce(nullif(sci_name, ''), nullif(kk, ''), '(빈값)') AS name, count(*) AS n FROM judged
      WHERE how IN ('conflict', 'none') GROUP BY 1 ORDER BY n DESC, name LIMIT 15""",
)
def top_unmatched(i: Inputs) -> DataFrame:
    lookup, overrides = lookups(i)
    return resolve.top_unmatched(i.survey(), lookup, overrides, 15)


@query(
    "group_mismatch",
    duck.LOOKUP
    + duck.judged("v_survey", "sci_name", None, _SURVEY_COLS)
    + """ SELECT j.file_group, c.taxon_group, count(*) AS n FROM judged j JOIN v_check c ON j.ktsn = c.ktsn
      WHERE c.taxon_group <> j.file_group GROUP BY 1, 2""",
)
def group_mismatch(i: Inputs) -> DataFrame:
    lookup, overrides = lookups(i)
    return resolve.group_mismatch(resolve.resolve_names(i.survey(), lookup, overrides, kor=None), i.check())


RED_MATCH = f"""
, fields AS (
  SELECT ktsn, stnm, krn, corsyn, _ord, lower(trim(gnus)) AS g, lower(trim(specs)) AS s, lower(trim(sspecs)) AS ss, lower(trim(vrty)) AS v FROM v_raw
), keyed AS (
  SELECT *, 'b' AS kind, g || ' ' || s AS key FROM fields WHERE g <> '' AND s <> ''
  UNION ALL SELECT *, 'b', {duck.listed_key('stnm', 2)} FROM fields WHERE g = '' OR s = ''
  UNION ALL SELECT *, 't', g || ' ' || s || ' ' || ss FROM fields WHERE g <> '' AND s <> '' AND ss <> ''
  UNION ALL SELECT *, 't', g || ' ' || s || ' ' || v FROM fields WHERE g <> '' AND s <> '' AND v <> ''
), picks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY corsyn <> 'Y', _ord) AS rn,
    count(*) OVER (PARTITION BY kind, key) AS n FROM keyed WHERE key IS NOT NULL) WHERE rn = 1
), rmatch AS (
  SELECT r._ord, r.sci_name, r.group_label, coalesce(t.ktsn, b.ktsn) AS ktsn, coalesce(t.stnm, b.stnm) AS ktsn_stnm,
    coalesce(t.krn, b.krn) AS ktsn_kor, coalesce(t.corsyn, b.corsyn) AS ktsn_accepted,
    CASE WHEN t.key IS NOT NULL THEN 'trinomial' WHEN b.key IS NOT NULL THEN 'binomial' ELSE 'none' END AS match_type,
    coalesce(t.n, b.n, 0) AS n_candidates
  FROM v_rated r LEFT JOIN picks t ON t.kind = 't' AND t.key = {duck.listed_key('r.sci_name', 3)}
    LEFT JOIN picks b ON b.kind = 'b' AND b.key = {duck.listed_key('r.sci_name', 2)}
)"""


@query(
    "redlist_match",
    RED_MATCH + " SELECT _ord, sci_name, ktsn, ktsn_stnm, ktsn_kor, ktsn_accepted, match_type, n_candidates FROM rmatch",
)
def redlist_match(i: Inputs) -> DataFrame:
    return redlist.match_checklist(i.rated(), i.raw()).select(
        "_ord", "sci_name", "ktsn", "ktsn_stnm", "ktsn_kor", "ktsn_accepted", "match_type", "n_candidates"
    )


@query(
    "redlist_unmatched",
    RED_MATCH
    + """ SELECT group_label, count(*) AS n_all, count(ktsn) AS n_matched, count(*) - count(ktsn) AS n_unmatched,
      round_even(count(ktsn) * 100.0::DOUBLE / count(*), 1) AS match_rate FROM rmatch GROUP BY group_label""",
)
def redlist_unmatched(i: Inputs) -> DataFrame:
    return redlist.match_rates(redlist.match_checklist(i.rated(), i.raw()), "group_label")


#: Candidates that a reviewer is shown for a name (the limit of the ranking, not of its steps).
TOP = 6
CANDIDATES = f"""
, um AS (
  SELECT DISTINCT sci_name, kor_name, CASE WHEN {duck.vern('kor_name')} <> '' THEN {duck.vern('kor_name')}
    WHEN regexp_matches(sci_name, '[가-힣]') THEN {duck.vern('sci_name')} ELSE '' END AS u,
    lower(regexp_extract(sci_name, '[A-Za-z]+', 0)) AS genus FROM v_unmatched
), mk AS (SELECT ktsn, _ord, {duck.vern('korean_name')} AS m, lower(trim(genus_la)) AS genus FROM v_check)
, us AS (SELECT DISTINCT u FROM um WHERE length(u) >= 2)
, sub AS (SELECT us.u, mk.ktsn, mk._ord FROM us JOIN mk ON length(mk.m) >= 2 AND (contains(mk.m, us.u) OR contains(us.u, mk.m)))
, allc AS (
  SELECT um.sci_name, um.kor_name, s.ktsn, s._ord, 0 AS basis_no FROM um JOIN sub s ON s.u = um.u
  UNION ALL SELECT um.sci_name, um.kor_name, mk.ktsn, mk._ord, 1 FROM um JOIN mk ON mk.genus = um.genus AND um.genus <> ''
), once AS (SELECT sci_name, kor_name, ktsn, _ord, min(basis_no) AS basis_no FROM allc GROUP BY ALL)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY sci_name, kor_name ORDER BY basis_no, _ord, ktsn) AS rank FROM once)"""
CANDIDATES = CANDIDATES.replace("GROUP BY ALL", "GROUP BY sci_name, kor_name, ktsn, _ord")


@query(
    "candidate_substring",
    CANDIDATES
    + " SELECT u AS u_kor, ktsn FROM sub",
)
def candidate_substring(i: Inputs) -> DataFrame:
    un = i.unmatched()
    asked = un.select(candidates.unmatched_vernacular(un).alias("u_kor"))
    return candidates.by_substring(asked, i.check()).select("u_kor", "ktsn")


@query(
    "candidate_genus",
    CANDIDATES
    + " SELECT genus, ktsn FROM mk WHERE genus <> '' AND genus IN (SELECT genus FROM um)",
)
def candidate_genus(i: Inputs) -> DataFrame:
    asked = i.unmatched().select(candidates.query_genus().alias("genus"))
    return candidates.by_genus(asked, i.check()).select("genus", "ktsn")


@query(
    "candidate_rank",
    CANDIDATES
    + " SELECT sci_name, kor_name, CAST(rank AS INT) AS rank, CASE basis_no WHEN 0 THEN '국명부분일치' ELSE '동일속' END AS basis, ktsn FROM ranked WHERE rank <= 6",
)
def candidate_rank(i: Inputs) -> DataFrame:
    return candidates.rank_candidates(i.unmatched(), i.check(), TOP)


@query(
    "candidates_by_impact",
    CANDIDATES
    + """, cnt AS (SELECT sci_name, kor_name, CAST(sum(coalesce(TRY_CAST(n_text AS BIGINT), 0)) AS BIGINT) AS n FROM v_unmatched GROUP BY 1, 2)
    SELECT r.sci_name, r.kor_name, CAST(r.rank AS INT) AS rank, r.ktsn, c.n FROM ranked r
    JOIN cnt c ON c.sci_name = r.sci_name AND c.kor_name = r.kor_name WHERE r.rank <= 6 ORDER BY c.n DESC, 1, 2, 3""",
)
def candidates_by_impact(i: Inputs) -> DataFrame:
    un = i.unmatched()
    n = F.coalesce(F.col("n_text").try_cast("bigint"), F.lit(0))
    counts = un.groupBy("sci_name", "kor_name").agg(F.sum(n).alias("n"))
    ranked = candidates.rank_candidates(un, i.check(), TOP).join(counts, ["sci_name", "kor_name"])
    return candidates.by_impact(ranked, "n").select("sci_name", "kor_name", "rank", "ktsn", "n")
