"""Red-list text: lines → records → editions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import redlist
from lacuna.plans import duck
from lacuna.plans.registry import query
from lacuna.plans.standin import Inputs
from lacuna.session import staged

_SPLITS = ", ".join(
    f"('{head}', '{rest}', '{label}')" for head, rests in redlist.split_labels().items() for rest, label in rests.items()
)
REPAIRED = rf"""
, sp AS (SELECT * FROM (VALUES {_SPLITS}) t(head, rest, label))
, merged AS (
  SELECT a.doc, a.line_no, s.label || ' ' || regexp_replace(substring(b.line, length(s.rest) + 1), '^[ ?]+', '') AS line
  FROM v_lines a JOIN v_lines b ON a.doc = b.doc AND b.line_no = a.line_no + 1 JOIN sp s ON trim(a.line) = s.head AND starts_with(b.line, s.rest)
), fixed AS (
  SELECT doc, line_no, line FROM merged
  UNION ALL SELECT l.doc, l.line_no, l.line FROM v_lines l
  WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.doc = l.doc AND (m.line_no = l.line_no OR m.line_no + 1 = l.line_no))
)"""
_HEAD = " OR ".join(["contains(line, '•')", "starts_with(line, '=====')", *[f"starts_with(line, '{h}')" for h in redlist.HEADERS]])
RECORDS = REPAIRED + rf"""
, mk AS (SELECT *, list_contains({duck.LABELS}, string_split_regex(trim(line), '\s+')[1]) AS st FROM fixed)
, ow AS (SELECT *, max(CASE WHEN st THEN line_no END) OVER (PARTITION BY doc ORDER BY line_no) AS start_no FROM mk)
, rec AS (SELECT doc, start_no, string_agg(line, ' ' ORDER BY line_no) AS record FROM ow
  WHERE start_no IS NOT NULL AND (st OR NOT ({_HEAD})) GROUP BY doc, start_no)"""


def fields(source: str, text: str, keep: str, first: int) -> str:
    """CTE `pf`: kor, sci and codes of every text, the vernacular starting at 1-based token `first`."""
    hangul = "(regexp_matches(t, '[가-힣]') AND NOT regexp_matches(t, '^[A-Za-z]'))"
    codes = "|".join(redlist.CODES)
    return rf"""
, tk AS (SELECT {keep}, string_split_regex(trim(regexp_replace({text}, '([a-z0-9\)\],])({codes})\b', '\1 \2', 'g')), '\s+') AS toks FROM {source})
, rs AS (SELECT *, toks[{first}:] AS r FROM tk)
, ri AS (SELECT *, coalesce(nullif(list_position(list_transform(r, lambda t: NOT {hangul}), true), 0), len(r) + 1) AS i FROM rs)
, rt AS (SELECT *, r[i:] AS tail FROM ri)
, rj AS (SELECT *, list_transform(tail, lambda t: trim(t, '.,;:()[]')) AS bare FROM rt)
, pf AS (SELECT *, array_to_string(r[1:i - 1], ' ') AS kor_name,
    array_to_string(tail[1:coalesce(nullif(list_position(list_transform(bare, lambda t: list_contains({duck.CODES}, t)), true), 0), len(tail) + 1) - 1], ' ') AS sci_name,
    list_filter(bare, lambda t: list_contains({duck.CODES}, t)) AS codes FROM rj)"""


PARSED = (
    RECORDS
    + fields("rec", "record", "doc, start_no, record", 2)
    + f""", tagged AS (SELECT *, CASE WHEN len(toks) < 4 OR NOT list_contains({duck.LABELS}, toks[1]) THEN 'not_data' WHEN sci_name = '' THEN 'no_sci'
      WHEN len(codes) = 0 THEN 'no_code' END AS reason FROM pf)
    , base AS (SELECT doc, start_no AS _ord, toks[1] AS group_label, sci_name, kor_name, codes[-1] AS code FROM tagged WHERE reason IS NULL)"""
)


@query("repair_split_label", REPAIRED + " SELECT doc, CAST(line_no AS BIGINT) AS line_no, line FROM fixed")
def repair_split_label(i: Inputs) -> DataFrame:
    return redlist.repair_split_label(i.lines())


def records(i: Inputs) -> DataFrame:
    return redlist.unwrap_records(redlist.repair_split_label(i.lines()))


@query("record_unwrap", RECORDS + " SELECT doc, start_no, record FROM rec")
def record_unwrap(i: Inputs) -> DataFrame:
    return records(i)


@query("parse_redlist_records", PARSED + " SELECT doc, _ord, group_label, sci_name, kor_name, code FROM base")
def parse_redlist_records(i: Inputs) -> DataFrame:
    return redlist.parse_records(records(i)).drop("source_year")


@query("tag_parse_failure", PARSED + " SELECT doc, start_no, reason, record FROM tagged WHERE reason IS NOT NULL")
def tag_parse_failure(i: Inputs) -> DataFrame:
    return redlist.parse_failures(records(i))


_INSECTS = (
    fields("v_lines", "line", "doc, line_no", 1).replace("tk AS", "itk AS").replace("FROM tk", "FROM itk")
    .replace("rs AS", "irs AS").replace("FROM rs", "FROM irs").replace("ri AS", "iri AS").replace("FROM ri", "FROM iri")
    .replace("rt AS", "irt AS").replace("FROM rt", "FROM irt").replace("rj AS", "irj AS").replace("FROM rj", "FROM irj")
    .replace("pf AS", "ipf AS")
    + r""", ins AS (SELECT doc, line_no AS _ord, sci_name, kor_name, codes[1] AS code FROM ipf WHERE len(toks) >= 3 AND regexp_matches(toks[-1], '^-*\d+$')
      AND regexp_matches(toks[1], '[가-힣]') AND NOT regexp_matches(toks[1], '^[A-Za-z]') AND kor_name <> '' AND sci_name <> '' AND len(codes) > 0)"""
)


@query("parse_insect_lines", _INSECTS + " SELECT doc, _ord, sci_name, kor_name, code FROM ins")
def parse_insect_lines(i: Inputs) -> DataFrame:
    return redlist.parse_insect_lines(i.lines())


_ORD = "CAST(substring(doc, 4) AS BIGINT) * 1500 + _ord"


@query(
    "merge_update_append",
    PARSED
    + _INSECTS
    + f""", sk AS (SELECT {_ORD} AS o, group_label, sci_name, kor_name, code, lower(array_to_string(({duck.listed('sci_name')})[1:2], ' ')) AS s, {duck.vern('kor_name')} AS k FROM base)
    , nk AS (SELECT {_ORD} AS o, sci_name, kor_name, code, lower(array_to_string(({duck.listed('sci_name')})[1:2], ' ')) AS s, {duck.vern('kor_name')} AS k FROM ins)
    , bs AS (SELECT s, max(o) AS o FROM sk WHERE s <> '' GROUP BY s), bk AS (SELECT k, max(o) AS o FROM sk WHERE k <> '' GROUP BY k)
    , aim AS (SELECT n.*, coalesce(bs.o, bk.o) AS target FROM nk n LEFT JOIN bs ON bs.s = n.s LEFT JOIN bk ON bk.k = n.k)
    , up AS (SELECT target, arg_max(code, o) AS code FROM aim WHERE target IS NOT NULL GROUP BY target)
    SELECT group_label, sci_name, kor_name, coalesce(up.code, sk.code) AS code, CASE WHEN up.code IS NULL THEN '2024(통합본)' ELSE '2025(곤충IV)' END AS source_year
    FROM sk LEFT JOIN up ON up.target = sk.o UNION ALL SELECT '곤충4', sci_name, kor_name, code, '2025(곤충IV)' FROM aim WHERE target IS NULL""",
)
def merge_update_append(i: Inputs) -> DataFrame:
    order = F.expr(_ORD)
    base = staged(redlist.parse_records(records(i)).withColumn("_ord", order), "base-edition")
    newer = staged(redlist.parse_insect_lines(i.lines()).withColumn("_ord", order), "new-edition")
    return redlist.merge_editions(base, newer)
