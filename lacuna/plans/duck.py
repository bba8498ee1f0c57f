"""SQL fragments for the checking engine, written independently of the Column rules they check."""

from __future__ import annotations

CONNECTORS = "['subsp','ssp','var','subvar','forma','fo','f','cv','sp','spp','aff','cf']"
SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+"


def words(x: str) -> str:
    return (
        rf"list_filter(regexp_extract_all(regexp_replace(coalesce({x}, ''), '\([^)]*\)', ' ', 'g'), '[A-Za-z]+'), "
        f"lambda t: NOT list_contains({CONNECTORS}, lower(t)))"
    )


def binomial(x: str) -> str:
    w = words(x)
    return f"CASE WHEN len({w}) >= 2 THEN lower(({w})[1] || ' ' || ({w})[2]) END"


def trinomial(x: str) -> str:
    w = words(x)
    return (
        f"CASE WHEN len({w}) >= 3 AND regexp_matches(({w})[3], '^[a-z]') "
        f"THEN lower(({w})[1] || ' ' || ({w})[2] || ' ' || ({w})[3]) END"
    )


def managed(x: str) -> str:
    return f"coalesce({trinomial(x)}, {binomial(x)})"


def vern(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{SPACES}', '', 'g')"


def field_key(g: str, s: str, ss: str) -> str:
    g, s, ss = (f"lower(trim(coalesce({c}, '')))" for c in (g, s, ss))
    return f"CASE WHEN {g} <> '' AND {s} <> '' THEN {g} || ' ' || {s} || CASE WHEN {ss} <> '' THEN ' ' || {ss} ELSE '' END END"


def listed(x: str) -> str:
    return (
        rf"list_filter(string_split_regex(regexp_replace(coalesce({x}, ''), '\([^)]*\)', ' ', 'g'), '\s+'), "
        "lambda t: regexp_matches(t, '^[A-Za-z]'))"
    )


def listed_key(x: str, n: int) -> str:
    w = listed(x)
    return f"CASE WHEN len({w}) >= {n} THEN lower(array_to_string(({w})[1:{n}], ' ')) END"


def half_even(x: str, digits: int) -> str:
    """Half-even rounding of the decimal form; on doubles the engine rounds a scaled binary value."""
    return f"CAST(round_even(CAST({x} AS DECIMAL(28, 12)), {digits}) AS DOUBLE)"


CODES = "['CR','EN','VU','NT','LC','DD','RE','EW','EX','NA','NE']"
LABELS = "['연체동물','거미','관속식물','곤충1','곤충2','곤충3','조류','어류','포유류','파충류','양서류']"

# Name lookup and overrides: master first, then names of non-accepted records.
LOOKUP = f"""
, lk_rows AS (
  SELECT 'sci' AS key_type, match_key AS key, ktsn, 0 AS prio, _ord FROM v_check
  UNION ALL SELECT 'kor', {vern('korean_name')}, ktsn, 0, _ord FROM v_check
  UNION ALL SELECT 'sci', {managed('stnm')}, specs_ktsn, 1, _ord FROM v_raw WHERE corsyn = 'N'
  UNION ALL SELECT 'kor', {vern('krn')}, specs_ktsn, 2, _ord FROM v_raw WHERE corsyn = 'N'
), lk AS (
  SELECT key_type, key, arg_min(ktsn, prio * 1000000000000 + _ord) AS ktsn FROM lk_rows
  WHERE key IS NOT NULL AND key <> '' GROUP BY key_type, key
), ov_rows AS (
  SELECT match_type AS key_type, CASE WHEN match_type = 'sci' THEN {managed('match_name')} ELSE {vern('match_name')} END AS key,
         accepted_ktsn AS ktsn, _ord FROM v_over
), ov AS (
  SELECT key_type, key, arg_max(ktsn, _ord) AS ktsn FROM ov_rows WHERE key IS NOT NULL AND key <> '' GROUP BY key_type, key
)"""


def judged(source: str, sci: str, kor: str | None, columns: str, name: str = "judged") -> str:
    """CTE `name`: rows of `source` with ktsn, how, ktsn_sci, ktsn_kor."""
    kor_key = vern(kor) if kor else "''"
    return f"""
, {name}_k AS (SELECT {columns}, coalesce({managed(sci)}, '') AS sk, {kor_key} AS kk FROM {source})
, {name} AS (
  SELECT k.*, a.ktsn AS ktsn_sci, b.ktsn AS ktsn_kor,
    CASE WHEN coalesce(oa.ktsn, ob.ktsn) IS NOT NULL THEN 'override'
         WHEN a.ktsn IS NOT NULL AND b.ktsn IS NOT NULL THEN CASE WHEN a.ktsn = b.ktsn THEN 'both' ELSE 'conflict' END
         WHEN a.ktsn IS NOT NULL THEN 'sci' WHEN b.ktsn IS NOT NULL THEN 'kor' ELSE 'none' END AS how,
    CASE WHEN coalesce(oa.ktsn, ob.ktsn) IS NOT NULL THEN coalesce(oa.ktsn, ob.ktsn)
         WHEN a.ktsn <> b.ktsn THEN NULL ELSE coalesce(a.ktsn, b.ktsn) END AS ktsn
  FROM {name}_k k
  LEFT JOIN lk a ON a.key_type = 'sci' AND a.key = k.sk LEFT JOIN lk b ON b.key_type = 'kor' AND b.key = k.kk
  LEFT JOIN ov oa ON oa.key_type = 'sci' AND oa.key = k.sk LEFT JOIN ov ob ON ob.key_type = 'kor' AND ob.key = k.kk
)"""


COORDS = ", coords AS (SELECT DISTINCT lon, lat FROM v_obs WHERE lon IS NOT NULL)"
WITHIN = """
, pairs AS (
  SELECT p.lon, p.lat, e.code, e.ord,
    sum(CASE WHEN (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) AS hits,
    max(CASE WHEN (e.x2 - e.x1) * (p.lat - e.y1) = (e.y2 - e.y1) * (p.lon - e.x1)
              AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
              AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2) THEN 1 ELSE 0 END) AS touch
  FROM coords p CROSS JOIN v_edge e GROUP BY p.lon, p.lat, e.code, e.ord
), inside AS (
  SELECT lon, lat, arg_min(code, ord) AS code FROM pairs WHERE hits % 2 = 1 AND touch = 0 GROUP BY lon, lat
)"""


def tm(source: str, lon: str, lat: str, keep: str, name: str, params: tuple[float, float, float, float, float]) -> str:
    """CTEs ending in `name`: `keep` columns and metric px, py."""
    lat0, lon0, k, east, north = params
    f = "(1 / 298.257222101::DOUBLE)"
    n = f"({f} / (2 - {f}))"
    c = f"(2 * sqrt({n}) / (1 + {n}))"
    radius = f"(6378137.0::DOUBLE / (1 + {n}) * (1 + {n} ** 2 / 4 + {n} ** 4 / 64))"
    a1 = f"({n} / 2 - 2 * {n} ** 2 / 3 + 5 * {n} ** 3 / 16)"
    a2 = f"(13 * {n} ** 2 / 48 - 3 * {n} ** 3 / 5)"
    a3 = f"(61 * {n} ** 3 / 240)"
    s0 = f"sin(radians({lat0}::DOUBLE))"
    xi0 = f"atan(sinh(atanh({s0}) - {c} * atanh({c} * {s0})))"
    m0 = f"({k}::DOUBLE * {radius} * ({xi0} + {a1} * sin(2 * {xi0}) + {a2} * sin(4 * {xi0}) + {a3} * sin(6 * {xi0})))"
    return f"""
, {name}_t AS (
  SELECT {keep}, sinh(atanh(sin(radians({lat}))) - {c} * atanh({c} * sin(radians({lat})))) AS t,
         radians({lon} - {lon0}::DOUBLE) AS dl FROM {source}
), {name}_x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM {name}_t)
, {name} AS (
  SELECT *, {east}::DOUBLE + {k}::DOUBLE * {radius} * (eta + {a1} * cos(2 * xi) * sinh(2 * eta)
           + {a2} * cos(4 * xi) * sinh(4 * eta) + {a3} * cos(6 * xi) * sinh(6 * eta)) AS px,
         {north}::DOUBLE - {m0} + {k}::DOUBLE * {radius} * (xi + {a1} * sin(2 * xi) * cosh(2 * eta)
           + {a2} * sin(4 * xi) * cosh(4 * eta) + {a3} * sin(6 * xi) * cosh(6 * eta)) AS py
  FROM {name}_x
)"""


TM_5179 = (38.0, 127.5, 0.9996, 1000000.0, 2000000.0)
TM_5186 = (38.0, 127.0, 1.0, 200000.0, 600000.0)
EDGES_M = (
    tm("v_edge", "x1", "y1", "code, ord, x1, y1, x2, y2", "ea", TM_5179)
    + tm("ea", "x2", "y2", "code, ord, px AS ax, py AS ay", "eb", TM_5179)
)
NEAREST = (
    ", missed AS (SELECT c.lon, c.lat FROM coords c LEFT JOIN inside i ON c.lon = i.lon AND c.lat = i.lat WHERE i.code IS NULL)"
    + tm("missed", "lon", "lat", "lon, lat", "mm", TM_5179)
    + EDGES_M
    + """
, seg AS (
  SELECT m.lon, m.lat, e.code, e.ord, m.px, m.py, e.ax, e.ay, e.px AS bx, e.py AS b_y,
    CASE WHEN (e.px - e.ax) ** 2 + (e.py - e.ay) ** 2 > 0 THEN
      ((m.px - e.ax) * (e.px - e.ax) + (m.py - e.ay) * (e.py - e.ay)) / ((e.px - e.ax) ** 2 + (e.py - e.ay) ** 2) ELSE 0 END AS t
  FROM mm m CROSS JOIN eb e
), dist AS (
  SELECT lon, lat, code, ord,
    round(sqrt((px - (ax + greatest(0, least(1, t)) * (bx - ax))) ** 2 + (py - (ay + greatest(0, least(1, t)) * (b_y - ay))) ** 2), 3) AS d
  FROM seg
), near AS (
  SELECT lon, lat, arg_min(code, {'d': d, 'o': ord}) AS code, min(d) AS d FROM dist WHERE d <= 2000 GROUP BY lon, lat
)"""
)
