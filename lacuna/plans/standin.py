"""Stand-in inputs: checklist, ratings, observations, boundaries, rasters and text lines over the test tables.

Every expression below is written so that Spark SQL and DuckDB read it alike; one list of columns serves
`selectExpr` here and the SQL views used for checking. Coordinates are multiples of 1/64, exact in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import staged


def letters(e: str) -> str:
    return f"translate(CAST({e} AS STRING), '0123456789', 'abcdefghij')"


def hangul(e: str) -> str:
    return f"translate(CAST({e} AS STRING), '0123456789', '가나다라마바사아자차')"


def fold(k: str) -> str:
    """Four consecutive parts share a name."""
    return f"CAST(floor({k} / 4) AS BIGINT)"


def genus(k: str) -> str:
    return f"concat('Gn', {letters(f'{fold(k)} % 197')})"


def species(k: str) -> str:
    return f"concat('sp', {letters(fold(k))})"


def vernacular(k: str) -> str:
    kind = f"CASE {k} % 4 WHEN 0 THEN '나비' WHEN 1 THEN '나무' WHEN 2 THEN '나무이끼' ELSE '풀' END"
    return f"concat({hangul(fold(k))}, ' ', {kind})"


GROUPS = ("MM", "AV", "-P", "IN", "VP", "UC")
GROUP = (
    "CASE p_type WHEN 'ECONOMY' THEN 'MM' WHEN 'PROMO' THEN 'AV' WHEN 'SMALL' THEN '-P' "
    "WHEN 'STANDARD' THEN 'IN' WHEN 'MEDIUM' THEN 'VP' ELSE 'UC' END"
)
_SUB = f"CASE WHEN p_partkey % 4 = 3 AND {fold('p_partkey')} % 3 = 0 THEN concat('ss', {letters('p_partkey % 10')}) ELSE '' END"
_VAR = f"CASE WHEN p_size % 3 = 0 THEN concat('vr', {letters('p_size')}) ELSE '' END"
_KRN = f"CASE WHEN p_partkey % 11 = 0 THEN '' ELSE {vernacular('p_partkey')} END"
_ORDER = "CASE WHEN p_brand = 'Brand#7' THEN 'Cetacea' ELSE concat('Ordo', substring(p_brand, 7, 1)) END"
_FAMILY = "CASE WHEN p_brand = 'Brand#9' THEN 'Phocidae' ELSE p_brand END"
_GRADE = "CASE WHEN p_size <= 3 THEN 'I' WHEN p_size <= 8 THEN 'II' ELSE '' END"
_RED = "CASE WHEN p_size % 7 = 0 THEN 'CR' WHEN p_size % 7 = 1 THEN 'VU' WHEN p_size % 7 = 2 THEN 'LC' ELSE '' END"

# Raw checklist records.
RAW = {
    "_ord": "p_partkey",
    "ktsn": "p_partkey",
    "gnus": genus("p_partkey"),
    "specs": f"CASE WHEN p_partkey % 41 = 0 THEN '' ELSE {species('p_partkey')} END",
    "sspecs": _SUB,
    "vrty": _VAR,
    "krn": _KRN,
    "corsyn": "CASE WHEN p_size % 10 = 0 THEN 'N' ELSE 'Y' END",
    "txgrp": GROUP,
    "class_la": "concat('Classis', substring(p_brand, 7, 1))",
    "order_la": _ORDER,
    "family_la": _FAMILY,
    "specs_ktsn": f"CASE WHEN p_size % 10 = 0 THEN {fold('p_partkey')} * 4 + p_size % 4 ELSE p_partkey END",
    "stnm": (
        f"concat({genus('p_partkey')}, ' (Subgenus) ', {species('p_partkey')}, "
        f"CASE WHEN p_partkey % 4 = 3 THEN concat(' subsp. ', 'ss', {letters('p_partkey % 10')}) ELSE '' END, "
        "' (L.) Author, 1823')"
    ),
    "egspcs": "CASE WHEN p_size <= 8 THEN 'Y' ELSE 'N' END",
}

# Published checklist: one row per accepted record.
CHECK = {
    "_ord": "p_partkey",
    "ktsn": "p_partkey",
    "taxon_group": GROUP,
    "scientific_name": f"concat({genus('p_partkey')}, ' ', {species('p_partkey')})",
    "match_key": f"lower(concat({genus('p_partkey')}, ' ', {species('p_partkey')}))",
    "korean_name": _KRN,
    "genus_la": genus("p_partkey"),
    "order_la": _ORDER,
    "family_la": _FAMILY,
    "grade": _GRADE,
    "redlist": _RED,
}
CHECK_WHERE = "p_size % 10 <> 0"

# Rating rows: only rated species are listed, as in a threatened-species table, with grades in several spellings.
RATED = {
    "_ord": "p_partkey",
    "sci_name": f"concat({genus('p_partkey + 4 * (p_partkey % 3)')}, ' ', {species('p_partkey + 4 * (p_partkey % 3)')}, CASE WHEN p_partkey % 4 = 3 THEN concat(' ss', {letters('p_partkey % 10')}) ELSE '' END, ' Auth.')",
    "kor_name": f"CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {vernacular('p_partkey')} END",
    "grade": "CASE p_size WHEN 1 THEN 'Ⅰ급' WHEN 2 THEN '1' WHEN 3 THEN ' I' WHEN 4 THEN 'Ⅱ' WHEN 5 THEN 'ii 급' WHEN 6 THEN '2' WHEN 7 THEN '' ELSE '기타 급' END",
    "redlist": _RED,
    "group_label": GROUP,
}
RATED_WHERE = "p_size <= 9"

_LON = "CAST(124 AS DOUBLE) + CAST((l_orderkey * 7 + l_linenumber * 13) % 448 AS DOUBLE) / 64"
_LAT = "CAST(33 AS DOUBLE) + CAST((l_orderkey * 11 + l_suppkey * 5) % 320 AS DOUBLE) / 64"
_NO_SITE = "l_orderkey % 50 = 0"
_ROW = "(l_orderkey * 11 + l_suppkey * 5) % 320"
_COL = "(l_orderkey * 7 + l_linenumber * 13) % 448"

# Resolved observations. The district is a function of the position: a block of 80 × 64 steps.
OBS = {
    "_ord": "l_orderkey * 8 + l_linenumber",
    "ktsn": "l_partkey - CASE WHEN l_partkey % 13 = 5 THEN 1 ELSE 0 END",  # some species have no record
    "source": "concat(l_returnflag, l_linestatus)",
    "year": "CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS INT) END",
    "lon": f"CASE WHEN {_NO_SITE} THEN NULL ELSE {_LON} END",
    "lat": f"CASE WHEN {_NO_SITE} THEN NULL ELSE {_LAT} END",
    "region": (
        f"CASE WHEN {_NO_SITE} THEN '00000' ELSE concat(CAST(11 + CAST(floor({_ROW} / 64) AS BIGINT) AS STRING), "
        f"lpad(CAST(CAST(floor({_COL} / 80) AS BIGINT) * 10 AS STRING), 3, '0')) END"
    ),
}

_OTHER = "(l_partkey + 4 * (l_orderkey % 3))"
# Raw survey records, with blank, overridden, conflicting and unknown names.
SURVEY = {
    "_ord": "l_orderkey * 8 + l_linenumber",
    "sci_name": (
        "CASE WHEN l_linenumber = 1 THEN '' WHEN l_orderkey % 17 = 0 THEN 'Parus major L.' "
        "WHEN l_orderkey % 19 = 0 THEN concat('Ignotus species', "
        f"{letters('l_suppkey')}) WHEN l_orderkey % 13 = 0 THEN concat({genus(_OTHER)}, ' ', {species(_OTHER)}) "
        f"ELSE concat({genus('l_partkey')}, ' ', {species('l_partkey')}, ' (Auth.) 1899') END"
    ),
    "kor_name": (
        "CASE WHEN l_linenumber = 2 THEN '' WHEN l_orderkey % 19 = 0 THEN concat('모름', "
        f"{hangul('l_suppkey')}) WHEN l_orderkey % 23 = 0 THEN '박 새' ELSE {vernacular('l_partkey')} END"
    ),
    "examin_year": (
        "CASE WHEN l_orderkey % 29 = 0 THEN '' WHEN l_orderkey % 31 = 0 THEN '4225' "
        "WHEN l_orderkey % 37 = 0 THEN '98' ELSE CAST(year(l_shipdate) AS STRING) END"
    ),
    "begin_de": "CASE WHEN l_orderkey % 58 = 0 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
    "source": "concat(l_returnflag, l_linestatus)",
    "file_group": "CASE l_suppkey % 5 WHEN 0 THEN 'MM' WHEN 1 THEN 'AV' WHEN 2 THEN 'IN' WHEN 3 THEN 'VP' ELSE '-P' END",
    "hint": "concat('분류', CAST(l_suppkey % 7 AS STRING))",
    "year": "CAST(year(l_shipdate) AS INT)",
    "lon_text": f"CASE WHEN {_NO_SITE} THEN '' WHEN l_orderkey % 53 = 0 THEN 'abc' WHEN l_orderkey % 59 = 0 THEN 'NaN' ELSE CAST({_LON} AS STRING) END",
    "lat_text": f"CASE WHEN {_NO_SITE} THEN '' WHEN l_orderkey % 61 = 0 THEN ' ' ELSE concat(' ', CAST({_LAT} AS STRING)) END",
    "lon": f"CASE WHEN {_NO_SITE} THEN NULL ELSE {_LON} END",
    "lat": f"CASE WHEN {_NO_SITE} THEN NULL ELSE {_LAT} END",
}

# Occurrence-style records.
OCC = {
    "_ord": "l_orderkey * 8 + l_linenumber",
    "gbifID": "l_orderkey * 8 + l_linenumber",
    "species": f"CASE WHEN l_orderkey % 43 = 0 THEN '' ELSE concat({genus('l_partkey')}, ' ', {species('l_partkey')}) END",
    "scientificName": f"CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat({genus('l_partkey')}, ' ', {species('l_partkey')}, ' Auth., 1900') END",
    "year": "CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 47 = 0 THEN 1850 ELSE CAST(year(l_shipdate) AS INT) END",
    "eventDate": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "decimalLongitude": f"CASE WHEN {_NO_SITE} THEN NULL ELSE {_LON} END",
    "decimalLatitude": f"CASE WHEN {_NO_SITE} THEN NULL ELSE {_LAT} END",
    "coordinateUncertaintyInMeters": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice / 10 END",
    "basisOfRecord": "CASE l_linenumber WHEN 1 THEN 'FOSSIL_SPECIMEN' WHEN 2 THEN 'LIVING_SPECIMEN' ELSE 'HUMAN_OBSERVATION' END",
    "countryCode": "CASE WHEN l_suppkey % 4 = 0 THEN 'JP' ELSE 'KR' END",
    "hasCoordinate": f"NOT ({_NO_SITE})",
    "hasGeospatialIssue": "l_orderkey % 10 = 0",
    "occurrenceStatus": "CASE WHEN l_linestatus = 'F' THEN 'PRESENT' ELSE 'ABSENT' END",
    "taxonKey": "l_suppkey",
}

# Names left without a match, with the number of discarded records as text.
UNMATCHED = {
    "sci_name": (
        f"CASE c_custkey % 4 WHEN 0 THEN concat('Gn', {letters('c_custkey % 197')}, ' ignota') "
        f"WHEN 1 THEN concat({hangul('c_custkey % 70')}, ' 나무') ELSE '' END"
    ),
    "kor_name": (
        f"CASE WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 8 = 2 THEN concat('큰', {hangul('c_custkey % 90')}, '나무이끼벌레') "
        f"WHEN c_custkey % 8 = 3 THEN {hangul('c_custkey % 10')} ELSE concat({hangul('c_custkey % 90')}, '나', ' 무') END"
    ),
    "n_text": "CASE WHEN c_custkey % 9 = 0 THEN '?' ELSE CAST(c_nationkey AS STRING) END",
    "_ord": "c_custkey",
}

# Text lines: three per part, in volumes of 1,500 consecutive lines.
_LABEL = (
    "CASE p_size % 5 WHEN 0 THEN '연체동물' WHEN 1 THEN '관속식물' WHEN 2 THEN '곤충1' WHEN 3 THEN '조류' ELSE '포유류' END"
)
_NAME = f"concat({genus('p_partkey')}, ' ', {species('p_partkey')})"
_KNAME = f"CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat({vernacular('p_partkey')}, ' ') END"
_BODY = (
    f"concat({_KNAME}, CASE WHEN p_partkey % 31 = 0 THEN '' ELSE {_NAME} END, "
    "CASE p_partkey % 4 WHEN 0 THEN ' Shin' WHEN 1 THEN ' (Linnaeus, 1823)' WHEN 2 THEN ' Kim, ' ELSE ' Auth (i)' END, "
    "CASE p_size % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'VU' WHEN 2 THEN 'LC' ELSE ' none' END)"
)
_CUT = "p_partkey % 13 = 0 AND p_size % 5 <> 3"
LINE_TEXT = {
    0: f"CASE WHEN {_CUT} THEN substring({_LABEL}, 1, length({_LABEL}) - 1) ELSE concat({_LABEL}, ' ', {_BODY}) END",
    1: (
        f"CASE WHEN {_CUT} THEN concat(substring({_LABEL}, length({_LABEL}), 1), '? ', {_BODY}) "
        "WHEN p_partkey % 9 = 0 THEN concat('현황 ', CAST(p_partkey AS STRING)) "
        f"WHEN p_partkey % 8 = 1 THEN concat({vernacular('p_partkey')}, ' ', {_NAME}, ' Lee VU A2 ', CAST(p_partkey AS STRING)) "
        "ELSE 'D2 2011' END"
    ),
    2: (
        "CASE WHEN p_partkey % 7 = 0 THEN concat('• ', CAST(p_partkey AS STRING)) WHEN p_partkey % 3 = 0 THEN 'CR. B1ab(iii)' "
        f"WHEN p_partkey % 8 = 2 THEN concat({hangul('p_partkey')}, '벌레 ', {genus('p_partkey')}, ' nova', {letters('p_partkey')}, ' (Bates, 1866)NT LC -', CAST(p_partkey AS STRING)) "
        "ELSE concat('Hist. ', p_name) END"
    ),
}
LINES = {
    "doc": "concat('vol', CAST(CAST(floor(p_partkey / 500) AS BIGINT) AS STRING))",
    "line_no": "p_partkey % 500 * 3 + {i}",
    "line": "{text}",
}

# Boundaries: one concave pentagon per nation.
CELL = {
    "code": "concat(CAST(11 + n_regionkey AS STRING), lpad(CAST(n_nationkey * 10 AS STRING), 3, '0'))",
    "ord": "CAST(n_nationkey AS BIGINT)",
    "ox": "CAST(124 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(1.25 AS DOUBLE)",
    "oy": "CAST(33 AS DOUBLE) + CAST(CAST(floor(n_nationkey / 5) AS BIGINT) AS DOUBLE)",
}
CORNERS = ((0.0, 0.0), (1.25, 0.0), (1.25, 1.0), (0.625, 0.5), (0.0, 1.0))

# Raster: values per cell and flag drawn from the observations, some missing.
RASTER = {
    "var": "CASE l_returnflag WHEN 'A' THEN 'bio01' WHEN 'N' THEN 'bio12' ELSE 'dem' END",
    "row": _ROW,
    "col": _COL,
    "q": "CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)",
}
RASTER_VALUE = "CASE WHEN q % 23 = 0 THEN NULL ELSE CAST(q AS DOUBLE) / 8 END"

# Curated overrides (fixed values of the domain), with one row superseded by a later one.
OVERRIDES = (
    (1, "박새", "kor", 3, "name_reassignment"),
    (2, "Parus major", "sci", 1, "superseded"),
    (3, "Parus major (Linnaeus)", "sci", 3, "name_reassignment"),
    (4, "꼬리치레 도롱뇽", "kor", 7, "species_split"),
    (5, "Rana sp.", "sci", 9, "no key"),
)


def exprs(cols: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in cols.items()]


def select_list(cols: dict[str, str]) -> str:
    return ", ".join(exprs(cols))


class Inputs:
    """Stand-in inputs read from one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw(self) -> DataFrame:
        return self.table("part").selectExpr(*exprs(RAW))

    def check(self) -> DataFrame:
        return self.table("part").where(CHECK_WHERE).selectExpr(*exprs(CHECK))

    def rated(self) -> DataFrame:
        return self.table("part").where(RATED_WHERE).selectExpr(*exprs(RATED))

    def obs(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*exprs(OBS))

    def survey(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*exprs(SURVEY))

    def occ(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*exprs(OCC))

    def unmatched(self) -> DataFrame:
        """Written and read back, as the discard list is between two stages."""
        return staged(self.table("customer").selectExpr(*exprs(UNMATCHED)), "unmatched")

    def lines(self) -> DataFrame:
        """The three lines of a part are produced by one scan."""
        doc = LINES["doc"]
        three = ", ".join(
            f"struct({LINES['line_no'].format(i=i)} AS line_no, {text} AS line)" for i, text in LINE_TEXT.items()
        )
        return self.table("part").selectExpr(f"{doc} AS doc", f"inline(array({three}))")

    def cells(self) -> DataFrame:
        return self.table("nation").selectExpr(*exprs(CELL))

    def rings(self) -> DataFrame:
        corner = ", ".join(f"array(ox + {dx}D, oy + {dy}D)" for dx, dy in CORNERS)
        return self.cells().selectExpr("code", "ord", f"array({corner}) AS vertices")

    def raster(self) -> DataFrame:
        keys = [f"{RASTER[k]} AS {k}" for k in ("var", "row", "col")]
        base = self.table("lineitem").selectExpr(*keys, "l_quantity")
        summed = base.groupBy("var", "row", "col").agg(F.expr(RASTER["q"]).alias("q"))
        return summed.selectExpr("var", "row", "col", f"{RASTER_VALUE} AS value")

    def overrides(self) -> DataFrame:
        rows = ", ".join(f"({o}L, '{n}', '{t}', {k}L, '{r}')" for o, n, t, k, r in OVERRIDES)
        return self.spark.sql(
            f"SELECT * FROM VALUES {rows} AS t(_ord, match_name, match_type, accepted_ktsn, reason)"
        )


def duck_views() -> str:
    """WITH clause that defines the same inputs in DuckDB."""
    lines = " UNION ALL ".join(
        f"SELECT {LINES['doc']} AS doc, {LINES['line_no'].format(i=i)} AS line_no, {text} AS line FROM part"
        for i, text in LINE_TEXT.items()
    )
    closed = [*CORNERS, CORNERS[0]]
    edges = " UNION ALL ".join(
        f"SELECT code, ord, ox + CAST({a[0]} AS DOUBLE) AS x1, oy + CAST({a[1]} AS DOUBLE) AS y1, "
        f"ox + CAST({b[0]} AS DOUBLE) AS x2, oy + CAST({b[1]} AS DOUBLE) AS y2 FROM v_cell"
        for a, b in zip(closed, closed[1:])
    )
    over = ", ".join(f"({o}, '{n}', '{t}', {k}, '{r}')" for o, n, t, k, r in OVERRIDES)
    views = {
        "v_raw": f"SELECT {select_list(RAW)} FROM part",
        "v_check": f"SELECT {select_list(CHECK)} FROM part WHERE {CHECK_WHERE}",
        "v_rated": f"SELECT {select_list(RATED)} FROM part WHERE {RATED_WHERE}",
        "v_obs": f"SELECT {select_list(OBS)} FROM lineitem",
        "v_survey": f"SELECT {select_list(SURVEY)} FROM lineitem",
        "v_occ": f"SELECT {select_list(OCC)} FROM lineitem",
        "v_unmatched": f"SELECT {select_list(UNMATCHED)} FROM customer",
        "v_lines": lines,
        "v_cell": f"SELECT {select_list(CELL)} FROM nation",
        "v_edge": edges,
        "v_raster": (
            f'SELECT var, "row", col, {RASTER_VALUE} AS value FROM (SELECT {RASTER["var"]} AS var, {_ROW} AS "row", '
            f"{_COL} AS col, {RASTER['q']} AS q FROM lineitem GROUP BY 1, 2, 3)"
        ),
        "v_over": (
            f"SELECT * FROM (VALUES {over}) t(_ord, match_name, match_type, accepted_ktsn, reason)"
        ),
        "v_agg": (
            "SELECT ktsn, region, year, source, count(DISTINCT {'a': lon, 'b': lat}) AS obs_count "
            "FROM v_obs GROUP BY ktsn, region, year, source"
        ),
        "v_gagg": "SELECT a.*, c.taxon_group FROM v_agg a JOIN v_check c ON a.ktsn = c.ktsn",
    }
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in views.items())
