"""Source queries: every file is first written by Spark from the tables, then read back by the reader under test."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import checklist, observe, spatial
from lacuna.plans import duck
from lacuna.plans.registry import query
from lacuna.plans.standin import Inputs
from lacuna.session import scratch_path
from lacuna.sources import readers, writers


@query(
    "scan_checklist_json",
    "SELECT ktsn, stnm, krn, corsyn, txgrp, gnus, specs, sspecs, vrty, specs_ktsn, _ord FROM v_raw "
    "WHERE ktsn % 17 <> 0 AND ktsn % 19 <> 0",
)
def scan_checklist_json(i: Inputs) -> DataFrame:
    fields = {c: f for f, c in readers.CHECKLIST_FIELDS.items()}
    raw = i.raw()
    doc = F.to_json(F.struct(*[F.col(c).cast("string").alias(f) for c, f in fields.items()], "_ord"))
    broken = F.when(F.col("ktsn") % 17 == 0, F.substring(doc, 2, 40)).when(F.col("ktsn") % 19 == 0, "").otherwise(doc)
    path = scratch_path(i.spark, "checklist")
    raw.select(broken.alias("value")).write.text(path)
    return readers.scan_checklist(i.spark, path).select(
        "ktsn", "stnm", "krn", "corsyn", "txgrp", "gnus", "specs", "sspecs", "vrty", "specs_ktsn", "_ord"
    )


_LAYER = (
    "CASE _ord % 6 WHEN 0 THEN 'mv_dat_bgts_bird_point_2019' WHEN 1 THEN 'mv_map_ecpe_land_plant_pyn' "
    "WHEN 2 THEN 'mv_dat_ntee_mammal_point' WHEN 3 THEN 'mv_dat_wtl_fish_point_2020' WHEN 4 THEN 'other_layer' "
    "ELSE 'mv_dat_ecpe_insect_point_2021' END"
)
_PROG = (
    "CASE _ord % 6 WHEN 0 THEN 'bgts' WHEN 1 THEN 'ecpe' WHEN 2 THEN 'ntee' WHEN 3 THEN 'wtl' WHEN 4 THEN 'etc' ELSE 'ecpe' END"
)


def _survey_json(i: Inputs) -> DataFrame:
    s = i.survey()
    return s.select(
        F.expr(_LAYER).alias("layer"),
        F.to_json(
            F.struct(
                F.col("sci_name").alias("spcs_scncenm"), F.col("kor_name").alias("spcs_korean_nm"),
                F.lit("").alias("spcs_lcnm"), "examin_year", F.col("begin_de").alias("examin_begin_de"),
                F.lit("Point").alias("_geom_type"),
                F.when(F.col("lon").isNotNull(), F.array("lon", "lat")).alias("_coords"), "_ord",
            )
        ).alias("value"),
    )


@query(
    "scan_survey_json",
    f"SELECT _ord, sci_name, {duck.vern('kor_name')} AS kor_name, {_PROG} AS source, lon, lat FROM v_survey",
)
def scan_survey_json(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "survey")
    named = _survey_json(i).withColumn("file", F.concat(F.lit("ecobank_"), "layer"))
    # The lines are written once and read once; a part file holds the lines of one task, so it need not be split.
    named.select("file", "value").write.partitionBy("file").option("compression", "gzip").text(path)
    raw = readers.scan_survey(i.spark, f"{path}/*", by_folder=True)
    return observe.survey_rows(raw).select("_ord", "sci_name", "kor_name", "source", "lon", "lat")


_PART_LAYER = (
    "concat(CASE WHEN p_partkey % 9 = 0 THEN 'x_' ELSE 'mv_' END, CASE WHEN p_size % 2 = 0 THEN 'map_' ELSE 'dat_' END, "
    "CASE p_size % 3 WHEN 0 THEN 'bgts' WHEN 1 THEN 'ntee' ELSE 'wtl' END, '_', replace(p_name, ' ', '_'), "
    "CASE WHEN p_size % 5 = 0 THEN '_pyn' ELSE '_point' END, CASE WHEN p_partkey % 4 = 0 THEN concat('_', CAST(2000 + p_size AS STRING)) ELSE '' END)"
)
_LAYER_RE = r"^mv_(?:map|dat)_([a-z]+)_(.+)_(point|pyn)(?:_(\d+))?$"


@query(
    "parse_layer_name",
    f", l AS (SELECT p_partkey, {_PART_LAYER} AS layer FROM part) SELECT p_partkey, layer, "
    f"coalesce(nullif(regexp_extract(layer, '{_LAYER_RE}', 1), ''), 'etc') AS prog, "
    f"split_part(coalesce(regexp_extract(layer, '{_LAYER_RE}', 2), ''), '_', 1) AS taxon, coalesce(regexp_extract(layer, '{_LAYER_RE}', 3), '') AS geom, "
    f"coalesce(regexp_extract(layer, '{_LAYER_RE}', 4), '') AS layer_year FROM l",
)
def parse_layer_name(i: Inputs) -> DataFrame:
    named = i.table("part").select("p_partkey", F.expr(_PART_LAYER).alias("layer"))
    fields = readers.layer_fields(F.col("layer"))
    return named.select("p_partkey", "layer", *[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()])


_PARK = {
    "종명": "sci_name", "분류명": "kor_name", "조사일자": "begin_de", "경도": "lon_text", "위도": "lat_text", "생물분류": "hint",
}


@query(
    "scan_cp949_csv",
    "SELECT sci_name, kor_name, begin_de, trim(coalesce(lon_text, '')) AS lon_text, trim(coalesce(lat_text, '')) AS lat_text, hint, count(*) AS n "
    "FROM v_survey GROUP BY 1, 2, 3, 4, 5, 6",
)
def scan_cp949_csv(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "park")
    with readers.java_charsets(i.spark):
        # Bytes of the CP949 text, written one character per byte.
        rows = i.survey().select(
            *[
                F.decode(F.encode(c, readers.CP949), "ISO-8859-1").alias(h.encode("cp949").decode("latin-1"))
                for h, c in _PARK.items()
            ]
        )
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = readers.scan_cp949(i.spark, path)
    text = [F.trim(F.coalesce(h, F.lit(""))).alias(c) if "_text" in c else F.coalesce(h, F.lit("")).alias(c) for h, c in _PARK.items()]
    return back.select(*text).groupBy(*_PARK.values()).agg(F.count(F.lit(1)).alias("n"))


_HEADER = ",".join(_PARK)


def _zip_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for chunk, text in zip(batch["chunk"], batch["text"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("readme.txt", "not a table")
                archive.writestr("data.csv", f"{_HEADER}\n{text}\n".encode("cp949"))
            content = buffer.getvalue()
            # Every seventh archive is cut short and cannot be read.
            out.append((f"park_{chunk}.zip", content[: len(content) // 2] if chunk % 7 == 3 else content))
        yield pd.DataFrame(out, columns=["path", "content"])


def _archives(i: Inputs) -> DataFrame:
    """Archives of 100 records each, built in tasks; some records have cells beyond the header."""
    more = F.when(F.col("ktsn") % 11 == 0, F.lit('y,"z"'))
    line = F.concat_ws(",", F.concat(F.lit('"'), "stnm", F.lit('"')), "krn", F.lit("2020-01-01"), "ktsn", F.lit("1.5"), F.lit("x"), more)
    chunks = (
        i.raw()
        .select(F.floor(F.col("ktsn") / 100).alias("chunk"), "ktsn", line.alias("line"))
        .groupBy("chunk")
        .agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    )
    return chunks.mapInPandas(_zip_chunks, "path string, content binary")


@query(
    "scan_zipped_csv",
    "SELECT ktsn, stnm AS sci_name, krn AS kor_name, concat('park_', CAST(CAST(floor(ktsn / 100) AS BIGINT) AS STRING), '.zip') AS file "
    "FROM v_raw WHERE CAST(floor(ktsn / 100) AS BIGINT) % 7 <> 3",
)
def scan_zipped_csv(i: Inputs) -> DataFrame:
    rows = readers.unzip_rows(_archives(i))
    return rows.select(
        F.col("경도").cast("bigint").alias("ktsn"), F.col("종명").alias("sci_name"), F.col("분류명").alias("kor_name"),
        F.col("_file").alias("file"),
    )


@query(
    "archive_status",
    """, a AS (SELECT CAST(floor(ktsn / 100) AS BIGINT) AS chunk, count(*) AS n, count(*) FILTER (WHERE ktsn % 11 = 0) AS r FROM v_raw GROUP BY 1)
    SELECT concat('park_', CAST(chunk AS STRING), '.zip') AS file, chunk % 7 <> 3 AS whole,
      CASE WHEN chunk % 7 <> 3 THEN n ELSE 0 END AS n_rows, CASE WHEN chunk % 7 <> 3 THEN r ELSE 0 END AS n_ragged FROM a""",
)
def archive_status(i: Inputs) -> DataFrame:
    return readers.read_archives(_archives(i)).status.select("file", "whole", "n_rows", "n_ragged")


_GROUP_OF_TAXON = "CASE taxonKey % 3 WHEN 0 THEN 'MM' WHEN 1 THEN 'AV' ELSE '-P' END"


@query(
    "scan_occurrence_csv",
    f"SELECT CAST(gbifID AS VARCHAR) AS gbif_id, species, scientificName AS scientific_name, coalesce(year, 0) AS year, "
    f"decimalLongitude AS lon, decimalLatitude AS lat, {_GROUP_OF_TAXON} AS file_group FROM v_occ",
)
def scan_occurrence_csv(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "occurrence")
    occ = i.occ().select(
        "gbifID", "species", "scientificName", "year", "eventDate", "decimalLongitude", "decimalLatitude",
        F.concat(F.lit("gbif_"), F.expr(_GROUP_OF_TAXON)).alias("file"),
    )
    # Files of one service have another order of columns, and lack one that is not asked for here.
    other = occ.select(*reversed(occ.columns)).drop("eventDate")
    for part, where in ((occ, "gbifID % 2 = 0"), (other, "gbifID % 2 <> 0")):
        part.where(where).write.mode("append").partitionBy("file").option("header", True).option("escape", '"').csv(path)
    back = readers.scan_occurrences(i.spark, f"{path}/*", by_folder=True)
    return back.select(
        F.col("gbifID").alias("gbif_id"), F.coalesce("species", F.lit("")).alias("species"),
        F.coalesce("scientificName", F.lit("")).alias("scientific_name"),
        F.coalesce(F.col("year").cast("int"), F.lit(0)).alias("year"), F.col("decimalLongitude").cast("double").alias("lon"),
        F.col("decimalLatitude").cast("double").alias("lat"), "file_group",
    )


@query(
    "scan_bom_csv",
    "SELECT CAST(ktsn AS VARCHAR) AS ktsn, taxon_group, scientific_name, korean_name, grade FROM v_check",
)
def scan_bom_csv(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "bom")
    writers.write_csv(i.check().select("ktsn", "taxon_group", "scientific_name", "korean_name", "grade"), path, bom=True)
    back = readers.scan_csv(i.spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("ktsn", "taxon_group", "scientific_name", "korean_name", "grade")])


@query(
    "project_occurrence_cols",
    "SELECT CAST(gbifID AS VARCHAR) AS gbif_id, species, scientificName AS scientific_name, '' AS vernacular, eventDate AS event_date, "
    "basisOfRecord AS basis, 'AV' AS taxon_group, CAST(19 AS INT) AS n_columns, true AS absent_is_null FROM v_occ",
)
def project_occurrence_cols(i: Inputs) -> DataFrame:
    shaped = observe.occurrence_columns(i.occ(), "AV")
    absent = F.col("datasetKey").isNull() & F.col("samplingProtocol").isNull() & F.col("`class`").isNull()
    return shaped.select(
        F.col("gbifID").alias("gbif_id"), "species", F.col("scientificName").alias("scientific_name"),
        F.col("vernacularName").alias("vernacular"), F.col("eventDate").alias("event_date"),
        F.col("basisOfRecord").alias("basis"), "taxon_group", F.lit(len(shaped.columns)).alias("n_columns"),
        absent.alias("absent_is_null"),
    )


@query(
    "flatten_features",
    "SELECT c_custkey AS id, c_name AS name, 'Point' AS geom_type, CAST(c_custkey AS DOUBLE) / 4 AS lon, "
    "CAST(c_nationkey AS DOUBLE) / 8 AS lat, true AS no_bbox FROM customer",
)
def flatten_features(i: Inputs) -> DataFrame:
    """Collections of 100 features each, as a paged service returns them."""
    c = i.table("customer")
    feature = F.struct(
        F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_custkey").alias("bbox")).alias("properties"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.col("c_custkey").cast("double") / 4, F.col("c_nationkey").cast("double") / 8).alias("coordinates"),
        ).alias("geometry"),
    )
    pages = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(F.collect_list(feature).alias("features"))
    flat = readers.flatten_features(pages)
    return flat.select(
        "id", "name", F.col("_geom_type").alias("geom_type"), F.get("_coords", F.lit(0)).alias("lon"),
        F.get("_coords", F.lit(1)).alias("lat"), F.lit("bbox" not in flat.columns).alias("no_bbox"),
    )


_SQUARE = ((0, 0), (4, 0), (2, 3))


@query(
    "scan_boundary_edges",
    ", c AS (SELECT c_name AS code, CAST(c_custkey AS DOUBLE) AS ox, CAST(c_nationkey AS DOUBLE) AS oy FROM customer) "
    + " UNION ALL ".join(
        f"SELECT code, ox + {a[0]} AS x1, oy + {a[1]} AS y1, ox + {b[0]} AS x2, oy + {b[1]} AS y2 FROM c"
        for a, b in zip(_SQUARE, (*_SQUARE[1:], _SQUARE[0]))
    ),
)
def scan_boundary_edges(i: Inputs) -> DataFrame:
    """One triangle per customer in GeoJSON files of 100; every ring repeats its first vertex."""
    ring = ", ".join(f"array(c_custkey + {dx}D, c_nationkey + {dy}D)" for dx, dy in (*_SQUARE, _SQUARE[0]))
    feature = F.expr(
        "named_struct('type', 'Feature', 'properties', named_struct('id', c_custkey, 'ctp_kor_nm', c_name), "
        f"'geometry', named_struct('type', 'Polygon', 'coordinates', array(array({ring}))))"
    )
    collections = (
        i.table("customer")
        .groupBy(F.floor(F.col("c_custkey") / 100).alias("file"))
        .agg(F.collect_list(feature).alias("features"))
        .select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    )
    path = scratch_path(i.spark, "boundary")
    collections.write.option("maxRecordsPerFile", 1).text(path)
    candidates = ("CTP_KOR_NM", "SIDO_NM", "CTPRVN_NM", "SIDONM")
    rings = readers.scan_boundaries(i.spark, path, candidates)
    return spatial.polygon_edges(rings).select("code", "x1", "y1", "x2", "y2")


@query("scan_raster_cells", 'SELECT var, "row", col, value FROM v_raster')
def scan_raster_cells(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "cells")
    writers.write_cells(i.raster(), path)
    return readers.scan_cells(i.spark, path).select("var", "row", "col", "value")


@query(
    "scan_rating_lookup",
    f""", k AS (
      SELECT _ord, trim(grade) AS value, 'sci' AS key_type, {duck.managed('sci_name')} AS key FROM v_rated
      UNION ALL SELECT _ord, trim(grade), 'kor', {duck.vern('kor_name')} FROM v_rated)
    SELECT key_type, key, arg_min(value, _ord) AS value FROM k WHERE key IS NOT NULL AND key <> '' GROUP BY key_type, key""",
)
def scan_rating_lookup(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "rating")
    writers.write_csv(i.rated().select("_ord", "sci_name", "kor_name", "grade"), path)
    rows = readers.scan_csv(i.spark, path).withColumn("_ord", F.col("_ord").cast("bigint"))
    return checklist.rating_lookup(rows, "grade")
