"""Readers: NDJSON, CSV (UTF-8 with BOM, CP949, zipped), GeoJSON and raster cell tables."""

from __future__ import annotations

import csv
import functools
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.geo import GRIDS, TransverseMercator, tm_lonlat
from lacuna.operators.observe import OCCURRENCE_COLUMNS
from lacuna.session import staged

# Raw checklist field → column of the record model.
CHECKLIST_FIELDS = {
    "ktsn": "ktsn", "stnm": "stnm", "ktsnKrnNm": "krn", "corsynSeYn": "corsyn", "txgrpGroupCd": "txgrp",
    "classKtsnLtnNm": "class_la", "orderKtsnLtnNm": "order_la", "fmlyKtsnLtnNm": "family_la",
    "gnusKtsnLtnNm": "gnus", "specsKtsnLtnNm": "specs", "sspecsKtsnLtnNm": "sspecs",
    "vrtyKtsnLtnNm": "vrty", "specsKtsn": "specs_ktsn", "egspcsYn": "egspcs",
}
CHECKLIST_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in CHECKLIST_FIELDS] + [T.StructField("_ord", T.LongType())]
)
SURVEY_SCHEMA = T.StructType(
    [
        T.StructField(f, T.StringType())
        for f in ("spcs_scncenm", "spcs_korean_nm", "spcs_lcnm", "examin_year", "examin_begin_de", "regist_dt")
    ]
    + [
        T.StructField("_geom_type", T.StringType()),
        T.StructField("_coords", T.ArrayType(T.DoubleType())),
        T.StructField("_ord", T.LongType()),
    ]
)
PARK_COLUMNS = ("종명", "분류명", "조사일자", "경도", "위도", "생물분류")
# Fixed value: layer names are mv_<map|dat>_<programme>_<taxon>[_<more>]_<point|pyn>[_<year>].
LAYER_NAME = r"^mv_(map|dat)_([a-z]+)_(.+)_(point|pyn)(?:_([0-9]+))?$"


def scan_checklist(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Checklist NDJSON; blank and unparsable lines are skipped, ids become numbers."""
    raw = spark.read.schema(CHECKLIST_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    kept = raw.where(F.col("ktsn").isNotNull())
    named = kept.select(*[F.col(f).alias(c) for f, c in CHECKLIST_FIELDS.items()], "_ord")
    return named.withColumns(
        {"ktsn": F.col("ktsn").try_cast("bigint"), "specs_ktsn": F.col("specs_ktsn").try_cast("bigint")}
    )


def layer_fields(layer: Column) -> dict[str, Column]:
    """Programme, taxon (the first word after it), geometry kind and year of a layer name; an unknown name belongs to `etc`."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(layer, LAYER_NAME, i), F.lit(""))

    return {"prog": F.coalesce(part(2), F.lit("etc")), "taxon": F.substring_index(part(3), "_", 1), "geom": part(4), "layer_year": part(5)}


def layer_of_file(file_name: Column) -> Column:
    """Layer name of a survey file: no extension, no ecobank_ prefix."""
    return F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "^(?:[^=]*=)?(?:ecobank_)?", "")


def scan_survey(spark: SparkSession, path: str | Sequence[str], by_folder: bool = False) -> DataFrame:
    """Survey NDJSON tagged with layer and source from the file name; a bad line is an error.

    `by_folder` takes the layer from the file's folder, for layers written as many part files.
    """
    raw = spark.read.schema(SURVEY_SCHEMA).option("mode", "FAILFAST").json(path)
    name = (
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if by_folder else F.col("_metadata.file_name")
    )
    layer = layer_of_file(name)
    return raw.select("*", layer.alias("layer"), layer_fields(layer)["prog"].alias("source"))


#: Up to so many files the driver reads the first lines itself, as it lists the files; beyond, a job reads the first blocks.
HEADER_FILES = 1000


def _first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First line of each file that has one, byte for byte as ISO-8859-1."""
    if len(paths) > HEADER_FILES:
        lines = spark.read.option("encoding", "ISO-8859-1").text(paths).select(
            F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        first = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("line"))
        plain = spark._jvm.org.apache.hadoop.fs.Path
        uri = spark._jvm.java.net.URI
        return {plain(uri(r.path)).toString(): r.line for r in first.collect()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = {}
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        raw = at.getFileSystem(conf).open(at)
        codec = codecs.getCodec(at)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "ISO-8859-1"))
        line = reader.readLine()
        reader.close()
        if line is not None:
            out[path] = line
    return out


def _by_header(spark: SparkSession, path: str | Sequence[str]) -> list[list[str]]:
    """Files below a path, grouped by their first line, in the order of the first file of each group."""
    jvm = spark._jvm
    listed = spark.read.text(path).inputFiles()
    files = sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in listed)
    groups: dict[str, list[str]] = {}
    for file, line in sorted(_first_lines(spark, files).items()):
        groups.setdefault(line.removeprefix("\xef\xbb\xbf").rstrip("\r"), []).append(file)
    return list(groups.values())


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", tags: dict[str, Column] | None = None
) -> DataFrame:
    """Header CSV, all columns text. A UTF-8 byte order mark is stripped by the reader.

    Columns go by name: files with another header are a scan of their own, and a column that a file lacks is NULL in its
    rows. `tags` adds columns that may use the file's metadata.
    """
    groups = _by_header(spark, path)
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", encoding)
    tagged = [value.alias(name) for name, value in (tags or {}).items()]
    scans = [reader.csv(files).select("*", *tagged) for files in (groups if len(groups) > 1 else [path])]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


CP949 = "x-windows-949"


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Accept charsets beyond Spark's fixed list, replacing what cannot be coded, while columns are built.

    Both switches are read when an expression is analysed, so they are put back before anything runs.
    """
    switches = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {k: spark.conf.get(k, "false") for k in switches}
    try:
        for k in switches:
            spark.conf.set(k, "true")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scan_cp949(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header CSV in CP949, undecodable bytes replaced.

    The file is split and parsed byte for byte (no CP949 trail byte is a comma, quote, backslash or line
    end), then every column is decoded by built-ins, so large files stay splittable.
    """
    raw = scan_csv(spark, path, "ISO-8859-1")
    names = [c.encode("latin-1").decode("cp949", "replace") for c in raw.columns]
    with java_charsets(spark):
        return raw.toDF(*names).select(
            *[F.decode(F.encode(f"`{n}`", "ISO-8859-1"), CP949).alias(n) for n in names]
        )


#: Rows that leave a task together.
ARCHIVE_BATCH = 20_000
_STATUS = {"_row": "bigint", "_file": "string", "_status": "string", "_rows": "bigint", "_ragged": "bigint"}


def _archive_rows(path: str, content: bytes, columns: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Rows of the first .csv in one archive, by header, then a row with its status.

    A short row is filled with empty text, what a long row has beyond the header is left out; both count as ragged. Damage
    ends an archive: the rows before it stay, and the status holds the error.
    """
    file = path.rsplit("/", 1)[-1]
    rows, ragged, status, held = 0, 0, "ok", []

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(held, columns=[*columns, "_row"])
        return out.assign(_file=file, _status=None, _rows=None, _ragged=None)

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            member = next((n for n in archive.namelist() if n.endswith(".csv")), None)
            if member is None:
                status = "no .csv in the archive"
            else:
                with archive.open(member) as raw:
                    lines = csv.reader(io.TextIOWrapper(raw, encoding="cp949", errors="replace", newline=""))
                    header = next(lines, [])
                    place = [header.index(c) if c in header else len(header) for c in columns]
                    for cells in lines:
                        if not cells:
                            continue
                        ragged += len(cells) != len(header)
                        cells = [*cells[: len(header)], *[""] * (len(header) - len(cells) + 1)]
                        held.append([*[cells[k] if k < len(header) else "" for k in place], rows])
                        rows += 1
                        if len(held) >= ARCHIVE_BATCH:
                            yield frame()
                            held.clear()
    except (zipfile.BadZipFile, zlib.error, EOFError, csv.Error, OSError, RuntimeError, NotImplementedError) as e:
        status = f"{type(e).__name__}: {e}"
    if held:
        yield frame()
    last = dict.fromkeys(columns) | {"_row": None, "_file": file, "_status": status, "_rows": rows, "_ragged": ragged}
    yield pd.DataFrame([last])


def _unzip(columns: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield from _archive_rows(path, content, columns)

    return run


def unzip_all(files: DataFrame, columns: Sequence[str] = PARK_COLUMNS) -> DataFrame:
    """(path, content) archives → rows of the first .csv (CP949) in each, and one row per archive with its `_status`.

    Archives are independent and spread over tasks; rows leave a task in batches.
    """
    schema = ", ".join(f"`{c}` {kind}" for c, kind in (dict.fromkeys(columns, "string") | _STATUS).items())
    return files.select("path", "content").mapInPandas(_unzip(tuple(columns)), schema)


@dataclass(frozen=True)
class Archives:
    """Rows of archives, and of each archive whether it was read to its end, its rows and its ragged rows."""

    rows: DataFrame
    status: DataFrame


def read_archives(files: DataFrame, columns: Sequence[str] = PARK_COLUMNS) -> Archives:
    """Each archive is unpacked once; both tables come from what was written."""
    both = staged(unzip_all(files, columns), "archives")
    status = both.where("_status IS NOT NULL").selectExpr(
        "_file AS file", "_status = 'ok' AS whole", "_status AS status", "_rows AS n_rows", "_ragged AS n_ragged"
    )
    return Archives(both.where("_status IS NULL").drop("_status", "_rows", "_ragged"), status)


def unzip_rows(files: DataFrame) -> DataFrame:
    """Rows only; see `read_archives` for what could not be read."""
    return unzip_all(files).where("_status IS NULL").drop("_status", "_rows", "_ragged")


def scan_zipped_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Zipped CSVs below a path."""
    return unzip_rows(spark.read.format("binaryFile").load(path))


def scan_occurrences(spark: SparkSession, path: str | Sequence[str], by_folder: bool = False) -> DataFrame:
    """Occurrence CSVs; the group comes from the file name gbif_<group>.csv, or from the folder of part files."""
    name = (
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if by_folder else F.col("_metadata.file_name")
    )
    group = F.regexp_extract(name, r"^(?:[^=]*=)?gbif_(.+?)(?:\.csv)?$", 1)
    raw = scan_csv(spark, path, tags={"file_group": group})
    have = [c for c in OCCURRENCE_COLUMNS if c in raw.columns and c != "taxon_group"]
    return raw.select(*[F.col(f"`{c}`") for c in have], "file_group")


def flatten_features(collections: DataFrame) -> DataFrame:
    """Rows with a GeoJSON `features` array → one flat row per feature, `bbox` left out."""
    f = collections.select(F.explode("features").alias("f"))
    props = [c for c in f.select("f.properties.*").columns if c != "bbox"]
    return f.select(
        *[F.col(f"f.properties.{c}").alias(c) for c in props],
        F.col("f.geometry.type").alias("_geom_type"), F.col("f.geometry.coordinates").alias("_coords"),
    )


_POLYGON, _MULTIPOLYGON = "array<array<array<double>>>", "array<array<array<array<double>>>>"


# Geometry and properties stay text: their depth and names vary.
BOUNDARY_SCHEMA = "crs string, features array<struct<properties:string, geometry:struct<type:string, coordinates:string>>>"


def name_property(properties: str, names: Sequence[str]) -> str:
    """Which property names a region: the first that bears one of the names in any case, else the first that is text."""
    found = json.loads(properties)
    wanted = {n.upper() for n in names}
    named = next((k for k in found if k.upper() in wanted), None)
    return named or next((k for k, v in found.items() if isinstance(v, str)), next(iter(found)))


def grid_of(crs: str | None) -> TransverseMercator | None:
    """The metric grid that a collection's `crs` member names; None for degrees, an error for another grid."""
    number = re.search(r"EPSG[^0-9]+([0-9]+)\b(?!.*[0-9])", crs or "")
    if number is None or int(number[1]) == 4326:
        return None
    if int(number[1]) not in GRIDS:
        raise ValueError(f"EPSG:{number[1]} is not a known grid")
    return GRIDS[int(number[1])]


def scan_boundaries(
    spark: SparkSession, path: str, names: Sequence[str], grid: TransverseMercator | None = None
) -> DataFrame:
    """Polygons and multipolygons in GeoJSON → rings (code, ord, ring, vertices) in degrees.

    The code is the first property that bears one of the names in any case, else the first text property of the first
    feature. Metric coordinates are turned into degrees: by `grid`, else by the grid that the file's `crs` names. All rings
    of a feature count together by parity, so islands and holes need no further distinction.
    """
    files = spark.read.schema(BOUNDARY_SCHEMA).option("multiLine", True).json(path)
    f = files.select("crs", F.posexplode("features").alias("pos", "f"))
    first = f.where("f.properties IS NOT NULL").select("crs", "f.properties").head()
    if first is None:
        return spark.createDataFrame([], "code string, ord bigint, ring int, vertices array<array<double>>")
    grid = grid or grid_of(first.crs)
    code = F.from_json("f.properties", "map<string,string>")[name_property(first.properties, names)]
    text = F.col("f.geometry.coordinates")
    rings = F.when(
        F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(text, _MULTIPOLYGON))
    ).otherwise(F.from_json(text, _POLYGON))
    out = f.select(code.alias("code"), F.col("pos").cast("bigint").alias("ord"), F.posexplode(rings).alias("ring", "vertices"))
    if grid is None:
        return out
    return out.withColumn("vertices", F.transform("vertices", lambda v: F.array(*tm_lonlat(v[0], v[1], grid))))


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """Raster cells (var, row, col, value), one folder per variable."""
    return spark.read.parquet(path)
