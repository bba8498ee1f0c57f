"""Writers of processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_HEADERS = {"korean_name": "국명", "scientific_name": "학명", "grade": "멸종위기등급", "redlist": "적색목록"}


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """UTF-8 CSV with header, one file per task. A byte order mark is written where a spreadsheet needs it."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "﻿" + first)
    df.write.option("header", True).option("escape", '"').csv(path)


def write_points(points: DataFrame, path: str) -> None:
    """Point store: one folder per group, files holding narrow id ranges so that readers skip most of them.

    Ranges run over (group, id, position), so even one species with a third of the points has many writers.
    """
    (
        points.repartitionByRange("taxon_group", "ktsn", "lon", "lat")
        .sortWithinPartitions("taxon_group", "ktsn", "lon", "lat")
        .write.partitionBy("taxon_group")
        .parquet(path)
    )


def file_token(group):
    """Group code safe in a file name: '-P' → '_P'."""
    return F.regexp_replace(group, "[^A-Za-z0-9]", "_")


def write_by_group(served: DataFrame, path: str) -> None:
    """One folder per group, so that a reader loads only the group it shows.

    Ranged over (group, id), which keeps the number of files near the number of tasks.
    """
    named = served.withColumn("group_file", file_token(F.col("taxon_group")))
    named.repartitionByRange("group_file", "ktsn", "region").write.partitionBy("group_file").parquet(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Raster cells, one folder per variable, files holding row ranges."""
    cells.repartitionByRange("var", "row", "col").sortWithinPartitions("var", "row", "col").write.partitionBy("var").parquet(path)


def export_columns(species: DataFrame, found: bool) -> DataFrame:
    """Found / missing list with Korean headers; the grade carries its unit."""
    shown = [
        F.col("korean_name"), F.col("scientific_name"),
        F.when(F.col("grade") != "", F.concat("grade", F.lit("급"))).otherwise("").alias("grade"), F.col("redlist"),
    ]
    out = species.select(*shown, *([F.col("n_obs").alias("발견횟수")] if found else []))
    return out.withColumnsRenamed(EXPORT_HEADERS)


def export_name(group: str, found: bool, region: str | None, year: int | None) -> str:
    kind = "발견" if found else "미발견"
    return f"{group}_{kind}_{region or '전국'}_{year or '전기간'}"


def export_checklist(species: DataFrame, path: str, found: bool) -> None:
    """Every field quoted, quotes doubled, header in Korean. Order the frame first if it matters."""
    export_columns(species, found).write.option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).csv(path)
