"""Every registered query against its SQL, and the join-heavy ones again with broadcasting switched off."""

import duckdb
import pytest
from check import TABLES, compare

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
LARGE_PATH = (
    "resolve_names", "discard_list", "alias_from_fold", "synonym_build", "join_ratings", "attach_region",
    "obs_count_agg", "region_nearest_within", "raster_sample", "species_env_stats", "decode_obs", "redlist_match",
    "candidate_rank", "service_flags", "merge_update_append", "set_equality_match", "points_distinct",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees(spark, duck, name):
    ok, note, _ = compare(queries()[name](spark, FOLDER), oracle_sql()[name], duck)
    assert ok, note


@pytest.mark.parametrize("name", LARGE_PATH)
def test_query_agrees_without_broadcast(no_broadcast, duck, name):
    ok, note, _ = compare(queries()[name](no_broadcast, FOLDER), oracle_sql()[name], duck)
    assert ok, note


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows
    rank = {"I": 0, "II": 1}
    grades = [rank.get(r.grade, 2) for r in rows]
    assert grades == sorted(grades)
