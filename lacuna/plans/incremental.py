"""Incremental ingest: streams over the events and observations, checked against their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import spatial
from lacuna.plans import duck
from lacuna.plans.checklists import lookups
from lacuna.plans.registry import query
from lacuna.plans.standin import OBS, SURVEY, Inputs, exprs, select_list
from lacuna.session import scratch_path
from lacuna.streaming import ingest


def stream_of(i: Inputs, table: str) -> DataFrame:
    """Stream of one table's file."""
    return ingest.arrivals(i.spark, i.folder, i.table(table).schema, f"{table}.parquet")


#: What the first landing holds: one layer not at all, the others to different days, and not all of their rows.
_FIRST = "event_type <> 'signup' AND user_id % 4 <> 0 AND ts < TIMESTAMP_NTZ '2024-01-05 00:00:00' + make_dt_interval(length(event_type) * 2)"
_FIRST_SQL = "event_type <> 'signup' AND user_id % 4 <> 0 AND ts < TIMESTAMP '2024-01-05 00:00:00' + to_days(CAST(length(event_type) * 2 AS INTEGER))"


@query(
    "ingest_incremental",
    f""", one AS (SELECT * FROM events WHERE {_FIRST_SQL}), mark AS (SELECT event_type, max(ts) AS mark FROM one GROUP BY event_type)
    SELECT event_id, user_id, event_type, value, 0 AS run FROM one
    UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.value, 1 FROM events e LEFT JOIN mark m ON m.event_type = e.event_type
      WHERE e.ts IS NOT NULL AND (m.mark IS NULL OR e.ts > m.mark)""",
)
def ingest_incremental(i: Inputs) -> DataFrame:
    """A layer per kind of event. The landing is read when it holds some, when it holds all, and once more without news."""
    path = scratch_path(i.spark, "ingest")
    events = i.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for rows in (events.where(_FIRST), events, events):
        ingest.land(rows, "event_type", "ts", path)
    by_run = ingest.landed(i.spark, path, events.schema).withColumn("run", F.regexp_extract(F.input_file_name(), "run=([0-9]+)", 1).cast("int"))
    return by_run.select("event_id", "user_id", "event_type", "value", "run")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(i: Inputs) -> DataFrame:
    """Every event arrives three times; the first arrival is kept."""
    path, checkpoint = scratch_path(i.spark, "dedup"), scratch_path(i.spark, "dedup-mark")
    again = stream_of(i, "events").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    once = ingest.dedup_stream(again, "event_id")
    ingest.run_to_table(once.select("event_id", "user_id", "event_type"), path, checkpoint)
    return i.spark.read.parquet(path)


@query("stream_species_state", "SELECT ktsn, max(coalesce(year, 0)) AS last_year FROM v_obs GROUP BY ktsn")
def stream_species_state(i: Inputs) -> DataFrame:
    path, checkpoint = scratch_path(i.spark, "state"), scratch_path(i.spark, "state-mark")
    obs = stream_of(i, "lineitem").selectExpr(*exprs(OBS))
    ingest.run_state_to_table(ingest.species_state_stream(obs), path, checkpoint)
    return ingest.current_state(i.spark, path)


#: Survey records with their position.
_PLACED_SURVEY = SURVEY | {k: OBS[k] for k in ("lon", "lat")}


@query(
    "stream_resolve",
    duck.LOOKUP
    + duck.judged(f"(SELECT {select_list(_PLACED_SURVEY)} FROM lineitem)", "sci_name", "kor_name", "_ord, source, sci_name, kor_name, lon, lat")
    + duck.COORDS + duck.WITHIN + duck.NEAREST
    + """, placed AS (SELECT lon, lat, code FROM inside UNION ALL SELECT lon, lat, code FROM near)
    SELECT j._ord, j.source, j.sci_name, j.kor_name, j.ktsn, j.how, coalesce(p.code, '미상') AS region
    FROM judged j LEFT JOIN placed p ON p.lon = j.lon AND p.lat = j.lat""",
)
def stream_resolve(i: Inputs) -> DataFrame:
    """Survey records get species and region as they arrive."""
    path, checkpoint = scratch_path(i.spark, "resolve"), scratch_path(i.spark, "resolve-mark")
    lookup, overrides = lookups(i)
    survey = stream_of(i, "lineitem").selectExpr(*exprs(_PLACED_SURVEY))
    index = spatial.build_index(spatial.polygon_edges(i.rings()))
    judged = ingest.resolve_stream(survey, lookup, overrides, "sci_name", "kor_name", index)
    ingest.run_to_table(judged.select("_ord", "source", "sci_name", "kor_name", "ktsn", "how", "region"), path, checkpoint)
    return i.spark.read.parquet(path)
