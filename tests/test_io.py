"""Readers, writers, streams and plan shapes."""

import json
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from lacuna.operators import gap, observe, publish, spatial
from lacuna.plans.scans import scan_survey_json
from lacuna.plans.standin import Inputs
from lacuna.session import run_folder, scratch_path, shared_dir, tune
from lacuna.sources import readers, writers
from lacuna.streaming import ingest

HEADER = "종명,분류명,조사일자,경도,위도,생물분류\n"
FOLDER = "/root/testdata/sf0.001"


def test_cp949_replaces_bad_bytes(spark, tmp_path):
    (tmp_path / "park.csv").write_bytes((HEADER + '"Parus, major",박새,2024-01-01,127.5,37.5,조류\n').encode("cp949") + b"Aus bus,\xff\xff,,,,\n")
    got = readers.scan_cp949(spark, str(tmp_path / "park.csv")).collect()
    assert got[0]["종명"] == "Parus, major" and got[0]["분류명"] == "박새" and got[0]["생물분류"] == "조류"
    assert "�" in got[1]["분류명"] and got[1]["종명"] == "Aus bus"
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    rows = observe.park_rows(readers.scan_cp949(spark, str(tmp_path / "park.csv")).withColumn("_ord", F.lit(1)))
    assert [(r.year, r.lon, r.source) for r in rows.collect()] == [("2024", 127.5, "nps"), ("", None, "nps")]


def test_zip_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("note.txt", "x")
        z.writestr("b.csv", (HEADER + "A b,가,2020-01-01,1,2,x\nC d,나,,,,\n").encode("cp949"))
    (tmp_path / "bad.zip").write_bytes(b"PK not a zip")
    got = readers.scan_zipped_csv(spark, str(tmp_path / "*.zip")).orderBy("_row").collect()
    assert [(r["종명"], r["분류명"], r["_file"]) for r in got] == [("A b", "가", "a.zip"), ("C d", "나", "a.zip")]


def test_bom_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, "")], "id int, t string").coalesce(1)
    writers.write_csv(df, str(tmp_path / "out"), bom=True)
    part = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbf")
    assert [(r.id, r.t or "") for r in readers.scan_csv(spark, str(tmp_path / "out")).collect()] == [("1", 'say "hi", ok'), ("2", "")]


def test_export_is_quoted_and_named(spark, tmp_path):
    df = spark.createDataFrame([("박새", 'Parus "x"', "I", "CR", 3)], "korean_name string, scientific_name string, grade string, redlist string, n_obs long").coalesce(1)
    writers.export_checklist(df, str(tmp_path / "e"), found=True)
    text = next((tmp_path / "e").glob("part-*.csv")).read_text()
    assert text.splitlines() == ['"국명","학명","멸종위기등급","적색목록","발견횟수"', '"박새","Parus ""x""","I급","CR","3"']
    assert writers.export_name("포유류", False, None, 2020) == "포유류_미발견_전국_2020"


def test_survey_bad_line_is_an_error(spark, tmp_path):
    (tmp_path / "ecobank_mv_dat_ntee_bird_point_2020.ndjson").write_text('{"spcs_scncenm": "A b", "_coords": [1.0, 2.0], "_ord": 1}\n')
    df = readers.scan_survey(spark, str(tmp_path))
    assert [(r.source, r.layer) for r in df.collect()] == [("ntee", "mv_dat_ntee_bird_point_2020")]
    (tmp_path / "ecobank_x.ndjson").write_text('{"spcs_scncenm": \n')
    try:
        readers.scan_survey(spark, str(tmp_path)).collect()
    except Exception as e:
        assert "MALFORMED" in str(e).upper() or "FAILFAST" in str(e).upper()
    else:
        raise AssertionError("a bad line must fail")


def test_rerun_of_ingest_adds_only_new_files(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = spark.createDataFrame([(1, 2000)], "ktsn long, year int").schema
    for batch in ([(1, 2000), (2, None)], [(1, 2005), (3, 1999)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.arrivals(spark, landing, schema, "*.parquet")
        ingest.run_to_table(stream, out, mark)
        ingest.run_state_to_table(ingest.species_state_stream(ingest.arrivals(spark, landing, schema, "*.parquet")), out + "-state", mark + "-state")
    assert spark.read.parquet(out).count() == 4
    state = {r.ktsn: r.last_year for r in ingest.current_state(spark, out + "-state").collect()}
    assert state == {1: 2005, 2: 0, 3: 1999}


def test_encode_round_trip(spark):
    df = spark.createDataFrame(
        [("MM", 5, "11", 2000, 1, 1), ("MM", 5, "12", None, 2, 2), ("MM", 4, "11", 2001, 3, 3), ("AV", 9, "12", 2000, 1, 4)],
        "taxon_group string, ktsn long, region string, year int, obs_count long, _ord long",
    )
    coded = publish.encode_observations(df)
    assert {(r.taxon_group, r.ktsn): r.idx for r in coded.species.collect()} == {("MM", 5): 0, ("MM", 4): 1, ("AV", 9): 0}
    back = publish.decode_observations(coded)
    cols = ["taxon_group", "ktsn", "region", "year", "obs_count"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, df.select(cols).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(gap.gap_species(Inputs(spark, FOLDER).check(), Inputs(spark, FOLDER).obs(), year=1999))
    assert "l_extendedprice" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_points_are_not_shuffled_to_find_their_region(spark):
    i = Inputs(spark, FOLDER)
    index = spatial.build_index(spatial.polygon_edges(i.rings()))
    placed = spatial.assign_region(i.obs().drop("region"), index)
    assert "hashpartitioning" not in plan(placed)


def test_point_store_prunes_groups(spark, tmp_path):
    i = Inputs(spark, FOLDER)
    path = str(tmp_path / "points")
    writers.write_points(observe.with_group(observe.distinct_points(i.obs()), i.check()), path)
    one = spark.read.parquet(path).where("taxon_group = 'AV'")
    assert "PartitionFilters: [isnotnull(taxon_group" in plan(one) and one.count() > 0


def test_boundaries_with_islands_and_holes(spark, tmp_path):
    def square(x, y, side):
        return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]

    def feature(name, kind, coordinates):
        return {"type": "Feature", "properties": {"SIDO_NM": name}, "geometry": {"type": kind, "coordinates": coordinates}}

    data = {
        "type": "FeatureCollection",
        "features": [
            feature("가", "MultiPolygon", [[square(127.0, 37.0, 1.0), square(127.25, 37.25, 0.5)], [square(129.0, 37.0, 0.5)]]),
            feature("나", "Polygon", [square(127.375, 37.375, 0.25)]),
        ],
    }
    (tmp_path / "b.json").write_text(json.dumps(data, indent=1))
    rings = readers.scan_boundaries(spark, str(tmp_path / "b.json"), ("CTP_KOR_NM", "SIDO_NM"))
    index = spatial.within_index(spatial.polygon_edges(rings))
    points = {(127.125, 37.125): "가", (127.3, 37.3): None, (127.5, 37.5): "나", (129.25, 37.25): "가", (128.5, 37.25): None}
    got = spatial.region_within(spark.createDataFrame(list(points), "lon double, lat double"), index).collect()
    assert {(r.lon, r.lat): r.region for r in got} == points


def test_scratch_lies_in_the_shared_folder(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(shared_dir(spark)) and path != scratch_path(spark, "x")
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named is None or shared_dir(spark) == named.rstrip("/")


def test_stream_keeps_late_ids_once(spark, tmp_path):
    """An id far behind the latest time is new, and a copy is one however late it comes."""
    folder, path, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id bigint, ts timestamp"
    batches = (
        [(1, "2020-01-01")], [(2, "2021-01-01")], [(3, "2022-01-01")], [(4, "2020-01-02"), (1, "2022-01-02"), (2, "2021-01-01")],
    )
    for rows in batches:
        new = spark.createDataFrame(rows, "id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        new.coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.arrivals(spark, folder, new.schema, "*.parquet")
        ingest.run_to_table(ingest.dedup_stream(stream, "id"), path, mark)
    assert sorted(r.id for r in spark.read.schema(schema).parquet(path).collect()) == [1, 2, 3, 4]


def test_marks_are_kept_for_each_layer(spark, tmp_path):
    """Three layers in two landings and a run that broke off, against marks kept by hand; late rows and equal dates stay out."""
    path = str(tmp_path / "landing")
    first = [(1, "a", "2024-01-01"), (2, "a", "2024-01-03"), (3, "b", "2024-02-01"), (4, None, "2024-01-05"), (5, "b", None)]
    grown = [*first, (6, "a", "2024-01-02"), (7, "a", "2024-01-03"), (8, "a", "2024-01-04"), (9, "c", "2020-01-01"), (10, "b", "2024-03-01"), (11, None, "2024-01-06"), (12, None, "2024-01-04")]

    def table(rows):
        raw = spark.createDataFrame(rows, "id bigint, layer string, registered string")
        return raw.withColumn("registered", F.col("registered").cast("timestamp_ntz"))

    def run_by_hand(rows, mark):
        taken = [r for r in rows if r[2] and (r[1] not in mark or r[2] > mark[r[1]])]
        for _, layer, day in taken:
            mark[layer] = max(day, mark.get(layer, day))
        return [r[0] for r in taken]

    mark, want = {}, []
    for rows in (first, grown, grown):
        want += run_by_hand(rows, mark)
    ingest.land(table(first), "layer", "registered", path)
    # Rows of a run whose marks were never written do not count, and the next run writes over them.
    table(grown).write.parquet(f"{path}/rows/run=1")
    assert ingest.landed(spark, path, table(first).schema).count() == 4
    assert [ingest.land(table(grown), "layer", "registered", path) for _ in range(2)] == [1, 2]
    assert sorted(r.id for r in ingest.landed(spark, path, table(first).schema).collect()) == sorted(want)
    kinds = table(first).schema
    got = {r.layer: str(r.mark)[:10] for r in ingest.marks(spark, path, kinds["layer"].dataType, kinds["registered"].dataType).collect()}
    assert got == mark
    # The same by streams of files: each landing is a batch.
    folder, out, check = (str(tmp_path / n) for n in ("files", "streamed", "mark"))
    for rows in (first, grown):
        table(rows).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):
            ingest.land_stream(ingest.arrivals(spark, folder, kinds, "*.parquet"), "layer", "registered", out, check)
    assert sorted(r.id for r in ingest.landed(spark, out, kinds).collect()) == sorted(want)


def test_keys_seen_lie_on_disk(spark, tmp_path):
    """Ten landings: ids are kept in an embedded store, whose files the checkpoint holds; memory does not follow the ids."""
    folder, path, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = spark.createDataFrame([(1, "x")], "id bigint, v string").schema
    memory = []
    for k in range(10):
        spark.range(k * 15_000, k * 15_000 + 20_000).selectExpr("id", "'x' AS v").coalesce(1).write.mode("append").parquet(folder)
        with ingest.durable_state(spark):
            query = (
                ingest.dedup_stream(ingest.arrivals(spark, folder, schema, "*.parquet"), "id")
                .writeStream.format("parquet").option("path", path).option("checkpointLocation", mark)
                .outputMode("append").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
        assert "rocksdbBytesCopied" in state["customMetrics"]
        memory.append(state["memoryUsedBytes"])
    assert spark.read.parquet(path).count() == spark.read.parquet(path).distinct().count() == 155_000
    assert state["numRowsTotal"] == 155_000
    assert memory[-1] < 2 * max(memory[0], 1_000_000) + 16_000_000
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_arriving_rows_get_species_and_region(spark, tmp_path):
    """The stream gives what the batch form gives."""
    from lacuna.plans.checklists import lookups

    i = Inputs(spark, FOLDER)
    lookup, overrides = lookups(i)
    index = spatial.build_index(spatial.polygon_edges(i.rings()))
    rows = i.survey().select("_ord", "sci_name", "kor_name").limit(500)
    rows = rows.withColumns({"lon": F.expr("CASE WHEN _ord % 7 > 0 THEN 126 + _ord % 50 / 10D END"), "lat": F.expr("CASE WHEN _ord % 7 > 0 THEN 35 + _ord % 30 / 10D END")})
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows.write.parquet(folder)
    stream = ingest.arrivals(spark, folder, rows.schema, "*.parquet")
    ingest.run_to_table(ingest.resolve_stream(stream, lookup, overrides, "sci_name", "kor_name", index), out, mark)
    batch = ingest.resolve_stream(spark.read.parquet(folder), lookup, overrides, "sci_name", "kor_name", index)
    got = spark.read.parquet(out).select(batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and got.count() == 500
    assert got.where("region <> '미상'").count() > 0 and got.where("lon IS NULL AND region <> '미상'").count() == 0


def test_archives_tell_what_they_are(spark, tmp_path):
    """Sound, ragged, damaged, truncated, empty and tableless archives: rows before the fault stay, each has one status."""
    rows = "".join(f"N{k} x,가{k},2020-01-01,{k},2,x\n" for k in range(60_000))
    bodies = {
        "sound": HEADER + "A b,가,2020-01-01,1,2,x\n\nC d,나,,,,\n",
        "ragged": HEADER + "A b\nC d,나,2020-01-01,1,2,x,more,cells\nE f,다,2020-01-01,3,4,y\n",
        "swapped": "분류명,종명,other\n라,G h,1\n",
        "nothing": "", "damaged": HEADER + rows,
    }
    for name, body in bodies.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("t.csv", body.encode("cp949"))
    whole = (tmp_path / "damaged.zip").read_bytes()
    (tmp_path / "truncated.zip").write_bytes(whole[: len(whole) // 2])
    middle = len(whole) // 2
    (tmp_path / "damaged.zip").write_bytes(whole[:middle] + b"\xff" * 64 + whole[middle + 64 :])
    with zipfile.ZipFile(tmp_path / "tableless.zip", "w") as z:
        z.writestr("a.txt", "x")
    got = readers.read_archives(spark.read.format("binaryFile").load(str(tmp_path / "*.zip")))
    status = {r.file.removesuffix(".zip"): r for r in got.status.collect()}
    assert len(status) == 7
    assert {k: (r.whole, r.n_rows, r.n_ragged) for k, r in status.items() if k != "damaged"} == {
        "sound": (True, 2, 0), "ragged": (True, 3, 2), "swapped": (True, 1, 0), "nothing": (True, 0, 0),
        "truncated": (False, 0, 0), "tableless": (False, 0, 0)}
    broken = status["damaged"]
    assert not broken.whole and 25_000 < broken.n_rows < 60_000 and "CRC" in broken.status and "zip" in status["truncated"].status
    back = got.rows.where("_file = 'damaged.zip'")
    assert back.count() == broken.n_rows and back.where("_row < 25000 AND `종명` = concat('N', _row, ' x')").count() == 25_000
    cells = {(r["_file"], r["_row"]): (r["종명"], r["분류명"], r["생물분류"]) for r in got.rows.where("_file <> 'damaged.zip'").collect()}
    assert cells["ragged.zip", 0] == ("A b", "", "") and cells["ragged.zip", 1] == ("C d", "나", "x")
    assert cells["swapped.zip", 0] == ("G h", "라", "") and cells["sound.zip", 1] == ("C d", "나", "")


def test_columns_go_by_name_in_every_file(spark, tmp_path, monkeypatch):
    """Two orders, one column missing, a byte order mark, an empty file; read by the driver's listing and by a job."""
    folder = tmp_path / "csv dir"
    folder.mkdir()
    (folder / "gbif_AV.csv").write_text("gbifID,species,year\n1,A b,2000\n2,\"C, d\",\n")
    (folder / "gbif_MM.csv").write_text("\ufeffyear,gbifID,species\r\n2001,3,E f\r\n")
    (folder / "gbif_VP.csv").write_text("species,gbifID\nG h,4\n")
    (folder / "gbif_PL.csv").write_text("")
    want = {("1", "A b", "2000", "AV"), ("2", "C, d", None, "AV"), ("3", "E f", "2001", "MM"), ("4", "G h", None, "VP")}
    for most in (1000, 0):
        monkeypatch.setattr(readers, "HEADER_FILES", most)
        got = readers.scan_occurrences(spark, str(folder))
        assert {(r.gbifID, r.species, r.year, r.file_group) for r in got.collect()} == want
    park = tmp_path / "park"
    park.mkdir()
    (park / "a.csv").write_bytes((HEADER + "A b,가,2020-01-01,127.5,37.5,조류\n").encode("cp949"))
    (park / "b.csv").write_bytes("위도,경도,종명\n36.5,126.5,C d\n".encode("cp949"))
    rows = {(r["종명"], r["경도"], r["위도"], r["분류명"]) for r in readers.scan_cp949(spark, str(park)).collect()}
    assert rows == {("A b", "127.5", "37.5", "가"), ("C d", "126.5", "36.5", None)}


def test_layer_taxon_is_the_first_word(spark):
    from lacuna.sources.readers import layer_fields

    names = ["mv_map_bgts_bird_more_words_point_2022", "mv_dat_wtl_fish_point", "mv_map_bgts_bird_pyn_1", "mv_map_Bgts_bird_point", "other"]
    df = spark.createDataFrame([(n,) for n in names], "layer string").select(*[c.alias(k) for k, c in layer_fields(F.col("layer")).items()])
    assert [tuple(r) for r in df.collect()] == [
        ("bgts", "bird", "point", "2022"), ("wtl", "fish", "point", None), ("bgts", "bird", "pyn", "1"), ("etc", None, None, None), ("etc", None, None, None)]


def test_metric_boundaries_and_round_trips(spark, tmp_path):
    from lacuna.functions import geo

    df = spark.createDataFrame([(124 + 0.37 * k, 33 + 0.29 * k) for k in range(21)], "lon double, lat double")
    for grid in geo.GRIDS.values():
        x, y = geo.tm_xy(F.col("lon"), F.col("lat"), grid)
        lon, lat = geo.tm_lonlat(F.col("x"), F.col("y"), grid)
        back = df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("lon2"), lat.alias("lat2"), "x", "y")
        x2, y2 = geo.tm_xy(F.col("lon2"), F.col("lat2"), grid)
        off = back.select(F.max(F.hypot(x2 - F.col("x"), y2 - F.col("y")))).first()[0]
        assert off < 1e-3
    lon, lat = geo.mercator_lonlat(*geo.mercator_xy(F.col("lon"), F.col("lat")))
    assert df.select(F.max(F.abs(lon - F.col("lon")) + F.abs(lat - F.col("lat")))).first()[0] < 1e-9
    for number, grid in geo.GRIDS.items():
        corners = spark.createDataFrame([(0, 127.0, 37.0), (1, 128.0, 37.0), (2, 128.0, 38.0), (3, 127.0, 38.0)], "k int, lon double, lat double")
        ring = [[r.x, r.y] for r in corners.select("k", *[c.alias(n) for n, c in zip("xy", geo.tm_xy(F.col("lon"), F.col("lat"), grid), strict=True)]).orderBy("k").collect()]
        data = {
            "type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": f"urn:ogc:def:crs:EPSG::{number}"}},
            "features": [{"type": "Feature", "properties": {"BASE": 3, "label": "가", "x": "y"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}],
        }
        path = str(tmp_path / f"{number}.json")
        (tmp_path / f"{number}.json").write_text(json.dumps(data))
        rings = readers.scan_boundaries(spark, path, ("SIDO_NM",))
        index = spatial.within_index(spatial.polygon_edges(rings))
        points = spark.createDataFrame([(127.00001, 37.5), (127.9999, 37.9), (126.9999, 37.5)], "lon double, lat double")
        assert [r.region for r in spatial.region_within(points, index).orderBy("lon").collect()] == [None, "가", "가"]
    assert readers.name_property('{"a": 1, "Sido_Nm": "x", "b": "t"}', ("SIDO_NM",)) == "Sido_Nm"
    assert readers.name_property('{"a": 1, "b": "t"}', ("SIDO_NM",)) == "b"


def test_tasks_have_a_bounded_share(spark):
    """The session has four shuffle partitions; 30 MB and more are dealt to more tasks."""
    tune(spark)
    points = spark.range(1_500_000).select(
        F.md5(F.col("id").cast("string")).alias("ktsn"), F.lit("s").alias("source"), F.lit(2000).alias("year"), F.lit("r").alias("region"),
        F.col("id").cast("double").alias("lon"), F.col("id").cast("double").alias("lat"),
    )
    assert observe.distinct_points(points).rdd.getNumPartitions() > 4
    assert len({p for (p,) in observe.obs_count(points.where("id < 1000")).select(F.spark_partition_id()).collect()}) <= 4


def test_survey_lines_are_written_compressed(spark, tmp_path):
    rows = [(k, k % 50, k % 7, 1 + k // 3 % 5, 5.0, "ANR"[k % 3], "OF"[k % 2]) for k in range(1, 200)]
    lines = spark.createDataFrame(
        rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    ).withColumn("l_shipdate", F.expr("timestamp_ntz'1995-03-04 00:00:00'"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    before = set(Path(run_folder(spark)).glob("survey-*"))
    got = scan_survey_json(Inputs(spark, str(tmp_path))).collect()
    (folder,) = set(Path(run_folder(spark)).glob("survey-*")) - before
    files = list(folder.glob("*/part-*"))
    assert files and all(f.suffix == ".gz" for f in files)
    assert sorted(r._ord for r in got) == sorted(k * 8 + 1 + k // 3 % 5 for k in range(1, 200))
    assert {r.source for r in got} == {"bgts", "ecpe", "ntee", "wtl", "etc"}
