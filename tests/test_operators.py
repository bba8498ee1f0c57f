"""Operators against brute force on small frames."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.operators import candidates, checklist, env, gap, joins, observe, quality, quantiles, ranking, redlist
from lacuna.operators import resolve, spatial


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# Joins and ranking.


def test_spread_join_salts_a_hot_key(no_broadcast):
    facts = no_broadcast.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k")
    )
    dim = no_broadcast.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        joined = joins.spread_join(facts, dim, ["k"], ["id"], how)
        assert "_salt" in joined._jdf.queryExecution().toString()
        assert rows(joined, "id", "k", "v") == rows(facts.join(dim, "k", how), "id", "k", "v")


def test_spread_join_keeps_null_keys(no_broadcast):
    facts = no_broadcast.range(100).select("id", F.when(F.col("id") < 60, F.lit(None)).otherwise(F.col("id")).alias("k"))
    dim = no_broadcast.range(70).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = joins.spread_join(facts, dim, ["k"], ["id"])
    assert joined.count() == 100 and joined.where("v = 'x'").count() == 10


def test_sized_never_broadcasts_beyond_the_bound(spark):
    df = spark.range(50)
    assert "broadcast" in joins.sized(df, 50)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.sized(df, 49)._jdf.queryExecution().logical().toString().lower()


def test_number_rows_equals_row_number(spark):
    random.seed(1)
    data = [(random.choice("abc"), i * 3 % 97 + 100 * i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, o long")
    w = Window.partitionBy("g").orderBy("o")
    want = df.withColumn("n", F.row_number().over(w) - 1)
    for pieces in (None, 1, 7, 64):
        assert rows(ranking.number_rows(df, ["g"], "o", "n", pieces=pieces), "g", "o", "n") == rows(want, "g", "o", "n")


def test_carry_forward_equals_last(spark):
    random.seed(2)
    data = [(random.choice("ab"), i, random.choice([None, None, None, i])) for i in range(150)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("c", F.last("v", True).over(w))
    got = ranking.carry_forward(df, ["g"], "o", F.col("v"), "c", width=8)
    assert rows(got, "g", "o", "c") == rows(want, "g", "o", "c")


def test_sparse_orders_are_numbered_in_even_tasks(spark):
    """A million orders far apart: chunks of the order column would hold one row each."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") * 1_000_003).alias("o"))
    dealt = ranking.in_ranges(df, ["g", "o"], "test", pieces=16).groupBy("_piece").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert dealt[2] == 16 and dealt[1] < 2 * dealt[0]
    assert ranking.number_rows(df, ["g"], "o", "n", pieces=16).where(F.col("n") * 1_000_003 != F.col("o")).count() == 0


@pytest.mark.parametrize("pieces", [None, 1, 3, 40])
def test_summary_equals_exact_percentile(spark, pieces):
    random.seed(3)
    data = [(k, random.choice([random.gauss(0, 5), 1.0, float(random.randint(0, 4))])) for k in "ab" for _ in range(151)]
    data += [(None, float(v)) for v in range(30)]
    data += [("one", 4.0), ("nan", float("nan")), ("mix", float("inf")), ("mix", 2.0), ("mix", None), ("mix", 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"a": 0.1, "b": 0.5, "c": 0.99}
    summary = quantiles.summarise(df, ["k"], "v", probs, pieces=pieces)
    got = {r.k: r for r in summary.collect()}
    finite = df.where("v IS NOT NULL AND NOT isnan(v) AND v < 1e300")
    want = finite.groupBy("k").agg(
        F.percentile("v", [0.1, 0.5, 0.99]).alias("p"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"),
        F.count("v").alias("n"),
    )
    expected = want.collect()
    assert {r.k for r in expected} == set(got) and "nan" not in got
    for r in expected:
        g = got[r.k]
        assert g.n == r.n and g.mean == pytest.approx(r.m) and [g.a, g.b, g.c] == pytest.approx(list(r.p))
        assert g.sd == pytest.approx(r.s or 0.0)
    assert got["one"].sd == 0.0


# Names.


def lookup_frames(spark):
    lookup = spark.createDataFrame(
        [("sci", "aa bb", 1), ("kor", "가", 1), ("kor", "나", 2), ("sci", "cc dd", 3), ("sci", "parus major", 9)],
        "key_type string, key string, ktsn long",
    )
    over = spark.createDataFrame(
        [(1, "Parus major", "sci", 5), (2, "박 새", "KOR", 6), (3, "Parus major L.", "sci", 7), (4, "Rana sp.", "sci", 8)],
        "_ord long, match_name string, match_type string, accepted_ktsn long",
    )
    return lookup, resolve.override_lookup(over)


VERDICTS = [
    ("Aa bb Auth.", "가", 1, "both"), ("Aa bb", "나", None, "conflict"), ("Aa bb", "", 1, "sci"), ("", "나", 2, "kor"),
    ("Xx yy", None, None, "none"), ("Parus major", "가", 7, "override"), ("Aa bb", "박새", 6, "override"),
    (None, None, None, "none"), ("Cc dd", "없음", 3, "sci"),
]


@pytest.mark.parametrize("threshold", ["10485760b", "-1"])
def test_verdicts(spark, threshold):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        lookup, over = lookup_frames(spark)
        obs = spark.createDataFrame([(i, s, k) for i, (s, k, _, _) in enumerate(VERDICTS)], "i int, sci_name string, kor_name string")
        got = resolve.resolve_names(obs, lookup, over).orderBy("i").collect()
        assert [(r.ktsn, r.how) for r in got] == [(k, h) for _, _, k, h in VERDICTS]
        bare = spark.createDataFrame([(1, None, "kept", None), (2, "", "kept", "")], "i int, sci_name string, note string, kor_name string")
        bare = resolve.resolve_names(bare, lookup, over)
        assert bare.columns == ["i", "sci_name", "note", "kor_name", "ktsn", "how", "ktsn_sci", "ktsn_kor"]
        assert [tuple(r)[:6] for r in bare.orderBy("i").collect()] == [(1, None, "kept", None, None, "none"), (2, "", "kept", "", None, "none")]
        alone = resolve.resolve_names(obs, lookup, over, kor=None).select("how").distinct().collect()
        assert {r.how for r in alone} <= {"override", "sci", "none"}
    finally:
        spark.conf.set(key, before)


def test_accepted_names_beat_aliases_and_first_row_wins(spark):
    master = spark.createDataFrame([(1, 10, "aa bb", "가"), (2, 20, "aa bb", "나")], "_ord long, ktsn long, match_key string, korean_name string")
    alias = spark.createDataFrame(
        [(1, "sci", "Aa bb", 99), (2, "kor", "다", 30), (3, "kor", "다", 31), (4, "sci", "Zz yy", 40)],
        "_ord long, alias_type string, alias_name string, accepted_ktsn long",
    )
    later = spark.createDataFrame([(0, "sci", "Zz yy L.", 50)], "_ord long, alias_type string, alias_name string, accepted_ktsn long")
    got = {(r.key_type, r.key): r.ktsn for r in resolve.name_lookup(master, alias, later).collect()}
    assert got == {("sci", "aa bb"): 10, ("kor", "가"): 10, ("kor", "나"): 20, ("kor", "다"): 30, ("sci", "zz yy"): 40}


def raw_frame(spark, data):
    cols = "_ord ktsn gnus specs sspecs vrty krn corsyn txgrp class_la order_la family_la specs_ktsn stnm egspcs".split()
    full = []
    for i, d in enumerate(data):
        base = dict.fromkeys(cols, "")
        base.update({"_ord": i, "ktsn": i, "corsyn": "Y", "txgrp": "MM", "specs_ktsn": None}, **d)
        full.append(tuple(base[c] for c in cols))
    kinds = {"_ord": "long", "ktsn": "long", "specs_ktsn": "long"}
    return spark.createDataFrame(full, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols))


def test_canonical_prefers_no_variety_then_lowest_id(spark):
    raw = raw_frame(
        spark,
        [
            {"ktsn": 5, "gnus": "A", "specs": "b", "vrty": "v", "krn": "변종"},
            {"ktsn": 9, "gnus": "A", "specs": "b", "krn": "나중"},
            {"ktsn": 7, "gnus": " A ", "specs": "b", "krn": "정명"},
            {"ktsn": 8, "gnus": "A", "specs": "b", "sspecs": "c"},
            {"ktsn": 3, "gnus": "A", "specs": "", "krn": "상위"},
            {"ktsn": 2, "gnus": "A", "specs": "b", "corsyn": "N"},
        ],
    )
    picked = {r.match_key: r.ktsn for r in checklist.canonical_pick(checklist.accepted_species(raw)).collect()}
    assert picked == {"a b": 7, "a b c": 8}
    alias = {(r.alias_type, r.key, r.accepted_ktsn) for r in checklist.fold_aliases(raw).collect()}
    assert alias == {("kor", "변종", 7), ("kor", "나중", 7), ("sci", "a b v", 7)}


def test_candidates_equal_brute_force(spark):
    random.seed(4)
    def word(n):
        return "".join(random.choice("가나다") for _ in range(n))

    master = [(i, i * 7 % 101, word(random.randint(1, 6)), random.choice(["Aus", "Bus"])) for i in range(101)]
    queries = [(random.choice(["Aus x", "Zus y", "가 나다", ""]), random.choice(["", word(random.randint(1, 7))])) for _ in range(60)]
    m = spark.createDataFrame([(k, o, n, g) for o, k, n, g in master], "ktsn long, _ord long, korean_name string, genus_la string")
    u = spark.createDataFrame(queries, "sci_name string, kor_name string")
    want = set()
    for sci, kor in set(queries):
        name = kor.replace(" ", "") or (sci.replace(" ", "") if any("가" <= c <= "힣" for c in sci) else "")
        found = [k for o, k, n, g in master if len(name) >= 2 and len(n) >= 2 and (name in n or n in name)][:6]
        genus = sci.split(" ")[0].lower() if sci and sci[0].isascii() else ""
        for o, k, n, g in master:
            if len(found) < 6 and genus and g.lower() == genus and k not in found:
                found.append(k)
        want |= {(sci, kor, r, k) for r, k in enumerate(found, 1)}
    got = {(r.sci_name, r.kor_name, r["rank"], r.ktsn) for r in candidates.rank_candidates(u, m, 6).collect()}
    assert got == want


# Points and regions.

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.5), (0.0, 1.0)]
OVERLAP = [(0.25, 0.0), (2.0, 0.0), (2.0, 0.25), (0.25, 0.25)]


@pytest.fixture(scope="module")
def edges(spark):
    shift = lambda ring: [[x + 127.0, y + 37.0] for x, y in ring]
    rings = spark.createDataFrame(
        [("A", 1, shift(SQUARE)), ("B", 2, shift(OVERLAP) + [[127.25, 37.0]])],
        "code string, ord long, vertices array<array<double>>",
    )
    return spatial.polygon_edges(rings)


def test_edges_are_closed_once(edges):
    assert edges.where("code = 'A'").count() == 5 and edges.where("code = 'B'").count() == 4


def test_region_edge_cases(spark, edges):
    points = {
        (0.5, 0.125): "A", (1.5, 0.125): "B", (0.125, 0.5): "A", (0.0, 0.5): None, (0.5, 0.5): None, (0.5, 0.75): None,
        (1.0, 1.0): None, (3.0, 0.125): None, (1.0, 0.125): "B", (0.25, 0.125): "A", (0.9375, 0.90625): "A",
    }
    df = spark.createDataFrame([(x + 127.0, y + 37.0) for x, y in points] + [(None, None)], "lon double, lat double")
    for size in (0.25, 0.125, 1.0):
        got = spatial.region_within(df, spatial.within_index(edges, size)).collect()
        assert {(r.lon - 127.0, r.lat - 37.0): r.region for r in got if r.lon is not None} == points
        assert [r.region for r in got if r.lon is None] == [None]
    with pytest.raises(ValueError):
        spatial.within_index(edges, 0.3)


def test_nearest_limit(spark, edges):
    # West of the western edge at latitude 37.5; one metre is about 1 / 88,456 degrees of longitude there.
    metre = 1 / 88_456.0
    df = spark.createDataFrame([(i, 127.0 - d * metre, 37.5) for i, d in enumerate((10, 1990, 2010, 50_000))], "i int, lon double, lat double")
    got = spatial.assign_region(df, spatial.build_index(edges)).orderBy("i").collect()
    assert [r.region for r in got] == ["A", "A", "00000", "00000"]
    plain = spatial.assign_region(df, spatial.build_index(edges, reach=None), unknown=spatial.UNKNOWN_PROVINCE)
    assert {r.region for r in plain.collect()} == {"미상"}


def test_region_equals_brute_force(spark, edges):
    random.seed(5)
    pts = [(127 + random.randint(-16, 160) / 64, 37 + random.randint(-16, 80) / 64) for _ in range(400)]
    rings = {"A": SQUARE, "B": OVERLAP}

    def inside(ring, x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    want = sorted((x, y, next((c for c, r in rings.items() if inside(r, x - 127, y - 37)), None)) for x, y in set(pts))
    df = spark.createDataFrame(pts, "lon double, lat double").distinct()
    got = spatial.region_within(df, spatial.within_index(edges)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_missing_coordinate_counts_once(spark):
    obs = spark.createDataFrame(
        [(1, "s", 2000, "r", None, None)] * 3 + [(1, "s", 2000, "r", 1.0, 2.0)] * 2 + [(1, "s", None, "r", 1.0, 2.0)],
        "ktsn long, source string, year int, region string, lon double, lat double",
    )
    assert rows(observe.obs_count(obs), "year", "obs_count") == [(2000, 2), (None, 1)]
    by_struct = obs.groupBy("year").agg(F.count_distinct(F.struct("lon", "lat")).alias("obs_count"))
    assert rows(by_struct, "year", "obs_count") == [(2000, 2), (None, 1)]


def test_reconcile_compares_unknown_years(spark):
    a = spark.createDataFrame([(1, None, 2), (2, 2000, 1)], "ktsn long, year int, obs_count long")
    b = spark.createDataFrame([(1, None, 2), (2, 2000, 3), (3, 1999, 1)], "ktsn long, year int, obs_count long")
    assert rows(quality.reconcile(a, b, ["ktsn", "year"]), "ktsn", "derived", "stored") == [(2, 1, 3), (3, 0, 1)]


def test_found_and_gap_partition_the_checklist(spark):
    check = spark.createDataFrame(
        [(i, "MM" if i % 2 else "AV", f"s{i}", "", "", "") for i in range(40)],
        "ktsn long, taxon_group string, scientific_name string, korean_name string, grade string, redlist string",
    )
    agg = spark.createDataFrame(
        [(i, f"r{i % 3}", 2000 + i % 2, "s", 2) for i in range(0, 60, 3)] * 2,
        "ktsn long, region string, year int, source string, obs_count long",
    )
    for group, region, year in itertools.product((None, "MM"), (None, "r0"), (None, 2001)):
        total = {r.ktsn for r in gap.filter_group(check, group).collect()}
        found = [r.ktsn for r in gap.found_species(check, agg, group, region, year).collect()]
        missing = [r.ktsn for r in gap.gap_species(check, agg, group, region, year).collect()]
        assert len(found) == len(set(found)) and not set(found) & set(missing) and set(found) | set(missing) == total
        head = gap.gap_headline(check, agg, group, region, year).first()
        assert (head.n_species, head.n_found, head.n_gap) == (len(total), len(found), len(missing))


def test_orders(spark):
    df = spark.createDataFrame(
        [(1, "나", "", "CR", 5), (2, "가", "", "", 5), (3, "다", "II", "", 9), (4, "라", "I", "", 1), (5, "가", "", "VU", 0)],
        "ktsn long, korean_name string, grade string, redlist string, n_obs long",
    )
    assert [r.ktsn for r in gap.order_gap(df).collect()] == [4, 3, 5, 1, 2]
    assert [r.ktsn for r in gap.order_found(df).collect()] == [3, 2, 1, 4, 5]


def test_equal_sets(spark):
    left = spark.createDataFrame([(l, k) for l, s in enumerate(["ab", "ba", "abc", "d"]) for k in s], "l_id int, k string")
    right = spark.createDataFrame([(r, k) for r, s in enumerate(["abc", "ab", "aab", "x"], 10) for k in s], "r_id int, k string")
    assert rows(quality.match_equal_sets(left, right), "l_id", "r_id") == [(0, 11), (1, 11), (2, 10)]


def test_bilinear_rescales_missing_neighbours(spark):
    cells = spark.createDataFrame([("v", 0, 0, 1.0), ("v", 0, 1, 3.0), ("v", 1, 0, None), ("v", 1, 1, float("nan"))], "var string, row long, col long, value double")
    t = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 0.5, 0.5), (9, 9, 9.0, 9.0)], "trow int, tcol int, x double, y double")
    got = env.resample_bilinear(t, cells, env.Affine(0.0, 0.0, 1.0))
    assert rows(got, "trow", "tcol", "value") == [(0, 0, 2.0), (0, 1, 1.0)]


# Red-list text.

LINES = [
    "머리말 앞줄", "조류 박새 Parus major Linnaeus, 1758 LC", "분류군 국명 학명", "VU 2019 EN.", "관속식",
    "물? 둥근잎꿩의비름 Hylotelephium ussuriense (Kom.) H.Ohba (i)VU", "곤충1 Aus bus ShinEN", "거미 이름만 있음 여기",
    "• 12", "포유류 수달 Lutra lutra", "어류 NT",
]


def test_red_list_records(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(LINES)], "doc string, line_no long, line string")
    fixed = redlist.repair_split_label(lines)
    assert fixed.where("line LIKE '관속식물 둥근잎%'").count() == 1 and fixed.count() == len(LINES) - 1
    records = redlist.unwrap_records(fixed)
    got = rows(redlist.parse_records(records), "group_label", "kor_name", "sci_name", "code")
    assert got == [
        ("곤충1", "", "Aus bus Shin", "EN"),
        ("관속식물", "둥근잎꿩의비름", "Hylotelephium ussuriense (Kom.) H.Ohba (i)", "VU"),
        ("조류", "박새", "Parus major Linnaeus, 1758", "EN"),
    ]
    reasons = rows(redlist.parse_failures(records), "reason")
    assert reasons == [("no_code",), ("no_sci",), ("not_data",)]


def test_merge_editions(spark):
    base = spark.createDataFrame(
        [(1, "곤충1", "Aus bus L.", "가", "VU", "2024(통합본)"), (2, "곤충1", "Aus bus Kim", "나", "VU", "2024(통합본)"), (3, "조류", "Cus dus", "다 라", "LC", "2024(통합본)")],
        "_ord long, group_label string, sci_name string, kor_name string, code string, source_year string",
    )
    new = spark.createDataFrame(
        [(1, "Aus bus", "없음", "EN"), (2, "Aus bus", "없음", "CR"), (3, "Eus fus", "다라", "NT"), (4, "Gus hus", "마", "DD"), (5, "Gus hus", "마", "DD")],
        "_ord long, sci_name string, kor_name string, code string",
    )
    got = rows(redlist.merge_editions(base, new), "group_label", "sci_name", "code", "source_year")
    assert got == sorted(
        [
            ("곤충1", "Aus bus L.", "VU", "2024(통합본)"), ("곤충1", "Aus bus Kim", "CR", "2025(곤충IV)"), ("조류", "Cus dus", "NT", "2025(곤충IV)"),
            ("곤충4", "Gus hus", "DD", "2025(곤충IV)"), ("곤충4", "Gus hus", "DD", "2025(곤충IV)"),
        ],
        key=str,
    )


def test_numbering_keeps_missing_groups_and_orders(spark):
    from lacuna.operators import ranking

    rows = [("a", 1, "x"), ("a", 70_000, None), ("a", None, "n"), (None, 5, "y"), (None, 6, None), (None, None, None)]
    df = spark.createDataFrame(rows, "g string, o long, v string")
    numbered = ranking.number_rows(df, ["g"], "o", "at")
    assert {(r.g, r.o): r["at"] for r in numbered.collect()} == {
        ("a", None): 0, ("a", 1): 1, ("a", 70_000): 2, (None, None): 0, (None, 5): 1, (None, 6): 2}
    carried = ranking.carry_forward(df, ["g"], "o", F.col("v"), "last")
    assert {(r.g, r.o): r["last"] for r in carried.collect()} == {
        ("a", None): "n", ("a", 1): "x", ("a", 70_000): "x", (None, None): None, (None, 5): "y", (None, 6): "y"}


def test_grid_takes_groups_and_years_from_the_data(spark):
    from lacuna.operators import gap

    listed = spark.createDataFrame([(1, "AA"), (2, "BB"), (3, "BB")], "ktsn long, taxon_group string")
    seen = spark.createDataFrame([(1, "R", 2031), (2, "R", 1980), (3, "Q", None)], "ktsn long, region string, year int")
    got = {(r.taxon_group, r.region, r.year): (r.n_found, r.n_gap) for r in gap.gap_grid(listed, seen, seen.select("region").distinct()).collect()}
    assert len(got) == 8 and got["AA", "R", 2031] == (1, 0) and got["BB", "R", 1980] == (1, 1) and got["BB", "Q", 1980] == (0, 2)


def test_name_parts_equal_brute_force(no_broadcast):
    """All containments, uncapped: names of one to nine letters out of few, with common bigrams and repeated names."""
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("가나다라") for _ in range(rng.randint(1, 9)))
    listed = [(k, k % 40, name()) for k in range(300)] + [(900, 1, None), (901, 2, "가 나"), (902, 2, "가나")]
    asked = [name() for _ in range(150)] + ["가나", "가나", "", "마바"]
    m = no_broadcast.createDataFrame(listed, "ktsn long, _ord long, korean_name string")
    q = no_broadcast.createDataFrame([(a,) for a in asked], "u_kor string")
    plain = [(k, o, (n or "").replace(" ", "")) for k, o, n in listed]
    want = {(u, k, o) for u in set(asked) if len(u) > 1 for k, o, n in plain if len(n) > 1 and (u in n or n in u)}
    got = candidates.by_substring(q, m).collect()
    assert len(got) == len(want) and {(r.u_kor, r.ktsn, r["_ord"]) for r in got} == want
    first = {(r.u_kor, r.ktsn) for r in candidates.by_substring(q, m, 3).collect()}
    by_name = {}
    for u, k, o in sorted(want, key=lambda r: (r[2], r[1])):
        by_name.setdefault(u, []).append(k)
    assert first == {(u, k) for u, ids in by_name.items() for k in ids[:3]}


def test_sources_beyond_the_named_ones_stay(spark):
    from lacuna.plans.regions import by_survey

    rows = spark.createDataFrame([("AF", 1), ("NO", 2), ("RF", 3), ("", 4), (None, 5), ("x", 6)], "source string, ktsn long")
    assert sorted(r.ktsn for t in by_survey(rows) for r in t.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.ktsn for r in observe.observed_ids(*by_survey(rows)).collect()) == [1, 2, 3, 4, 5, 6]


def test_warp_reproduces_a_ramp(spark):
    """A field that is linear in degrees, on a degree grid and on a metric one, read off at the web map's cell centres."""
    from lacuna.functions import geo

    ramp = lambda lon, lat: lon * 2 + lat * 3
    res = 1 / 16
    cells = [("v", r, c, ramp(127 + (c + 0.5) * res, 36 + (r + 0.5) * res)) for r in range(32) for c in range(24)]
    degrees = spark.createDataFrame(cells, "var string, row long, col long, value double")
    affine = env.Affine(127.0, 36.0, res)
    grid = env.web_grid(spark, affine, 32, 24)
    x0, x1, y0, y1 = grid.extent()
    assert grid.cols in (24, 25) and x0 == pytest.approx(127 * geo.MERCATOR_R * 3.141592653589793 / 180) and y1 >= y0 + 32 * grid.res
    at = [F.lit(x0) + (F.col("col") + 0.5) * grid.res, F.lit(y0) + (F.col("row") + 0.5) * grid.res]
    lon, lat = geo.mercator_lonlat(*at)
    inner = (lon.between(127 + res, 127 + 23 * res)) & (lat.between(36 + res, 36 + 31 * res))
    got = env.warp(degrees, affine, grid).where(inner).select((F.col("value") - ramp(lon, lat)).alias("off")).agg(F.max(F.abs("off")), F.count("*")).first()
    assert got[0] < 1e-9 and got[1] > 500
    assert env.warp(degrees, affine, grid).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()[:] == (0, grid.rows - 1, 0, 23)

    metric = env.Affine(180_000.0, 400_000.0, 2000.0)
    places = spark.range(30 * 40).select((F.col("id") % 40).alias("row"), F.expr("id DIV 40").alias("col"))
    mlon, mlat = geo.tm_lonlat(F.lit(metric.x0) + (F.col("col") + 0.5) * metric.res, F.lit(metric.y0) + (F.col("row") + 0.5) * metric.res, geo.EPSG_5186)
    field = places.select(F.lit("m").alias("var"), "row", "col", ramp(mlon, mlat).alias("value"))
    grid = env.web_grid(spark, metric, 40, 30, 3000.0, geo.EPSG_5186)
    at = [F.lit(grid.x0) + (F.col("col") + 0.5) * grid.res, F.lit(grid.y0) + (F.col("row") + 0.5) * grid.res]
    warped = env.warp(field, metric, grid, geo.EPSG_5186).where(F.col("row").between(3, grid.rows - 4) & F.col("col").between(3, grid.cols - 4))
    got = warped.select((F.col("value") - ramp(*geo.mercator_lonlat(*at))).alias("off")).agg(F.max(F.abs("off")), F.count("*")).first()
    assert got[0] < 1e-4 and got[1] > 300


def test_one_set_of_most_ids(no_broadcast):
    """Nine tenths of the ids on both sides hold one set; its members are salted, and the rows are those of brute force."""
    rng = random.Random(21)
    pick = lambda k: "abcd" if k % 10 else "".join(rng.choices("abcdef", k=rng.randint(1, 4)))
    lefts, rights = {k: pick(k) for k in range(600)}, {5000 + k: pick(k) for k in range(400)}
    left = no_broadcast.createDataFrame([(i, c) for i, t in lefts.items() for c in t], "l_id int, k string")
    right = no_broadcast.createDataFrame([(i, c) for i, t in rights.items() for c in t], "r_id int, k string")
    want = {}
    for i, t in lefts.items():
        same = [j for j, u in rights.items() if set(u) == set(t)]
        if same:
            want[i] = (min(same), len(set(t)))
    matched = quality.match_equal_sets(left, right)
    assert {r.l_id: (r.r_id, r.n_keys) for r in matched.collect()} == want
    assert "_salt" in matched._jdf.queryExecution().analyzed().toString()


def test_split_labels_across_chunks(spark):
    lines = [("d", k, t) for k, t in enumerate(LINES)] + [(None, k, t) for k, t in enumerate(LINES)] + [("d", None, "관속식"), ("e", 1, "관속식"), ("e", 3, "물 x"), ("e", 5, None)]
    df = spark.createDataFrame(lines, "doc string, line_no long, line string")
    once = sorted(map(str, redlist.repair_split_label(df).collect()))
    assert len(once) == len(lines) - 2 and sum("관속식물 둥근잎" in r for r in once) == 2
    for width in (1, 2, 3, 5):
        assert sorted(map(str, redlist.repair_split_label(df, width).collect())) == once
