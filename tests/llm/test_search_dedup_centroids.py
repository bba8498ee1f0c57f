"""Ranked search, exact duplicates and centroid clustering against brute force on small odd tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import centroids, exact_dedup, queries, ranked_search, suffix_dedup

DOCS = "doc_id bigint, text string, key string, item bigint, score bigint, `a.b` string, _row int, normal_text string, term string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter") for b in ("ra", "ne", "pi", "dos", "")]


def row(doc_id, text):
    return (doc_id, text, "k", 1, 2, "dot", 3, "n", "t")


def odd_texts():
    rng = random.Random(4)
    plain = [" ".join(rng.choices(WORDS, weights=range(1, 21), k=rng.randint(1, 60))) for _ in range(400)]
    return [
        *plain, plain[7], plain[7].replace(" ", "\t\n "), " " + plain[7], plain[7].upper(), None, "", " ", "\r\n", "Ünï ünï x1", "a\x00b",
        "loKA " * 5000, " ", "ka-ra ka_ra", *["same text"] * 60,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(k, t) for k, t in enumerate(odd_texts())]
    rows += [rows[3], rows[3], row(None, odd_texts()[3]), row(None, "nowhere else"), row(None, "nowhere else"), row(None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def test_terms_equal_pattern(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 16)
    for text in odd_texts():
        got = ranked_search.count_terms((text or "").encode())
        assert {k.decode(): n for k, n in got.items()} == collections.Counter(terms(text))


def test_ranking_equals_brute_force(spark, docs):
    rng = random.Random(8)
    texts = odd_texts()
    asked = [(k, " ".join(rng.choices(WORDS, k=8))) for k in range(12)]
    asked += [(20, texts[7] + " ka ka"), (21, None), (22, ""), (23, "absent words only"), (24, "Same TEXT"), (24, "Same TEXT"), (None, "ünï"), (25, "nowhere else")]
    items = spark.createDataFrame([(k, t, "x", 9) for k, t in asked], "item_id bigint, text string, key string, rank int")
    rows = [(r.doc_id, terms(r.text)) for r in docs.collect()]
    rows = [(d, collections.Counter(t), len(t)) for d, t in rows if t]
    n_docs, length = len(rows), sum(n for _, _, n in rows)
    df = collections.Counter(t for _, c, _ in rows for t in c)
    want = collections.Counter()
    for item_id, text in asked:
        scored = []
        for d, c, n in rows:
            m = 100 - 75 + (75 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        want.update((item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(scored[:10]))
    for args in ({}, {"tree": 300, "block_chars": 120}):
        got = collections.Counter(map(tuple, ranked_search.rank(docs, items, **args).collect()))
        assert got == want, args


def test_ranking_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "ka ra")], "item_id bigint, text string")
    assert ranked_search.rank(docs.limit(0), items).count() == 0
    assert ranked_search.rank(docs.where("text IS NULL"), items).count() == 0
    assert ranked_search.rank(docs, items.limit(0)).count() == 0


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.zipf(1.4, 12) % 300) for _ in range(3000)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    tf, norm = rng.integers(1, 5, at[-1]), rng.integers(25, 400, len(sets))
    tree = ranked_search.build(np.concatenate(sets), tf, at, norm, 300)
    weight = np.zeros(300, np.int64)
    weight[rng.choice(300, 20)] = rng.integers(1, 9000, 20)
    every = np.arange(tree.nodes + len(sets))
    scores = tree.scores(every, weight)
    exact = np.array([(weight[s] * ranked_search.impact(tf[at[k] : at[k + 1]], norm[k])).sum() for k, s in enumerate(sets)])
    assert (scores[tree.nodes :] == exact[tree.doc]).all()
    reached = []
    stack = [0]
    while stack:
        node = stack.pop()
        for unit in tree.below(np.array([node])).tolist():
            assert node == 0 or scores[unit] <= scores[node]
            reached.append(unit)
            if unit < tree.nodes:
                stack.append(unit)
    assert sorted(reached) == every[1:].tolist()
    best = ranked_search.Best.none(10)
    looked = ranked_search.search(tree, weight, best, np.zeros(len(sets), bool), np.arange(len(sets)), step=8)
    assert looked < 0.8 * len(every)
    assert best.score.tolist() == sorted(exact.tolist(), reverse=True)[:10]


def test_exact_duplicates_equal_brute_force(no_broadcast, docs):
    groups = collections.defaultdict(list)
    rows = [(r.doc_id, re.sub("[\x20\x09-\x0d]+", " ", r.text or "")) for r in docs.collect()]
    for d, t in rows:
        groups[t].append(d)
    low = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = collections.Counter((d, low[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    sha = {"text_sha256": exact_dedup.whole_hash(F.col("normal_text"))}
    for head in (1, 64):  # many equal beginnings, and few
        got = exact_dedup.duplicates(docs, sha, head=head).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = collections.Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.duplicates(docs.limit(0)).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_masks_let_every_key_through(spark):
    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    for bits in (2**12, exact_dedup.MOST_BITS):
        marked = exact_dedup.Mask(keys, F.col("h"), bits).mark(rows, F.col("h"), "may").where("may")
        assert marked.where("id % 7 = 0").count() == keys.count() and marked.count() < 5000
    assert exact_dedup.Mask(keys.limit(0), F.col("h")).mark(rows, F.col("h"), "may").where("may").count() == 0


def brute_clusters(rows, dims, count, rounds):
    kept = [(k, [math.floor(64 * x) for x in v]) for k, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda k: "" if k is None else str(k)
    first = sorted((hashlib.sha256(f"1:{name(k)}".encode()).hexdigest(), v) for k, v in kept)
    centres = [v for _, v in first[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in set(at):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            centres[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    final = [(k, *nearest(v)) for k, v in kept]
    held = collections.Counter()
    for _, d, j in final:
        held[j] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((k, j, d, held[j], held.total(), shas[j]) for k, d, j in final)


@pytest.mark.parametrize("entries", [1, 20, 8192])
def test_clusters_equal_brute_force(spark, entries):
    rng = random.Random(entries)
    rows = [(k, [rng.gauss(k % 5, 0.2) for _ in range(8)]) for k in range(300)]
    rows += [(400 + k, rows[0][1]) for k in range(90)] + [rows[5], rows[5], (None, rows[9][1]), (None, rows[10][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [None] * 8), (904, [float("nan")] + [0.0] * 7), (905, [float("-inf")] * 8), (906, [-0.0] * 8), (907, [1e5] * 8)]
    table = spark.createDataFrame([(k, v, 1, "c") for k, v in rows], "vec_id bigint, embedding array<double>, cluster int, x string").repartition(4)
    found = centroids.cluster(table, dims=8, centroids=6, entries=entries)
    got = collections.Counter(map(tuple, centroids.report(found).collect()))
    assert got == brute_clusters(rows, 8, 6, 3)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(k, [float(k), 0.5]) for k in range(3)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.Counter(map(tuple, centroids.report(centroids.cluster(table, dims=2, centroids=16)).collect()))
    assert got == brute_clusters(rows, 2, 16, 3)
    empty = centroids.report(centroids.cluster(table.limit(0), dims=2))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond 2"):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id bigint, embedding array<double>"), dims=2)


def test_queries_are_registered():
    assert {"op11_fptree", "op12_refinement", "op13_subvectors"} <= queries.QUERIES.keys() & queries.SQL.keys()


def test_repeats_of_rows_with_equal_keys_and_periods(spark):
    """A passage that only two documents share goes, also where their short keys agree, where it repeats itself, or ends a text."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared, period = noise(200), noise(17) * 9
    texts = {1: noise(300) + shared + noise(80), 2: noise(90) + shared, 3: noise(40) + period, 4: period + noise(60), 5: noise(30) + period[:75], 6: noise(25) + period[3:80] + noise(9)}
    texts |= {7: noise(60), 8: shared[10:70]}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumns({"missing": F.lit(1), "a.b": F.lit(2), "row": F.lit(3)})
    first, want = {}, {}
    for did, t in texts.items():
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], did)
    for did, t in texts.items():
        gone = {j for k in range(len(t) - 49) if first[t[k : k + 50]] < did for j in range(k, k + 50)}
        want[did] = "".join(c for k, c in enumerate(t) if k not in gone)
    for same in (False, True):
        keyed = suffix_dedup._keyed(frame.select("doc_id", "text")).select("text", "did", "th", F.lit(7).cast("bigint").alias("doc") if same else "doc")
        found = {d: [] for d in texts}
        for r in suffix_dedup.covered_spans(keyed).collect():
            found[r.did] += np.frombuffer(r.spans, suffix_dedup._PIECE).tolist()
        got = {d: suffix_dedup._kept(t.encode(), suffix_dedup.removed(len(t), found[d])).decode() for d, t in texts.items()}
        assert got == want, same
    out = suffix_dedup.remove_repeats(frame)
    assert out.columns == frame.columns and {r.doc_id: r.text for r in out.collect()} == want
    assert {tuple(r) for r in out.select("missing", "`a.b`", "row").collect()} == {(1, 2, 3)}


def test_unlike_pieces_are_hardly_let_through():
    """Random texts share no string: of the pieces of one shard only chance agreement of the listed hashes lets some through."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 20_000).tolist())) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc", "text"])
    listed = pa.Table.from_batches(list(suffix_dedup._listed(50, 1)(iter([batch]))))
    many = sum(len(suffix_dedup._spread(blob, "V4 <u2 u1 u1 <u4 u1")[0]) for blob in listed.column("listed").to_pylist())
    flagged = suffix_dedup._flag(50)(listed)
    through = sum(len(p) for p in flagged.column("pieces").to_pylist()) // suffix_dedup._PIECE.itemsize
    assert many > 30_000 and through < many / 50
