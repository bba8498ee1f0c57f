"""Corpus operators against brute force on small tables with missing, empty, long and repeated texts and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import (
    components, decontaminate, fingerprint, html_text, language, near_duplicates, packing, queries, sharding, suffix_dedup,
    toxicity, url_filter,
)
from lacuna.llm.suffix_arrays import common_prefixes, packed, suffix_array

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, host string, did string, key string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "von", "sul") for b in ("ra", "ne", "pi", "dos", "gu", "wen", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 80)) for _ in range(25)]
    passage = sentence(rng, 40)
    near = base[0].split()
    near[10] = "changed"
    return [
        *base, base[3], base[3], " ".join(near), base[4] + " " + passage, passage + " " + base[5], sentence(rng, 4000), None, "", "a",
        "Grüße, Ñandú! " * 12, "kara " * 60, passage[:70],
    ]


def row(doc_id, text):
    return (doc_id, text, "xx" if doc_id and doc_id % 2 else "yy", "s", len(text or ""), 7, "h", "d", "k")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(k, t) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[2], row(None, texts()[1]), row(None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 1), (40, 2), (1500, 2), (1500, 4)):
        data = rng.integers(97, 97 + letters, size).astype(np.uint8)
        words, raw = packed(data), data.tobytes()
        order = suffix_array(words)
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(size))
        some = order[order % 3 > 0]
        for got, (i, j) in zip(common_prefixes(words, some, 50)[1:], zip(some, some[1:], strict=False), strict=True):
            a, b = raw[i : i + 50], raw[j : j + 50]
            assert got == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_repeats_equal_brute_force(docs, empty):
    key = lambda d: 2**63 - 1 if d is None else d
    rows = [(key(r.doc_id), (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for did, b in sorted(rows, key=lambda r: r[0]):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], did)
    want = collections.Counter()
    for did, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < did:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[(did, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = collections.Counter((key(r.doc_id), *r[1:]) for r in suffix_dedup.spans(docs).collect())
    assert got == want
    assert suffix_dedup.spans(empty).count() == 0
    out = suffix_dedup.remove_repeats(docs)
    assert out.schema == docs.schema and out.count() == docs.count()


def test_texts_are_exchanged_once(docs):
    for made in (suffix_dedup.remove_repeats(docs), suffix_dedup.spans(docs)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        moved = [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning\(doc#", line)]
        assert sum("ReusedExchange" not in line for line in moved) == 2  # the texts and the flagged pieces
        assert sum("ReusedExchange" in line for line in moved) == 2


def test_near_duplicates_equal_brute_force(docs, empty):
    rows = [(2**63 - 1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()]

    def grams(t):
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    def alike(a, b):
        if a == b:
            return True
        x, y = grams(a), grams(b)
        return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys()) >= 0.8

    low = {i: rows[i][0] for i in range(len(rows))}
    moved = True
    while moved:
        moved = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows[:i]):
                if low[i] != low[j] and alike(a, b):
                    low[i] = low[j] = min(low[i], low[j])
                    moved = True
    none = lambda v: None if v == 2**63 - 1 else v
    want = collections.Counter((none(rows[i][0]), none(low[i])) for i in low)
    assert collections.Counter(map(tuple, near_duplicates.classes(docs).collect())) == want
    kept = near_duplicates.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(low.values()))
    assert near_duplicates.classes(empty).count() == 0


def test_hot_group_of_near_copies_equals_brute_force(spark):
    """Chains of copies in one large group: links exist beside the first, the last and the nearest in any order."""
    rng = random.Random(11)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 10**6)) for _ in range(120)]
    rows = []
    for k in range(300):
        words = list(rows[rng.randrange(len(rows))][:120] if rows and rng.random() < 0.3 else base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(120)] = str(rng.randint(0, 10**9))
        rows.append(words[:120] + ["x"] * 12 * (k % 10 == 0))
    grams = [collections.Counter(zip(*(w[k:] for k in range(5)), strict=False)) for w in rows]

    def alike(x, y):
        return (x & y).total() / (x | y).total() >= 0.8  # a shingle that two texts share has the same count in both

    low = list(range(len(rows)))
    links = [(i, j) for j in range(len(rows)) for i in range(j) if alike(grams[i], grams[j])]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                moved = True
    hot = spark.createDataFrame([row(k, " ".join(w)) for k, w in enumerate(rows)], SCHEMA).repartition(5)
    got = dict(map(tuple, near_duplicates.classes(hot).collect()))
    assert len(links) > 3000 and 50 < len(set(low)) < 200
    assert got == dict(enumerate(low))
    # Several blocks to a group give the same links.
    nodes = near_duplicates.sketch(hot.select(F.col("doc_id").alias("did"), "text", F.lit("").alias("digest"))).withColumn("class", F.col("did"))
    some = near_duplicates.class_links(nodes, hot.select(F.col("doc_id").alias("did"), "text"), block=40)
    roots = dict(map(tuple, components.components(some).collect()))
    assert {k: roots.get(k, k) for k in range(len(rows))} == dict(enumerate(low))
    # A large class that is known already stands in blocks of its own.
    known = {k: k if k % 3 == 0 else min(j for j in range(len(rows)) if j % 3 and low[j] == low[k]) for k in range(len(rows))}
    classed = nodes.drop("class").join(spark.createDataFrame(list(known.items()), "did bigint, class bigint"), "did")
    more = near_duplicates.class_links(classed, hot.select(F.col("doc_id").alias("did"), "text"), block=40)
    roots = dict(map(tuple, components.components(more).collect()))
    assert {k: roots.get(known[k], known[k]) for k in range(len(rows))} == dict(enumerate(low))


def test_a_large_class_is_dealt_apart(spark):
    """A class of 1,000 texts and five others: every text moves once or a few times, every pair of two classes meets."""
    entries = spark.range(1005).select(
        F.col("id").alias("did"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("class"), F.lit(7).alias("key"), (F.col("id") % 4).alias("salt"))
    parts = entries.groupBy("key", "salt").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("n"))
    (plan,) = near_duplicates.blocks_of(entries, parts, sizes, 100).collect()
    assert (plan.blocks, plan.own, plan.giant) == (1, 10, 0)
    (plan,) = near_duplicates.blocks_of(entries, parts, sizes, 2000).collect()
    assert (plan.blocks, plan.own, plan.giant) == (1, 0, None)


def test_kept_documents_keep_columns_of_any_name(docs):
    named = docs.withColumnsRenamed({"did": "digest", "key": "row", "host": "a.b", "shard": "missing"})
    kept = near_duplicates.distinct_documents(named)
    assert kept.schema == named.schema
    assert collections.Counter(kept.collect()) == collections.Counter(near_duplicates.distinct_documents(docs).collect())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    low = list(range(61))
    for _ in range(61):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {k: v for k, v in enumerate(low) if k != v}


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = sentence(rng, 30)
    broken = item[:40] + "x" + item[41:90] + item[92:]
    more = spark.createDataFrame([row(100, "start " + item.upper() + " end"), row(101, "a b " + broken + " c"), row(102, item[: len(item) // 2])], SCHEMA)
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string")
    got = {r.doc_id: r.distance for r in decontaminate.matches(docs.unionAll(more), items).collect()}
    assert got == {100: 0, 101: 3}
    clean = decontaminate.clean(docs.unionAll(more), items)
    assert clean.columns == docs.columns and clean.count() == docs.count() + 1
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == docs.count()
    for _ in range(200):
        p, t = ("".join(rng.choice("ab") for _ in range(n)) for n in (rng.randint(1, 9), rng.randint(0, 14)))
        line = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(line[j] + (c != d), line[j + 1] + 1, new[j] + 1))
            line = new
        assert decontaminate.substring_distance(p, t)[0] == min(line)


def test_matches_equal_brute_force(spark):
    """Every item against every text by the whole table of edit distances; short ones by a search between word bounds."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    items = [letters(rng.randint(1, 70)) for _ in range(60)] + ["ab", "ab", "c", "a", "  ", "", None, "É é", "(a)"]
    texts = []
    for _ in range(60):
        text = letters(rng.randint(0, 120))
        for item in rng.sample([i for i in items if i], 3):
            broken = list(item)
            for _ in range(rng.randint(0, 4)):
                broken[rng.randrange(len(broken))] = rng.choice(["", "a", "b", "cc"])
            text += rng.choice(["", " "]) + "".join(broken) + rng.choice(["", " ", letters(9)])
        texts.append(text)
    texts += ["", None, "AB", "x(a)b", "É É é", "b" * 5000 + " ab"]

    def least(p, t):
        line = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(line[j] + (c != d), line[j + 1] + 1, new[j] + 1))
            line = new
        return line

    want = {}
    for i, item in enumerate(items):
        item = " ".join((item or "").lower().split())
        for k, text in enumerate(texts):
            text = " ".join((text or "").lower().split())
            if 0 < len(item) < 24:
                head = r"(?<!\w)" if item[0].isalnum() else ""
                tail = r"(?!\w)" if item[-1].isalnum() else ""
                if re.search(head + re.escape(item) + tail, text):
                    want[k, i] = 0
            elif item and (best := min(least(item, text))) <= len(item) // 16:
                want[k, i] = best
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    found = decontaminate.matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in found} == want and len(found) == len(want)
    assert sum(len(items[i]) < 24 for _, i in want) > 50 and sum(d > 0 for d in want.values()) > 10
    for r in found:
        passage = decontaminate.prepared(texts[r.doc_id])[r.match_start : r.match_end]
        assert least(decontaminate.prepared(items[r.item_id]), passage)[-1] <= r.distance


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    rows = [r.asDict() for r in packing.pack(docs, path, size=256).collect()]
    whole = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            piece = np.array(ids[k : k + 256], "<u4")
            want[(r.doc_id, k // 256, k, len(piece), zlib.crc32(piece.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(held) <= 1.05 * sum(r["length"] for r in rows) / 256 + 1
    assert packing.pack(empty, path).count() == 0


def test_words_equal_whole_texts():
    ids = packing.WordIds.at(queries.vocabulary())
    odd = ["It's don't. a'b '' x.y,z a1b É.é b–c ..'s", "İ ΣΑΣ. a\x1cb c", "", " \n", "<|endoftext|> Ab", "12 3.5!! ###"]
    for group in (odd, odd[:4]):
        flat, at = ids.of(pa.array(group))
        for text, lo, hi in zip(group, at, at[1:], strict=False):
            assert flat[lo:hi].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_fingerprints(docs, empty):
    got = fingerprint.fingerprints(docs, band=(0.5, 9.0)).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    texts_of = collections.defaultdict(set)
    for i, t in rows:
        texts_of[i].add(t)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts_of[r.doc_id]) == 1:
            by_text[next(iter(texts_of[r.doc_id]))].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    single = {i: t for i, t in rows if i is not None}
    order = sorted(single, reverse=True)
    sha = {r.doc_id: r.edited_sha256 for r in got}
    for i, after in zip(order, order[1:], strict=False):
        if i != 2 and after != 2:  # row 2 is repeated
            n = len(single[i])
            assert sha[i] == hashlib.sha256((single[i][: n - n // 2] + single[after][: n // 2]).encode()).hexdigest()
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprints_equal_brute_force(spark):
    """Lexicon, fields and likenesses recomputed from the texts; the parts that hold a term are taken as drawn."""
    rng = random.Random(8)
    texts = [sentence(rng, rng.randint(0, 25)) for _ in range(40)]
    texts += [texts[3], texts[3] + " Kara", "?!", None, "zzz yyy", "zzz yyy", "Ñandú lora"]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    band, subsets = (0.8, 3.0), 6
    lexicon = {tuple(r) for r in fingerprint.lexicon(docs, band, subsets, 5).collect()}
    terms = lambda t: {w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w}
    held = collections.Counter(w for t in texts for w in terms(t))
    name = {w: np.uint64(xxhash.xxh64_intdigest(w, seed=42)).astype(np.int64).item() for w in held}
    inside = {w for w, n in held.items() if np.exp(-band[1]) <= n / len(texts) <= np.exp(-band[0])}
    assert {t for t, _ in lexicon} == {name[w] for w in inside} and 10 < len(inside) < len(held)
    assert all(0 <= j < subsets for _, j in lexicon) and len(lexicon) > len(inside)

    def fields(t):
        own = [frozenset(w for w in terms(t) & inside if (name[w], j) in lexicon) for j in range(subsets)]
        return own if any(own) else [t or "", *own[1:]]

    def alike(a, b):
        pairs = [x == y for x, y in zip(fields(a), fields(b), strict=True) if x or y or isinstance(x, str) or isinstance(y, str)]
        return sum(pairs) / len(pairs)

    got = {r.doc_id: r for r in fingerprint.fingerprints(docs, band, subsets, 5).collect()}
    seen = [collections.defaultdict(set) for _ in range(subsets)]
    for k, t in enumerate(texts):
        after = texts[k - 1] or ""
        half = len(t or "") // 2
        edited = (t or "")[: len(t or "") - half] + after[:half]
        for text, made in ((t, got[k].fingerprint), (edited, got[k].edited_fingerprint)):
            for j, (content, field) in enumerate(zip(fields(text), made.split("-"), strict=True)):
                seen[j][content].add(field)
                assert bool(field) == (bool(content) or isinstance(content, str))
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[k].near_edited - alike(t, edited)) < 1e-9
        assert abs(got[k].near_next - alike(t, texts[k - 1])) < 1e-9
    for of in seen:
        assert all(len(f) == 1 for f in of.values()) and len({min(f) for f in of.values()}) == len(of)


def test_sharding(docs, empty):
    got = sharding.shard(docs, shards=5).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 50, 2600])
def test_permutation(spark, total):
    got = spark.range(total).select(sharding.permuted("id", total).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(total))


def test_urls_on_both_sides(spark):
    urls = [None, "no", "http://A.Example.org/en/12?x", "https://example.org?q", "ftp://x.com/fr/a", "http://com/de/", "http://xexample.org/es/", ""]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(2, urls[2], "h"), (None, urls[4], "h")], "page_id bigint, url string, host string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    small, large = (collections.Counter(map(tuple, url_filter.judge(pages, rules, broadcast_rules=n).collect())) for n in (100, 0))
    assert small == large
    assert small[(2, "a.example.org", "/en/12", "example.org/en/1", "block")] == 2
    assert small[(4, "x.com", "/fr/a", "com/fr/", "allow")] == 1 and small[(3, "example.org", "", None, "allow")] == 1
    assert small[(6, "xexample.org", "/es/", "org/", "allow")] == 1 and small[(0, "", "", None, "allow")] == 1
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_html():
    page = (
        "<html><body class='has-sidebar'><header>Site</header><main><article><header><h1>T &amp; U</h1></header><p>One <b>bo</b>ld<br>two"
        "<p class=ad>buy<p>three<script>x='</p>'</script><section class='comments'><article class='comment'><p>hi</p></article></section></article>"
    )
    assert html_text.blocks(page) == (True, ["T & U", "One bold two", "three"])
    assert html_text.blocks("<p>a&nbsp; b</p><div id='comments'>no</div><p>c</p><!-- x <p>z</p>") == (False, ["a b", "c"])
    assert html_text.blocks("") == (False, [])
    menu = "menu home about contact us now today here"
    assert html_text.unique_runs([[menu, "alpha beta"], [menu, "delta"], [menu, "delta"], []]) == [["alpha beta"], ["delta"], ["delta"], []]


def test_html_table(spark):
    menu = "<p>menu home about contact us now today here</p>"
    rows = [(1, "http://a.b/1", menu + "<p>own text</p>"), (2, "http://a.b/2", menu + "<p>other</p>"), (3, None, None), (4, "http://a.b/3", "<article>x</article>")]
    pages = spark.createDataFrame([(*r, "t") for r in [*rows, rows[3]]], "page_id bigint, url string, html string, text string")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == {(1, "own text", 8): 1, (2, "other", 5): 1, (3, "", 0): 1, (4, "x", 1): 2}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_repeats_do_not_depend_on_shards(spark):
    rng = random.Random(11)
    bodies = [sentence(rng, rng.randint(9, 30)) for _ in range(60)]
    for k in range(0, 40, 2):  # a passage of its own on two pages, across blocks on one of them
        passage = sentence(rng, 10).split()
        bodies[k] += " " + " ".join(passage)
        bodies[59 - k] = " ".join(passage[:4]) + "</p><p>" + " ".join(passage[4:]) + " " + bodies[59 - k]
    rows = [(k, f"http://{'a.b' if k < 55 else 'c.d'}/{k}", f"<p>{b}</p>") for k, b in enumerate(bodies)]
    rows += [(100 + k, f"http://a.b/copy/{k}", rows[7][2]) for k in range(30)] + [(200, None, None), (201, "http://a.b/", "")]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id bigint, url string, html string")

    def brute(least):
        hosts = collections.defaultdict(lambda: collections.defaultdict(set))
        split = {r[0]: [b.split() for b in html_text.blocks(r[2] or "")[1]] for r in rows}
        host = {r[0]: (r[1] or "://").split("/")[2] for r in rows}
        for k, parts in split.items():
            tokens = sum(parts, [])
            for at in range(len(tokens) - least + 1):
                hosts[host[k]][tuple(tokens[at : at + least])].add(str(parts))
        out = {}
        for k, parts in split.items():
            tokens = sum(parts, [])
            gone = {i for at in range(len(tokens) - least + 1) if len(hosts[host[k]][tuple(tokens[at : at + least])]) > 1 for i in range(at, at + least)}
            kept, at = [], 0
            for p in parts:
                kept.append(" ".join(w for i, w in enumerate(p, at) if i not in gone))
                at += len(p)
            out[k] = "\n\n".join(b for b in kept if b)
        return out

    want = brute(6)
    assert any(want[k] != bodies[k].replace("</p><p>", "\n\n") for k in range(40))
    for shard_pages in (400, 3):
        got = html_text.extract(pages, 6, shard_pages).collect()
        assert len(got) == len(rows) + 1 and {r.page_id: r.text for r in got} == want


def test_toxicity_and_language(spark, docs, empty):
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(300):
        bad = k % 4 == 0
        rows.append(row(k, sentence(rng, 40) + (" awful dolt " + sentence(rng, 5) if bad else "")))
        marks.append((k, 1, int(bad)))
    table = spark.createDataFrame([*rows, row(None, None), row(999, "")], SCHEMA)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5000, 0, None)], "doc_id bigint, quality int, toxic int")
    held = queries.crc_rest("doc_id", 3) == 1
    model = toxicity.fit(table, labels, ~held)
    got = {r.doc_id: r for r in toxicity.score(table, model, held).collect()}
    right = [got[k].predicted == t for k, _, t in marks if got[k].held_out]
    assert sum(right) / len(right) > 0.95 and got[None].predicted == 0 and got[999].score < 0.5
    assert toxicity.reject(table, model).columns == table.columns
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), held), held).collect()} == {0.0}
    assert toxicity.score(empty, model, held).count() == 0

    spoken = {"xx": ["der", "und", "nicht", "schule", "weg"], "yy": ["le", "oui", "jamais", "route", "avec"]}
    rows = [(k, " ".join(rng.choice(spoken[lang]) for _ in range(20)), lang) for k, lang in enumerate(["xx", "yy"] * 60)]
    told = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 ..", None)], "doc_id bigint, text string, lang string")
    out = queries.crc_rest("doc_id", 4) == 2
    counts = language.learn(told.where(~out))
    got = {r.doc_id: r for r in language.predict(told, counts, out).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows) and got[900].lang_pred == got[901].lang_pred == "und"
    assert {r.lang_pred for r in language.predict(told, [], out).collect()} == {"und"}
    assert language.predict(told.limit(0), counts, out).count() == 0
    # Frozen costs of all bytes after one context make a code: their chances sum to one at most.
    trees = language.Trees(counts)
    for context in ("de", "x"):
        last = np.array([int.from_bytes(f"{context}".encode() + bytes([b]), "big") for b in range(256)], np.uint32)
        assert (2.0 ** -trees.bits(last, np.full(256, len(context))).astype(float)).sum(axis=0).max() <= 1.001


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
