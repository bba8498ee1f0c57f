"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the multiset of its five-word shingles; weights are counts, and similarity is the probability Jaccard, which
is the plain Jaccard where no shingle repeats. Every shingle is a Poisson process whose rate is its weight; each arrival
falls on one of the registers, which keep their earliest shingle. A process ends as soon as it is later than the latest
register of its text (all texts of a batch advance together). The share of equal registers estimates the similarity.

Texts that agree in all registers of a band meet. A first, cheap round orders a band's texts by its value and then by
further bands, pairs each text with the first of its group in the task and its predecessor (groups cut by a task's bounds
are linked at their ends), and verifies the likeliest pair of each text on the exact similarity of whole texts. It only
closes most groups early. A second round decides all the rest: in every group that still holds two classes, each two
texts of different classes are compared, in the first band in which they meet. Groups are dealt into blocks, the largest class of a crowded group into blocks of its own, and each two
blocks that may hold two classes are a unit of work, so no task holds a large group. A unit estimates its pairs from the registers, passes over
only those more than five standard deviations too low, and verifies the others on the exact similarity of whole texts.
Rows that move are texts in units, never pairs.

Equal texts are one node from the start. The class id is the smallest doc_id of a class.

Defined results: a missing text is empty; texts without any word are alike only if equal; texts with fewer than five
words are one shingle; rows with a missing doc_id have the class of their text, null where no row of the class has an
id; repeated rows share a class; an empty table gives no rows. Extra columns are ignored by `classes`, kept by
`distinct_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import rows
from lacuna.llm.arrow import slices, tidy
from lacuna.llm.components import components, resolve
from lacuna.llm.shingles import counted, mix, shingles
from lacuna.session import staged

BANDS, DEPTH = 24, 4
SIMILARITY = 0.8
#: Texts in a block of a large group; a unit holds two blocks.
BLOCK = 512
#: Shingles of so many texts of a unit are counted by a matrix product.
MANY = 8
#: Standard deviations that an estimate may lie below the similarity asked for.
DEVIATIONS = 5
SALTS = 32
NO_ID = 2**63 - 1
SLICE_BYTES = 500_000


def sketches(row: np.ndarray, value: np.ndarray, times: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash registers (texts x registers) of distinct shingles with weights; 0 where a text has none."""
    earliest = np.full(texts * registers, np.inf)
    owner = np.zeros(texts * registers, np.uint32)
    name = (value >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    active, clock, arrival = np.arange(len(row)), np.zeros(len(row)), 0
    while len(active):
        arrival = (arrival + 0x9E3779B97F4A7C15) % (1 << 64)
        draw = mix(value[active] + np.uint64(arrival))
        gap = -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52)
        clock = clock + gap / times[active]
        place = row[active] * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, place, clock)
        won = earliest[place] == clock
        owner[place[won]] = name[active[won]]
        latest = earliest.reshape(texts, registers).max(axis=1)
        on = clock < latest[row[active]]
        active, clock = active[on], clock[on]
    return owner.reshape(texts, registers)


def sketch(docs: DataFrame, bands: int = BANDS, depth: int = DEPTH) -> DataFrame:
    """(did, digest, keys, marks): a 64-bit key for each band, none where the text has no words; a byte for each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, bands * depth + 1).astype(np.uint64)).reshape(bands, depth)
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                row, value, times = counted(*shingles(part.column(2)))
                owner = sketches(row, value, times, part.num_rows, bands * depth)
                marks = pa.array([m.tobytes() for m in (owner >> np.uint32(24)).astype(np.uint8)], pa.binary())
                found = owner.reshape(-1, bands, depth).astype(np.uint64)
                keys = mix((mix(found * weights) * weights).sum(axis=2, dtype=np.uint64)).view(np.int64)
                any_word = np.bincount(row, minlength=part.num_rows) > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(any_word * bands)]).astype(np.int32)), pa.array(keys[any_word].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, marks], names=["did", "digest", "keys", "marks"])

    return docs.select("did", "digest", "text").mapInArrow(tidy(run), "did bigint, digest string, keys array<bigint>, marks binary")


def likeness_bound(similarity: float, registers: int) -> float:
    """The smallest share of equal registers that a pair of such a similarity is expected to show."""
    return similarity - DEVIATIONS * sqrt(similarity * (1 - similarity) / registers)


def band_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs a < b of texts (did, keys): every text of a group is in one, but not with every other."""
    many = F.size("keys")
    nth = F.col("band")
    entries = nodes.select("did", "keys", F.explode(F.sequence(F.lit(0), many - 1)).alias("band")).select(
        "did",
        F.xxhash64(nth, F.element_at("keys", nth + 1)).alias("key"),
        F.element_at("keys", F.pmod(nth + 7, many) + 1).alias("then"),
        F.element_at("keys", F.pmod(nth + 15, many) + 1).alias("last"),
    )
    ranged = entries.repartitionByRange("key", "then", "last", "did").sortWithinPartitions("key", "then", "last", "did")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs inside a task; rows with a = key and b = id (`cut`) are the ends of its first and last group."""

        def out(pairs: list[tuple[int, int]], cut: bool) -> pa.RecordBatch:
            a, b = zip(*pairs, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([cut] * len(a))], names=["a", "b", "cut"])

        first = key = begun = last = None
        for batch in batches:
            pairs = []
            for did, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    first, key = did, own
                    if begun is None:
                        begun = (own, did)
                else:
                    pairs += [(other, did) for other in {first, last}]
                last = did
            if pairs:
                yield out(pairs, False)
        if begun is not None:
            yield out([begun, (key, last)], True)

    found = staged(ranged.select("did", "key").mapInArrow(tidy(run), "a bigint, b bigint, cut boolean"), "pairs")
    ends = found.where("cut").groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("ids")).where("size(ids) > 1")
    linked = ends.select(F.explode(F.arrays_zip(
        F.slice("ids", 1, F.size("ids") - 1).alias("a"), F.slice("ids", 2, F.size("ids") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    pairs = found.where("NOT cut").select("a", "b").unionAll(linked)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def estimated(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, estimate): the pairs whose share of equal registers may belong to such a similarity."""
    a, b = (nodes.select(F.col("did").alias(c), F.col("marks").alias(f"marks_{c}")) for c in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "marks_a", "marks_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                share = (x == y).mean(axis=1)
                keep = pa.array(share >= likeness_bound(similarity, x.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [c.filter(keep) for c in (batch.column(0), batch.column(1), pa.array(share))], names=["a", "b", "estimate"])

    return joined.mapInArrow(run, "a bigint, b bigint, estimate double")


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets (sorted values, weights)."""
    (x, wx), (y, wy) = a, b
    union = np.union1d(x, y)
    left, right = np.zeros(len(union)), np.zeros(len(union))
    left[np.searchsorted(union, x)] = wx
    right[np.searchsorted(union, y)] = wy
    both = (left > 0) & (right > 0)
    ratio, which = np.unique(left[both] / right[both], return_inverse=True)
    sums = np.array([np.maximum(left, r * right).sum() for r in ratio])
    return float((left[both] / sums[which]).sum()) if len(ratio) else 0.0


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of `did` whose whole texts are as similar as that."""
    texts = docs.select("did", "text")
    a, b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                sides = []
                for k in (2, 3):
                    row, value, times = counted(*shingles(part.column(k)))
                    at = np.searchsorted(row, np.arange(part.num_rows + 1))
                    sides.append([(value[lo:hi], times[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)])
                alike = [probability_jaccard(x, y) >= similarity - 1e-9 for x, y in zip(*sides, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(alike)) for c in part.columns[:2]], names=["a", "b"])

    return joined.mapInArrow(tidy(run), "a bigint, b bigint")


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit as one batch. Rows of a unit (the first three columns) follow each other."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]])
        starts = np.concatenate([[0], np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            this = tuple(names[:, lo])
            if held and this != name:
                yield _joined(held)
                held = []
            name = this
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch, with long offsets so that more than 2 GB of text stay in one chunk."""
    if len(batches) == 1:
        return batches[0]
    wide = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
    table = pa.Table.from_batches(batches)
    return table.cast(pa.schema([f.with_type(wide.get(f.type, f.type)) for f in table.schema])).combine_chunks().to_batches()[0]


def likely_pairs(unit: pa.RecordBatch, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of different classes that meet first in the unit's band, and whose estimate is not too low."""
    n = unit.num_rows
    band, block, kind = (unit.column(c).to_numpy(zero_copy_only=False) for c in ("band", "block", "class"))
    keys = unit.column("keys").flatten().to_numpy().reshape(n, -1)
    meet = np.triu(kind[:, None] != kind[None, :], 1)
    nth = int(band[0])
    for k in range(nth + 1):
        meet &= (keys[:, k, None] == keys[None, :, k]) == (k == nth)
    if unit.column("lo")[0] != unit.column("hi")[0]:
        meet &= block[:, None] != block[None, :]
    i, j = np.nonzero(meet)
    if len(i):
        marks = np.frombuffer(b"".join(unit.column("marks").to_pylist()), np.uint8).reshape(n, -1)
        least = likeness_bound(similarity, marks.shape[1])
        keep = np.concatenate([(marks[i[k : k + 50_000]] == marks[j[k : k + 50_000]]).mean(axis=1) >= least for k in range(0, len(i), 50_000)])
        i, j = i[keep], j[keep]
    return i, j


def shared_shingles(row: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """(texts x texts) numbers of distinct shingles that two texts share; rows ascend."""
    _, which, held = np.unique(value, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    order = order[held[which[order]] < MANY]
    few, at = which[order], row[order]
    cells = [at[:-o][same] * texts + at[o:][same] for o in range(1, MANY) if (same := few[:-o] == few[o:]).any()]
    shared = np.bincount(np.concatenate(cells), minlength=texts * texts).reshape(texts, texts) if cells else np.zeros((texts, texts), np.int64)
    shared += shared.T
    column = np.cumsum(held >= MANY) - 1
    often = held[which] >= MANY
    at, of = row[often], column[which[often]]
    for start in range(0, int(of.max()) + 1 if len(of) else 0, 2048):
        inside = (of >= start) & (of < start + 2048)
        has = np.zeros((texts, 2048), np.float32)
        has[at[inside], of[inside] - start] = 1
        shared += (has @ has.T).astype(np.int64)
    return shared


def links(unit: pa.RecordBatch, similarity: float) -> list[tuple[int, int]]:
    """Classes of a unit that a pair of similar texts joins; pairs that others have joined already are left out."""
    i, j = likely_pairs(unit, similarity)
    if not len(i):
        return []
    n, parts, before = unit.num_rows, [], 0
    for part in slices(unit, unit.schema.get_field_index("text"), SLICE_BYTES):
        row, value, times = counted(*shingles(part.column("text")))
        parts.append((row + before, value, times))
        before += part.num_rows
    row, value, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    at = np.searchsorted(row, np.arange(n + 1))
    most = np.ones(n, np.int64)
    np.maximum.at(most, row, times.astype(np.int64))
    plain = (most[i] == 1) & (most[j] == 1)
    both, sizes = shared_shingles(row, value, n)[i, j], np.diff(at)
    alike = both / np.maximum(sizes[i] + sizes[j] - both, 1) >= similarity - 1e-9
    kinds = unit.column("class").to_pylist()
    above = {k: k for k in kinds}

    def root(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    found = []
    open_pairs = np.concatenate([np.flatnonzero(plain & alike), np.flatnonzero(~plain)])
    for x, y, exact in zip(i[open_pairs].tolist(), j[open_pairs].tolist(), plain[open_pairs].tolist(), strict=True):
        a, b = root(kinds[x]), root(kinds[y])
        if a != b and (exact or probability_jaccard(*((value[at[k] : at[k + 1]], times[at[k] : at[k + 1]]) for k in (x, y))) >= similarity - 1e-9):
            above[max(a, b)] = min(a, b)
            found.append((kinds[x], kinds[y]))
    return found


def blocks_of(entries: DataFrame, parts: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(key, blocks, own, giant): into how many blocks each group is dealt, and its largest class where it has `own` ones.

    Texts of one class need not meet, so a large class that stands in blocks of its own meets only those of the others.
    """
    crowded = parts.join(sizes.where(F.col("n") > block).select("key"), "key").select("key", "salt")
    held = entries.join(crowded, ["key", "salt"]).groupBy("key", "class").count()
    largest = held.groupBy("key").agg(
        F.max_by("class", F.struct("count", -F.col("class"))).alias("giant"), F.max("count").alias("inside"))
    counts = sizes.join(largest, "key", "left").select("key", "n", "giant", F.coalesce("inside", F.lit(0)).alias("inside"))
    counts = counts.withColumns({
        "all": F.ceil(F.col("n") / block), "own": F.ceil(F.col("inside") / block), "rest": F.ceil((F.col("n") - F.col("inside")) / block)})
    moved = F.col("inside") * F.col("rest") + (F.col("n") - F.col("inside")) * (F.col("rest") + F.col("own"))
    apart = (F.col("inside") > 0) & (moved < F.col("n") * F.col("all"))
    return counts.select(
        "key", F.when(apart, F.col("rest")).otherwise(F.col("all")).alias("blocks"),
        F.when(apart, F.col("own")).otherwise(0).alias("own"), F.when(apart, F.col("giant")).alias("giant"))


def class_links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the classes of all similar texts (did, class, keys, marks) that meet in a band."""
    entries = nodes.select("did", "class", F.posexplode("keys").alias("band", "value")).select(
        "did", "class", "band", F.xxhash64("band", "value").alias("key"), F.pmod(F.xxhash64("did"), F.lit(SALTS)).alias("salt"))
    entries = staged(entries, "entries")
    # Sizes of groups with two classes, found in parts and spread back to the same parts.
    parts = staged(entries.groupBy("key", "salt").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")), "parts")
    sizes = parts.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    spread = staged(parts.select("key", "salt").join(blocks_of(entries, parts, sizes, block), "key"), "groups")
    inside, hashed = F.col("class").eqNullSafe(F.col("giant")), F.xxhash64("key", "did")
    dealt = entries.join(spread, ["key", "salt"]).withColumn(
        "block", F.when(inside, F.col("blocks") + F.pmod(hashed, F.greatest("own", F.lit(1)))).otherwise(F.pmod(hashed, "blocks")))
    partners = F.col("blocks") + F.when(inside, 0).otherwise(F.col("own")) - 1
    members_of = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), partners))).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "did", "class", "band", "block")

    columns = members_of.columns

    def by_unit(rows_of: DataFrame) -> DataFrame:
        return rows_of.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "did")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a likely partner in a unit need not be fetched for it."""
        for unit in units(batches):
            keep = np.unique(np.concatenate(likely_pairs(unit, similarity)))
            if len(keep):
                yield unit.select(columns).take(pa.array(keep))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            found = links(unit, similarity)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    registers = nodes.select("did", "keys", "marks")
    sifted = staged(by_unit(members_of.join(registers, "did").select(*columns, "keys", "marks")).mapInArrow(tidy(sift), members_of.schema), "units")
    whole = sifted.join(registers.join(docs.select("did", "text"), "did"), "did")
    return by_unit(whole.select(*columns, "keys", "marks", "text")).mapInArrow(tidy(verify), "a bigint, b bigint")


def digest(text: Column) -> Column:
    return F.concat(F.md5(text), F.lit("-"), F.octet_length(text).cast("string"))


def members(docs: DataFrame, bands: int = BANDS, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(did, digest, class): `did` is the id or NO_ID, `class` the smallest `did` of its class."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), rows.text_of().alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    salted = staged(
        sketch(texts, bands, depth).withColumn("salt", F.pmod(F.xxhash64("did"), F.lit(SALTS))), "sketches")
    # The smallest id of equal texts, found in parts and spread back to the same parts.
    parts = staged(salted.groupBy("digest", "salt").agg(F.min("did").alias("low")), "parts")
    reps = parts.join(parts.groupBy("digest").agg(F.min("low").alias("rep")), "digest").select("digest", "salt", "rep")
    owned = staged(salted.join(reps, ["digest", "salt"]), "members")
    nodes = staged(owned.where("did = rep AND size(keys) > 0").select("did", "keys", "marks").dropDuplicates(["did"]), "nodes")
    pairs = staged(band_pairs(nodes), "candidates")
    # A text in no pair is alone in all its groups.
    met = staged(pairs.select(F.col("a").alias("did")).unionAll(pairs.select("b")).distinct(), "met")
    alone = staged(texts.join(met, "did", "left_semi").dropDuplicates(["did"]).select("did", "text"), "texts")
    likely = estimated(pairs, nodes, similarity)
    chosen = staged(likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")), "chosen")
    roots = components(verified(chosen, alone, similarity))
    again = staged(resolve(nodes.join(met, "did", "left_semi"), "did", roots, "class"), "again")
    higher = components(class_links(again, alone, similarity))
    final = resolve(resolve(owned.select("did", "digest", "rep"), "rep", roots, "root"), "root", higher, "class")
    return final.select("did", "digest", "class")


def classes(docs: DataFrame, bands: int = BANDS, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every document."""
    return members(docs, bands, depth, similarity).select(
        F.nullif("did", F.lit(NO_ID)).alias("doc_id"), F.nullif("class", F.lit(NO_ID)).alias("class_id"))


def distinct_documents(docs: DataFrame, bands: int = BANDS, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id; repeated rows are kept once.

    Rows without an id go if their class has one; else only equal ones among them go.
    """
    found = members(docs, bands, depth, similarity)
    others = found.where("did <> class").select("did", "digest").distinct()
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), digest(rows.text_of()).alias("digest"), F.struct("*").alias("row"))
    return keyed.join(others, ["did", "digest"], "left_anti").dropDuplicates(["did", "digest"]).select("row.*")
