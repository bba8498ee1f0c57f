"""Ranked lexical search: branch and bound over FP-trees of documents.

A block of items fixes a vocabulary. One pass over the documents keeps of each its length and its vector of counts, restricted
to that vocabulary; document frequencies are counted over these vectors. Then every task sorts the vectors of a part of its
documents, the commonest term first, so that documents share the paths of a trie, and walks it depth first for each item: the
largest counts and the smallest length norm below a node bound all scores below it, and a node that cannot reach the tenth
best score so far is left out. Tasks return ten documents an item; a window picks the ten best of these.

A score is a sum over terms that grows with the count and falls with the length norm, so the bounds are true and the result is
exact. A node is kept only if it holds at most half of the documents of the kept node above it, so that paths have at most
log2 of the documents in a tree and the maxima of all nodes stay a small multiple of the vectors.

Defined results: a missing text has no terms, nor has an empty one; such documents and items give no row. Documents without
an id come after all others at equal scores. Repeated documents count and are ranked each; each row of the items gets its own
ranking, also where ids or texts repeat. Fewer than `top` documents with a score above 0 give fewer rows. Empty tables give an
empty result. Other columns, whatever their names, are not read. Texts are read in pieces, so a long one needs no more memory
than its own bytes and its different terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.arrow import slices, tidy, utf8
from lacuna.operators.joins import spread_join
from lacuna.session import staged

TOP = 10
#: Characters of items that one pass over the documents looks for; the vocabulary in the driver and the tasks is bounded by it.
BLOCK_CHARS = 8_000_000
#: Counts in one tree.
TREE = 1_000_000
#: A node of fewer documents than this is not kept: its documents are looked at one by one.
LEAST = 4
#: Nodes that are opened together.
STEP = 256
#: Bytes of text that are split into terms at once.
PIECE = 1 << 20

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def count_terms(text: bytes) -> Counter:
    """Terms of a UTF-8 text with their counts, A-Z as a-z."""
    found: Counter = Counter()
    lo = 0
    while lo < len(text):
        gap = _GAP.search(text, lo + PIECE) if lo + PIECE < len(text) else None
        hi = gap.start() if gap else len(text)
        found.update(_TERM.findall(text[lo:hi].lower()))
        lo = hi
    return found


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts of the vocabulary's terms, for documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, 1, 8 << 20):
                raw, at = utf8(batch.column(1))
                kept, sizes, ends, terms, counts = [], [], [0], [], []
                for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                    found = count_terms(raw[lo:hi].tobytes())
                    if found:
                        both = [(known[t], n) for t, n in found.items() if t in known]
                        terms += [t for t, _ in both]
                        counts += [n for _, n in both]
                        kept.append(k)
                        sizes.append(found.total())
                        ends.append(len(terms))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(kept, pa.int64())),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32())),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )

    read = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start .. start + length of all spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def impact(counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term adds to a score before its weight."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * norm)


@dataclass
class Tree:
    """Units are kept nodes, then documents; each has its terms with (largest) counts, its (smallest) norm and its children."""

    terms: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    norm: np.ndarray
    nodes: int
    children: np.ndarray
    child_at: np.ndarray
    doc: np.ndarray

    def scores(self, units: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents, bounds of nodes."""
        lengths = self.at[units + 1] - self.at[units]
        places = spans(self.at[units], lengths)
        weighed = weight[self.terms[places]]
        hit = np.flatnonzero(weighed)
        owner = np.repeat(np.arange(len(units)), lengths)[hit]
        places = places[hit]
        adds = weighed[hit] * impact(self.counts[places], self.norm[units[owner]])
        out = np.zeros(len(units), np.int64)
        if len(hit):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] = np.add.reduceat(adds, first)
        return out

    def below(self, nodes: np.ndarray) -> np.ndarray:
        starts = self.child_at[nodes]
        return self.children[spans(starts, self.child_at[nodes + 1] - starts)]


def shared_prefixes(terms: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many leading terms each vector shares with the one before it; the first shares none."""
    lengths = np.diff(at)
    most = np.minimum(lengths[1:], lengths[:-1])
    same = terms[spans(at[1:-1], most)] == terms[spans(at[:-2], most)]
    out = np.zeros(len(lengths), np.int64)
    starts = np.cumsum(most) - most
    first_off = np.flatnonzero(~same)
    nearest = np.searchsorted(first_off, starts)
    where = np.append(first_off, len(same))[nearest]
    out[1:] = np.minimum(where - starts, most)
    return out


def kept_nodes(prefixes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(level, first document, end) of the trie's nodes that hold at most half of the kept node above, outer ones first.

    Nodes are runs of documents that share more leading terms than their neighbours do; level 0 is the root.
    """
    n = len(prefixes)
    found, stack = [], [(0, 0)]
    for i in range(1, n + 1):
        shared, lo = (int(prefixes[i]) if i < n else -1), i - 1
        while stack and stack[-1][0] > shared:
            _, lo = stack.pop()
            found.append((lo, i))
        if i < n and (not stack or stack[-1][0] < shared):
            stack.append((shared, lo))
    found.sort(key=lambda r: (r[0], -r[1]))
    out, above = [(0, 0, n)], [(0, n)]
    for lo, hi in found:
        while above[-1][1] <= lo:
            above.pop()
        size = hi - lo
        if size >= least and 2 * size <= above[-1][1] - above[-1][0]:
            out.append((len(above), lo, hi))
            above.append((lo, hi))
    return out


def build(terms: np.ndarray, counts: np.ndarray, at: np.ndarray, norm: np.ndarray, width: int, least: int = LEAST) -> Tree:
    """The tree of vectors with at least one term each; terms are numbered from the commonest on, `width` of them."""
    n = len(norm)
    owner = np.repeat(np.arange(n), np.diff(at))
    inner = np.argsort(owner * width + terms)
    terms, counts = terms[inner], counts[inner]
    raw = terms.astype(">u4").tobytes()
    keys = [raw[4 * lo : 4 * hi] for lo, hi in zip(at.tolist(), at[1:].tolist(), strict=False)]
    order = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
    lengths = np.diff(at)[order]
    places = spans(at[order], lengths)
    terms, counts, norm = terms[places], counts[places], norm[order]
    at = np.concatenate([[0], np.cumsum(lengths)])
    nodes = sorted(kept_nodes(shared_prefixes(terms, at), least), key=lambda r: r[:2])

    parents, held, all_terms, all_counts, sizes, norms = [], np.zeros(n, np.int64), [], [], [], []
    k = 0
    for level in range(nodes[-1][0] + 1):
        here = [r for r in nodes[k:] if r[0] == level] if level < nodes[-1][0] else nodes[k:]
        los, his = np.array([r[1] for r in here]), np.array([r[2] for r in here])
        parents.append(held[los])
        docs = spans(los, his - los)
        number = np.repeat(np.arange(len(here)), his - los)
        if level:
            size = at[docs + 1] - at[docs]
            places = spans(at[docs], size)
            key = np.repeat(number, size) * width + terms[places]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            all_counts.append(np.maximum.reduceat(counts[places][by], first))
            all_terms.append(key[first] % width)
            sizes.append(np.bincount(key[first] // width, minlength=len(here)))
            norms.append(np.minimum.reduceat(norm[docs], np.concatenate([[0], np.cumsum(his - los)[:-1]])))
        else:  # the root is always opened
            sizes.append(np.zeros(1, np.int64))
            norms.append(norm[:1])
        held[docs] = k + number
        k += len(here)
    parent = np.concatenate([*parents, held])
    parent[0] = -1
    children = np.argsort(parent, kind="stable")[1:]
    child_at = np.concatenate([[0], np.cumsum(np.bincount(parent[1:], minlength=k))])
    return Tree(
        np.concatenate([*all_terms, terms]), np.concatenate([*all_counts, counts]),
        np.concatenate([[0], np.cumsum(np.concatenate([*sizes, lengths]))]), np.concatenate([*norms, norm]), k, children, child_at, order,
    )


@dataclass
class Best:
    """The best documents of an item so far: scores, whether the id is missing, ids."""

    top: int
    score: np.ndarray
    nameless: np.ndarray
    doc_id: np.ndarray

    @classmethod
    def none(cls, top: int) -> Best:
        return cls(top, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    @property
    def least(self) -> int:
        """A document below this score cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, nameless: np.ndarray, doc_id: np.ndarray) -> None:
        score, nameless, doc_id = (
            np.concatenate(x) for x in ((self.score, score), (self.nameless, nameless), (self.doc_id, doc_id))
        )
        first = np.lexsort((doc_id, nameless, -score))[: self.top]
        self.score, self.nameless, self.doc_id = score[first], nameless[first], doc_id[first]


def search(tree: Tree, weight: np.ndarray, best: Best, nameless: np.ndarray, doc_id: np.ndarray, step: int = STEP) -> int:
    """Depth first, the highest bounds first; gives the number of units it looked at."""
    looked, stack = 0, [(np.zeros(1, np.int64), np.full(1, 2**62))]
    while stack:
        nodes, bound = stack.pop()
        nodes = nodes[bound >= best.least]
        if not len(nodes):
            continue
        units = tree.below(nodes)
        looked += len(units)
        score = tree.scores(units, weight)
        good = score >= best.least
        units, score = units[good], score[good]
        leaf = units >= tree.nodes
        if leaf.any():
            docs = tree.doc[units[leaf] - tree.nodes]
            best.add(score[leaf], nameless[docs], doc_id[docs])
        inner = np.flatnonzero(~leaf)
        inner = inner[np.argsort(score[inner], kind="stable")]
        stack += [(units[part], score[part]) for part in (inner[k : k + step] for k in range(0, len(inner), step))]
    return looked


@dataclass(frozen=True)
class Plan:
    """What a search needs in each task: the place of each term in the order of frequency, norms, and the items' weights."""

    place: np.ndarray
    docs: int
    length: int
    weights: list[tuple[np.ndarray, np.ndarray]]
    top: int

    def norm(self, sizes: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * sizes * self.docs) // self.length


def _trees(batches: Iterator[pa.RecordBatch], plan: Plan, size: int):
    """Trees of about `size` counts with the ids of their documents."""

    def made(parts):
        doc_id, sizes, terms, counts, lengths = (pa.chunked_array([p[k] for p in parts]) if k == 0 else np.concatenate([p[k] for p in parts]) for k in range(5))
        some = lengths > 0
        at = np.concatenate([[0], np.cumsum(lengths[some])])
        ids = doc_id.filter(pa.array(some))
        if len(ids):
            tree = build(plan.place[terms], counts.astype(np.int64), at, plan.norm(sizes[some]), len(plan.place))
            yield tree, np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))

    parts, held = [], 0
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            terms, counts = batch.column(2), batch.column(3)
            lengths = np.asarray(terms.value_lengths()).astype(np.int64)
            parts.append((batch.column(0), np.asarray(batch.column(1)), np.asarray(terms.flatten()), np.asarray(counts.flatten()), lengths))
            held += int(lengths.sum()) + batch.num_rows
            if held >= size:
                yield from made(parts)
                parts, held = [], 0
    if parts:
        yield from made(parts)


def best_of_tasks(kept: DataFrame, plan: Plan, tree: int = TREE) -> DataFrame:
    """item (its number), doc_id, score: the best documents of each item among those of a task."""
    shared = kept.sparkSession.sparkContext.broadcast(plan)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        best = [Best.none(plan.top) for _ in plan.weights]
        weight = np.zeros(len(plan.place), np.int64)
        for one, nameless, doc_id in _trees(batches, plan, tree):
            for (terms, weights), held in zip(plan.weights, best, strict=True):
                weight[terms] = weights
                search(one, weight, held, nameless, doc_id)
                weight[terms] = 0
        for k, held in enumerate(best):
            if len(held.score):
                ids = pa.array(held.doc_id, mask=held.nameless)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(held.score), k)), ids, pa.array(held.score)], ["item", "doc_id", "score"]
                )

    return kept.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _search_block(docs: DataFrame, texts: list[tuple[str, str]], top: int, tree: int) -> DataFrame | None:
    """key, rank, doc_id, score for a block of item texts with their keys."""
    asked = [(key, count_terms(text.encode())) for key, text in texts]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*[c for _, c in asked])))}
    if not vocabulary:
        return None
    kept = staged(vectors(docs, vocabulary), "term-vectors")
    totals = kept.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    if not totals.docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in kept.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r.t] = r["count"]
    weight = [math.floor(1000 * math.log((2 * totals.docs + 2) / (2 * n + 1))) for n in df.tolist()]
    place = np.empty(len(df), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weights = [
        (
            np.array([place[vocabulary[t]] for t in terms], np.int64),
            np.array([n * weight[vocabulary[t]] for t, n in terms.items()], np.int64),
        )
        for _, terms in asked
    ]
    found = best_of_tasks(kept, Plan(place, totals.docs, totals.length, weights, top), tree)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    keys = docs.sparkSession.createDataFrame([(k, key) for k, (key, _) in enumerate(asked)], "item bigint, key string")
    return ranked.join(F.broadcast(keys), "item").select("key", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS, tree: int = TREE) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item.

    Different item texts are searched for in blocks of about `block_chars` characters, one block in the driver at a time.
    """
    spark = docs.sparkSession
    named = staged(items.where("text IS NOT NULL").select("item_id", "text", F.sha2("text", 256).alias("key")), "items")
    texts = named.groupBy("key").agg(F.first("text").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    results = []
    for block in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        rows = [(r.key, r.text) for r in part.orderBy("key").collect()]
        found = _search_block(docs, rows, top, tree) if rows else None
        if found is not None:
            results.append(staged(found, "ranked"))
    empty = spark.createDataFrame([], "key string, rank int, doc_id bigint, score bigint")
    ranked = results[0] if results else empty
    for more in results[1:]:
        ranked = ranked.unionByName(more)
    return spread_join(named.select("item_id", "key"), ranked, ["key"], ["item_id"], "inner").select("item_id", "rank", "doc_id", "score")
