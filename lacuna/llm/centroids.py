"""Centroid clustering over dictionary-encoded subvectors, in exact integers.

A vector is cut into blocks of neighbouring components. Each block has a dictionary of its frequent subvectors, and a vector is
stored as codes into these dictionaries; a subvector too rare for its dictionary is stored as it is, so nothing is lost. A
dictionary takes a subvector that at least one of ENTRIES vectors holds, so it has ENTRIES entries at most, whatever the data.
In each round the squared distances of all dictionary entries to the centroids' blocks are worked out once, the distance of a
vector is the sum over its codes, and the sums of a cluster are counts of codes times dictionary entries.

Defined results: a vector counts if it has exactly `dims` components, none of them null, NaN or infinite; other rows give no
row. Components must lie within +-2**20 (a clear error else), so that squared distances fit a long. Repeated rows count each;
a missing id is written as the empty text where ids are hashed. Of equal hashes, the smaller vector is the earlier centroid.
With fewer vectors than centroids there are as many centroids as vectors. An empty table gives an empty result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.arrow import tidy
from lacuna.session import staged

CENTROIDS = 16
ROUNDS = 3
DIMS = 64
#: Components in a block.
WIDTH = 2
#: Entries of a block's dictionary at most.
ENTRIES = 8192
#: Vectors that a task looks at together.
ROWS = 8192
SCALE = 64
LARGEST = 2**26


def integers(table: DataFrame, vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """vec_id and the components times 64, rounded down, of all usable vectors."""
    x = F.col(f"`{vector}`")
    usable = (F.size(x) == dims) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf"))
    )
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    fits = F.forall(scaled, lambda v: v.between(-LARGEST, LARGEST))
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit("a component is beyond 2**20")).cast("array<bigint>"))
    return table.where(F.coalesce(usable, F.lit(False))).select("vec_id", checked.alias("x"))


def first_centroids(vectors: DataFrame, count: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order."""
    sha = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(sha.alias("h"), "x").orderBy("h", "x").limit(count).collect()
    return np.array([r.x for r in rows], np.int64)


@dataclass(frozen=True)
class Dictionaries:
    """Per block the entries in ascending order; what travels to the tasks, bounded by ENTRIES a block."""

    entries: list[np.ndarray]
    width: int

    @property
    def dims(self) -> int:
        return self.width * len(self.entries)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes of (rows, dims) integers; -1 where a subvector has no entry."""
        out = np.full((len(x), len(self.entries)), -1, np.int32)
        for b, entries in enumerate(self.entries):
            if len(entries):
                part = np.ascontiguousarray(x[:, b * self.width : (b + 1) * self.width])
                order, keys = _sortable(entries), _sortable(part)
                at = np.minimum(np.searchsorted(order, keys), len(entries) - 1)
                out[:, b] = np.where(order[at] == keys, at, -1)
        return out

    def distances(self, centroids: np.ndarray) -> list[np.ndarray]:
        """Per block (entries, centroids) squared distances."""
        return [_squares(e, centroids[:, b * self.width : (b + 1) * self.width]) for b, e in enumerate(self.entries)]


def _sortable(parts: np.ndarray) -> np.ndarray:
    """Rows of integers as byte strings that sort as the rows do."""
    big = (parts.astype(np.int64) + 2**62).astype(">i8")
    return np.ascontiguousarray(big).view(f"S{8 * parts.shape[1]}").ravel()


def _squares(parts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    off = parts[:, None, :] - centres[None, :, :]
    return (off * off).sum(axis=2)


def dictionaries(vectors: DataFrame, dims: int = DIMS, width: int = WIDTH, entries: int = ENTRIES) -> Dictionaries:
    """Subvectors that at least one of `entries` vectors holds, counted over all vectors."""
    total = vectors.count()
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(dims // width - 1)),
        lambda b: F.struct(b.alias("block"), F.slice("x", b * width + 1, width).alias("part")),
    )
    counted = vectors.select(F.inline(blocks)).groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.where(F.col("n") * entries >= total).select("block", "part").collect()
    parts: list[list] = [[] for _ in range(dims // width)]
    for r in rows:
        parts[r.block].append(r.part)
    return Dictionaries([np.array(sorted(p), np.int64).reshape(-1, width) for p in parts], width)


def _lists(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists without missing values."""
    lists = column.cast(pa.large_list(column.type.value_type))
    at = np.asarray(lists.offsets)
    return np.asarray(lists.values)[at[0] : at[-1]].astype(kind), at - at[0]


def encode(vectors: DataFrame, book: Dictionaries) -> DataFrame:
    """vec_id, codes, and the subvectors without an entry, one after the other."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = _lists(batch.column(1), np.int64)[0].reshape(-1, book.dims)
                codes = book.codes(x)
                rare = x.reshape(len(x), -1, book.width)[codes < 0].ravel()
                ends = np.cumsum((codes < 0).sum(axis=1) * book.width)
                wide = np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.ListArray.from_arrays(wide, codes.ravel()),
                        pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), rare),
                    ],
                    ["vec_id", "codes", "rare"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, codes array<int>, rare array<bigint>")


def _coded(batches: Iterator[pa.RecordBatch], book: Dictionaries):
    """Batches of at most ROWS vectors: (batch, codes, rare subvectors in the order of their places)."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            codes = _lists(batch.column(1), np.int32)[0].reshape(-1, len(book.entries))
            yield batch, codes, _lists(batch.column(2), np.int64)[0].reshape(-1, book.width)


def _nearest(codes, rare, centroids, tables) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller of equal ones, and the squared distance of each vector."""
    total = np.zeros((len(codes), len(centroids)), np.int64)
    for b, table in enumerate(tables):
        known = codes[:, b] >= 0
        if known.all():
            total += table[codes[:, b]]
        else:
            total[known] += table[codes[known, b]]
    rows, blocks = np.nonzero(codes < 0)
    if len(rows):
        width = rare.shape[1]
        parts = centroids.reshape(len(centroids), -1, width)[:, blocks, :]
        off = rare[None, :, :] - parts
        np.add.at(total, rows, (off * off).sum(axis=2).T)
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def sums(coded: DataFrame, shared, centroids: np.ndarray) -> DataFrame:
    """(cluster, place, n, total): per cluster and component the number of vectors and their sum."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        tables, k, width = book.distances(centroids), len(centroids), book.width
        held, total = np.zeros(k, np.int64), np.zeros((k, book.dims), np.int64)
        for _, codes, rare in _coded(batches, book):
            best, _ = _nearest(codes, rare, centroids, tables)
            held += np.bincount(best, minlength=k)
            for b, entries in enumerate(book.entries):
                known = codes[:, b] >= 0
                if len(entries):
                    counts = np.bincount(best[known] * len(entries) + codes[known, b], minlength=k * len(entries))
                    total[:, b * width : (b + 1) * width] += counts.reshape(k, -1) @ entries
            rows, blocks = np.nonzero(codes < 0)
            np.add.at(total.reshape(k, -1, width), (best[rows], blocks), rare)
        cluster, place = np.divmod(np.arange(total.size), book.dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster), pa.array(place), pa.array(held[cluster]), pa.array(total.ravel())], ["cluster", "place", "n", "total"]
        )

    parts = coded.mapInArrow(run, "cluster bigint, place bigint, n bigint, total bigint")
    return parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def moved(centroids: np.ndarray, summed: DataFrame) -> np.ndarray:
    """Centroids after a round: the sums' means, rounded down; an empty cluster keeps its centroid."""
    out = centroids.copy()
    for r in summed.where("n > 0").collect():
        out[r.cluster, r.place] = r.total // r.n
    return out


def assign(coded: DataFrame, shared, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        tables = book.distances(centroids)
        for batch, codes, rare in _coded(batches, book):
            best, distance = _nearest(codes, rare, centroids, tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    kind = coded.schema["vec_id"].dataType.simpleString()
    return coded.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def components_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


@dataclass(frozen=True)
class Clustering:
    """Centroids after the last round, and vec_id, cluster, distance of every vector."""

    centroids: np.ndarray
    assigned: DataFrame


def cluster(
    table: DataFrame, vector: str = "embedding", dims: int = DIMS, centroids: int = CENTROIDS, rounds: int = ROUNDS,
    width: int = WIDTH, entries: int = ENTRIES,
) -> Clustering:
    """Rounds of nearest centroid and mean; `width` components make a block."""
    if dims % width:
        raise ValueError("blocks must divide the components")
    vectors = staged(integers(table, vector, dims), "integers")
    book = dictionaries(vectors, dims, width, entries)
    coded = staged(encode(vectors, book), "codes")
    shared = table.sparkSession.sparkContext.broadcast(book)
    now = first_centroids(vectors, centroids).reshape(-1, dims)
    for _ in range(rounds if len(now) else 0):
        now = moved(now, sums(coded, shared, now))
    if not len(now):
        return Clustering(now, coded.selectExpr("vec_id", "0 AS cluster", "0L AS distance").limit(0))
    return Clustering(now, staged(assign(coded, shared, now), "assigned"))


def report(found: Clustering) -> DataFrame:
    """Every vector with its cluster, its squared distance, the inertias and the hash of its centroid."""
    per_cluster = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    held = {r.cluster: r.cluster_inertia for r in per_cluster.collect()}
    hashes = [components_sha256(c) for c in found.centroids]

    def pick(values: list, kind: str) -> Column:
        literal = ", ".join(f"CAST({v!r} AS {kind})" for v in values)
        return F.element_at(F.expr(f"array({literal})"), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    return found.assigned.select(
        "vec_id", "cluster", "distance",
        pick([held.get(k, 0) for k in range(len(hashes))], "bigint").alias("cluster_inertia"),
        F.lit(sum(held.values())).cast("bigint").alias("inertia"),
        pick(hashes, "string").alias("centroid_sha256"),
    )
