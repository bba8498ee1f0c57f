"""Removal of byte strings that an earlier document holds, by suffix arrays of content-routed shards.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Two equal strings
contain the same least hashed 20-byte word, so a run of strings with one such word (a piece, length - 1 bytes longer than
its number of strings) can be sent to a shard named by the word: equal strings always meet.

1. Every task lists its pieces' words without their bytes, as short hashes of the word and of what stands beside it;
   pieces that agree with no piece of another row in the word and one side are dropped. A row marks its first piece with
   a word and sides, so that two rows count as two, whatever their keys.
2. The pieces of the other words are cut from the texts. Equal pieces of a task are sent once, with the places where they
   stand, so that a passage shared by a third of all documents costs its text once per task.
3. A shard builds suffix arrays (Larsson-Sadakane) of blocks of distinct pieces, takes common prefixes (Kasai) to find
   equal strings, and looks up the strings of each block in the arrays of the others by binary search. Each string's
   smallest id over all blocks decides.
4. Covered spans return to the documents.

Bytes are compared in step 3, so the hashes of the first steps can only let more through.

Defined results: a missing text is empty; texts below `length` bytes stay; a missing id counts as later than all others;
rows with one id cover nothing in each other; repeated rows get equal results; an empty table gives no rows. Extra columns are
ignored by `spans`, kept by `remove_repeats`, whose texts drop the broken rest of a character that is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import rows
from lacuna.llm.arrow import slices, tidy, utf8
from lacuna.llm.shingles import mix
from lacuna.llm.suffix_arrays import common_prefixes, packed, prefix_table, search, suffix_array
from lacuna.session import staged

LENGTH = 50
WORD = 20
NO_ID = 2**63 - 1
#: Text of all documents for each shard, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 4_000_000, 256
SLICE_BYTES = 1_000_000
#: Text of a task that is listed, and pieces of a task that are made distinct, at once.
TASK_BYTES = 16_000_000
PIECE_BYTES = 32_000_000
#: Distinct pieces in one suffix array.
BLOCK_BYTES = 1_000_000
SALTS = 32
#: Documents are asked for by a key of so many bits; one that shares a key only sends more pieces.
KEY_BITS = 32
#: Of a word's hash, 16 bits are listed from here on. A least hash is small, so its highest bits hardly tell words apart.
VALUE_SHIFT = 32

LISTED = "shard int, listed binary"
FLAGGED = "doc bigint, shard int, pieces binary"
SENT = "shard int, text binary, places binary"
COVERED = "did bigint, th int, spans binary"

#: A piece of a document: where it starts, how many bytes it has.
_PIECE = np.dtype([("at", "<u4"), ("size", "<u4")])


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, compressed byte plane by byte plane."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _spread(blob: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of `_squeeze`, of these dtypes."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    types = [np.dtype(k) for k in kinds.split()]
    many, at, out = len(raw) // sum(t.itemsize for t in types), 0, []
    for kind in types:
        planes = raw[at : at + many * kind.itemsize].reshape(kind.itemsize, many)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += many * kind.itemsize
    return out


def _low_bytes(values: np.ndarray, many: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :many]).view(f"V{many}").reshape(-1)


def _widen(values: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(values), 8), np.uint8)
    wide[:, : values.itemsize] = values.view(np.uint8).reshape(len(values), -1)
    return wide.reshape(-1).view("<i8")


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of strings with the same least word at the same place: (row, start in the text, strings, hash, left, right).

    `left` and `right` hash the (length - WORD) / 2 bytes beside the word. A string that holds the word holds all of
    these on one side at least, so equal strings agree in the word and in one of the two.
    """
    windows = np.maximum(np.diff(at) - length + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    word = packed(data)
    many = len(data) - WORD + 1
    hashed = mix(word[:many] * np.uint64(0x9E3779B97F4A7C15) + word[8 : many + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
                 + word[WORD - 8 : many + WORD - 8] * np.uint64(0x165667B19E3779F9))
    span, reach, least = length - WORD + 1, 1, hashed
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[step:], least[:-step])
        reach += step
    row = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    window = at[row] + start
    value = least[window]
    leaves = hashed[window] == value  # the string begins with its word, so the next one does not hold it here
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1]) | leaves[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(row)))
    value = value[first]
    # The word's place: the first at or behind the beginning of the run's last string, also where a text ends before it.
    where = window[first + size - 1]
    open_ = np.arange(len(where))
    while len(open_ := open_[hashed[where[open_]] != value[open_]]):
        where[open_] += 1
    side = (length - WORD) // 2
    last = len(data) - 1

    def beside(lo: np.ndarray) -> np.ndarray:
        near, far = word[np.clip(lo, 0, last)], word[np.clip(lo + side - 8, 0, last)]
        return mix(near * np.uint64(0x9E3779B97F4A7C15) + far)

    return row[first], start[first], size, value, beside(where - side), beside(where + WORD)


def _listed(length: int, shards: int):
    """Words of the pieces of a task by shard, with the key of their document and their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                data, at = utf8(part.column(1))
                row, start, many, value, left, right = runs(data, at, length)
                left, right = left.astype(np.uint8), right.astype(np.uint8)
                marked = start.astype(np.uint32) | (_firsts(row, value, left, right).astype(np.uint32) << 31)
                held.append((np.asarray(part.column(0))[row], marked, many.astype(np.uint8), value, left, right))
                size += len(data)
                if size >= TASK_BYTES:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def emit(held) -> pa.RecordBatch:
        doc, start, many, value, left, right = (np.concatenate(c) for c in zip(*held, strict=True))
        shard = (value % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        out = []
        for k in range(shards):
            own = order[bounds[k] : bounds[k + 1]]
            if len(own):
                out.append((k, _squeeze(
                    _low_bytes(doc[own], KEY_BITS // 8), (value[own] >> np.uint64(VALUE_SHIFT)).astype("<u2"), left[own], right[own], start[own], many[own])))
        columns = list(zip(*out, strict=True)) or [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], names=["shard", "listed"])

    return run


def _firsts(row: np.ndarray, value: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether a word stands in its row for the first time between these sides; rows are known here, not their keys.

    Pieces with one word are compared in their order, so that sides which take turns in a row count again: that only lets
    more through.
    """
    order = np.argsort(value, kind="stable")
    beside = ((row << 16) | (left.astype(np.int64) << 8) | right)[order]
    first = np.ones(len(order), bool)
    first[1:] = (value[order][1:] != value[order][:-1]) | (beside[1:] != beside[:-1])
    out = np.empty(len(order), bool)
    out[order] = first
    return out


def _several(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a key may stand in more than one row: whether it is marked as a row's first more than once."""
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    heads = np.flatnonzero(new)
    several = np.add.reduceat(first[order].astype(np.int64), heads) > 1
    out = np.empty(len(order), bool)
    out[order] = np.repeat(several, np.diff(np.append(heads, len(order))))
    return out


def _flag(length: int):
    """Pieces whose word may stand in more than one row, by document."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_spread(blob, f"V{KEY_BITS // 8} <u2 u1 u1 <u4 u1") for blob in table.column("listed").to_pylist()]
        doc, value, left, right, start, many = (np.concatenate(c) for c in zip(*parts, strict=True))
        doc, value = _widen(doc), value.astype(np.int64) << 8
        first, start = start >> 31, start & np.uint32(2**31 - 1)
        keep = np.flatnonzero(_several(value | left, first) | _several(value | right, first))
        keep = keep[np.argsort(doc[keep], kind="stable")]
        docs, head = np.unique(doc[keep], return_index=True)
        pieces = np.empty(len(keep), _PIECE)
        pieces["at"], pieces["size"] = start[keep], many[keep].astype(np.int64) + length - 1
        return pa.table({
            "doc": docs, "shard": np.full(len(docs), table.column("shard")[0].as_py(), np.int32),
            "pieces": pa.array([p.tobytes() for p in np.split(pieces, head[1:])] if len(docs) else [], pa.binary())})

    return run


def _send(length: int):
    """Cut the flagged pieces out of the texts; equal pieces of a task once, for their smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, int]] = {}
        seen, size = [], 0
        for batch in batches:
            data, bounds = utf8(batch.column(2))
            raw = data.tobytes()
            lists = batch.column(3)
            entries = lists.flatten()
            many = np.array([len(e) for e in entries.field("pieces").to_pylist()], np.int64) // _PIECE.itemsize
            pieces = np.frombuffer(b"".join(entries.field("pieces").to_pylist()), _PIECE)
            own = np.diff(np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])])
            row = np.repeat(np.arange(batch.num_rows), own)
            shard = np.repeat(entries.field("shard").to_numpy(), many)
            lows = bounds[:-1][row] + pieces["at"]
            ok = (pieces["size"] >= length) & (lows + pieces["size"] <= bounds[1:][row])  # else asked for by a shared key
            row, shard, lows, pieces = row[ok], shard[ok], lows[ok], pieces[ok]
            for k in np.unique(shard).tolist():
                held.setdefault(k, {})
            number = []
            for k, lo, hi in zip(shard.tolist(), lows.tolist(), (lows + pieces["size"]).tolist(), strict=True):
                known = held[k]
                number.append(known.setdefault(raw[lo:hi], len(known)))
            seen.append((shard, np.array(number, np.uint32), pieces["size"].astype("<u4"), np.asarray(batch.column(0))[row],
                         np.asarray(batch.column(1))[row], pieces["at"].astype("<u4")))
            size += int(pieces["size"].sum()) + 24 * len(row)
            if size >= PIECE_BYTES:
                yield emit(held, seen)
                held, seen, size = {}, [], 0
        if seen:
            yield emit(held, seen)

    def emit(held: dict[int, dict[bytes, int]], seen: list) -> pa.RecordBatch:
        zipped = zstandard.ZstdCompressor(level=3)
        columns = [np.concatenate(c) for c in zip(*seen, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        shards, heads = np.unique(columns[0][order], return_index=True)
        places = [_squeeze(*[c[own] for c in columns[1:]]) for own in np.split(order, heads[1:])] if len(shards) else []
        texts = [zipped.compress(b"".join(held[k])) for k in shards.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int32()), pa.array(texts, pa.binary()), pa.array(places, pa.binary())], names=["shard", "text", "places"])

    return run


class Block:
    """Suffix array of some distinct pieces: their strings, sorted, with the smallest id that holds each."""

    def __init__(self, pieces: list[bytes], dids: np.ndarray, length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        self.ends = np.cumsum(sizes)
        self.words = packed(self.data)
        order = suffix_array(self.words)
        owner = np.repeat(np.arange(len(pieces)), sizes)[order]
        inside = order + length <= self.ends[owner]  # a string stands in one piece
        self.position, self.piece = order[inside], owner[inside]
        new = common_prefixes(self.words, self.position, length) < length
        new[:1] = True
        self.heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(dids[self.piece], self.heads) if len(self.heads) else np.zeros(0, np.int64)
        self.dids = dids

    @cached_property
    def strings(self) -> np.ndarray:
        return prefix_table(self.words, self.position[self.heads], self.length)

    def meet(self, other: Block) -> None:
        """Give strings that both blocks hold the smaller id of the two."""
        small, large = sorted((self, other), key=lambda b: len(b.strings))
        found = search(large.strings, small.strings)
        mine = np.flatnonzero(found >= 0)
        both = np.minimum(small.least[mine], large.least[found[mine]])
        small.least[mine] = both
        large.least[found[mine]] = both

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start in the piece, size) of spans covered by strings that an earlier document holds."""
        hit = self.least[self.group] < self.dids[self.piece]
        position, piece = self.position[hit], self.piece[hit]
        order = np.argsort(position)
        position, piece = position[order], piece[order]
        new = np.ones(len(position), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (position[1:] > position[:-1] + self.length)
        heads = np.flatnonzero(new)
        last = np.append(heads[1:], len(position)) - 1 if len(heads) else heads
        begin = self.ends - np.diff(np.concatenate([[0], self.ends]))
        return piece[heads], position[heads] - begin[piece[heads]], position[last] + self.length - position[heads]


def _compare(length: int):
    """Covered spans of the pieces of a shard, by document."""

    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        seen = []
        for text, places in zip(table.column("text").to_pylist(), table.column("places").to_pylist(), strict=True):
            own = _spread(places, "<u4 <u4 <i8 <i4 <u4")
            raw = zstandard.ZstdDecompressor().decompress(text)
            each = np.zeros(int(own[0].max()) + 1, np.int64)
            each[own[0]] = own[1]
            ends = np.cumsum(each).tolist()
            ids = np.array([number.setdefault(raw[lo:hi], len(number)) for lo, hi in zip([0, *ends], ends, strict=False)], np.int64)
            seen.append((ids[own[0]], *own[1:]))
        piece, size, did, th, at = (np.concatenate(c) for c in zip(*seen, strict=True))
        dids = np.full(len(number), NO_ID, np.int64)
        np.minimum.at(dids, piece, did)
        later = did > dids[piece]
        first = np.flatnonzero(~later)
        pieces = list(number)
        ends = np.cumsum([len(p) for p in pieces])
        blocks, lo = [], 0
        while lo < len(pieces):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
            blocks.append((lo, Block(pieces[lo:hi], dids[lo:hi], length)))
            lo = hi
        for k, (_, block) in enumerate(blocks):
            for _, other in blocks[:k]:
                block.meet(other)
        spans = [(covered + lo, start, many) for lo, block in blocks for covered, start, many in [block.covered()]]
        covered, start, many = (np.concatenate(c) for c in zip(*spans, strict=True))
        order = np.argsort(covered, kind="stable")
        covered, start, many = covered[order], start[order], many[order]
        low, high = np.searchsorted(covered, piece[first], "left"), np.searchsorted(covered, piece[first], "right")
        again = np.repeat(first, high - low)
        span = np.arange(len(again)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        did, th = np.concatenate([did[later], did[again]]), np.concatenate([th[later], th[again]])
        found = np.empty(len(did), _PIECE)
        found["at"] = np.concatenate([at[later], at[again] + start[span]])
        found["size"] = np.concatenate([size[later], many[span]])
        order = np.lexsort((th, did))
        did, th, found = did[order], th[order], found[order]
        heads = np.flatnonzero(np.append(True, (did[1:] != did[:-1]) | (th[1:] != th[:-1]))) if len(did) else np.zeros(0, np.int64)
        return pa.table({
            "did": did[heads], "th": th[heads],
            "spans": pa.array([f.tobytes() for f in np.split(found, heads[1:])] if len(heads) else [], pa.binary())})

    return run


def _key() -> Column:
    return F.xxhash64("did", "th").bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def _copies(keyed: DataFrame) -> DataFrame:
    """(did, th, doc, size) of texts that a document with a smaller id holds as they are."""
    light = keyed.select("did", "th", "doc", F.octet_length("text").alias("size"), F.md5("text").alias("digest"),
                         F.pmod("did", F.lit(SALTS)).alias("salt"))
    parts = light.groupBy("digest", "size", "salt").agg(F.min("did").alias("low"))
    low = parts.groupBy("digest", "size").agg(F.min("low").alias("rep"))
    reps = parts.join(low, ["digest", "size"]).select("digest", "size", "salt", "rep")
    return light.join(reps, ["digest", "size", "salt"]).where("did > rep").select("did", "th", "doc", "size")


def covered_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(did, th, spans): spans to remove, overlapping ones included, null for a whole text.

    `keyed` has did, th (hash of the text), doc, text; other columns only pass through. Copies are covered whole and take no part in what follows.
    """
    others = [c for c in keyed.columns if c not in ("text", "did", "th", "doc")]
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, int(total // SHARD_BYTES))
    copies = staged(_copies(keyed), "copies")
    gone = copies.select(*[F.col(c).alias(f"copy_{c}") for c in ("doc", "did", "th")]).distinct().hint("merge")
    # Partitioned by `doc` alone, as in the joins below, and with all columns, so that one exchange of the texts serves all.
    same = (F.col("doc") == F.col("copy_doc")) & F.col("did").between(F.col("copy_did"), F.col("copy_did")) & F.col("th").between(F.col("copy_th"), F.col("copy_th"))
    rest = keyed.join(gone, same, "left_anti")
    listed = rest.select("doc", "text", "did", "th", *others).mapInArrow(tidy(_listed(length, shards)), LISTED)
    flagged = listed.groupBy("shard").applyInArrow(_flag(length), FLAGGED)
    asked = flagged.groupBy("doc").agg(F.collect_list(F.struct("shard", "pieces")).alias("own"))
    sent = rest.join(asked.hint("merge"), "doc").select("did", "th", "text", "own", *others).mapInArrow(tidy(_send(length)), SENT)
    found = sent.groupBy("shard").applyInArrow(_compare(length), COVERED)
    return found.unionAll(copies.where(F.col("size") >= length).select("did", "th", F.lit(None).cast("binary")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "did": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.hash(rows.text_of()), "text": rows.text_of()}).withColumn("doc", _key())


def removed(size: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the spans (start, size) of a text of that size."""
    out: list[tuple[int, int]] = []
    for at, many in sorted(spans):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], at + many))
        else:
            out.append((at, at + many))
    return [(a, min(b, size)) for a, b in out]


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in gone:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _row_spans(own: list[dict] | None, did: int, th: int) -> list[tuple[int, int]]:
    mine = [o["spans"] for o in own or () if o["did"] == did and o["th"] == th]
    if None in mine:
        return [(0, NO_ID)]
    return [span for spans in mine for span in np.frombuffer(spans, _PIECE).tolist()]


def _with_spans(keyed: DataFrame, length: int) -> DataFrame:
    found = covered_spans(keyed, length).groupBy(_key().alias("doc")).agg(F.collect_list(F.struct("did", "th", "spans")).alias("own"))
    return keyed.join(found.hint("merge"), "doc", "left")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                did, th, text, own = (c[k].as_py() for c in batch.columns)
                text = text.encode()
                gone = removed(len(text), _row_spans(own, did, th))
                out.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(text, gone)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                names=["did", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = _keyed(docs).select("text", "did", "th", "doc")
    made = _with_spans(keyed, length).select("did", "th", "text", "own").mapInArrow(
        run, "did bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return made.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with all their columns, without the repeated bytes; `n_chars`, if there, is counted again."""
    others = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("n_chars", "text")}
    row = F.struct(F.col("text").isNull().alias("missing"), *[F.col(f"`{c}`").alias(own) for c, own in others.items()])
    inner = docs.select("doc_id", "text", row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                did, th, text, own = (batch.column(c)[k].as_py() for c in range(1, 5))
                gone = _row_spans(own, did, th)
                out.append(_kept(text.encode(), removed(len(text.encode()), gone)).decode("utf-8", "ignore") if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "kept"])

    # In the order in which the joins read them: only then is the one exchange of the texts used again.
    joined = _with_spans(_keyed(inner).select("text", "row", "did", "th", "doc"), length)
    kind = inner.schema["row"].dataType.simpleString()
    kept = joined.select("row", "did", "th", "text", "own").mapInArrow(run, f"row {kind}, kept string")
    made = {c: F.col("row").getField(own) for c, own in others.items()} | {"text": F.when(~F.col("row.missing"), F.col("kept"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[made[c].alias(c) for c in docs.columns])
