"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised, closed with an end id, and cut into pieces of at most `size` tokens. Pieces are counted by
length: at most `size` numbers reach the driver, whatever the corpus holds. Best fit with decreasing lengths runs over
these counts. Sequences that are filled alike are one range of numbers, so that each step places a whole range at once;
the plan is a few thousand runs (length, first rank, count, first sequence, offset). Pieces then take the planned places
by joining their rank within their length to the runs.

Tokens of a word depend on nothing beyond the white space around it (the vocabulary drops white space), so words are
tokenised once and looked up afterwards by a 64-bit hash, in a table of bounded size.

Defined results: a missing or empty text is one piece with the end id alone; a missing id sorts first; repeated rows are
packed each on its own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.arrow import slices, tidy, utf8
from lacuna.llm.shingles import word_hashes
from lacuna.session import staged

SIZE = 2048
END = 0
#: Words kept in a task's lookup table; it starts anew beyond that.
KNOWN_WORDS = 500_000
#: Parts in which the pieces of one length are ranked.
PARTS = 64
#: Text prepared at once.
SLICE_BYTES = 2_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_symbols() -> list[str]:
    """The symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_BYTE_SYMBOLS = _byte_symbols()
#: ASCII white space 0, letters 1, marks 2, the apostrophe 3 (it may open a run that ends in letters), all other bytes 4.
_KIND = np.array([
    0 if chr(b) in " \t\n\v\f\r" else 4 if not 32 < b < 127 or chr(b).isdigit() else 1 if chr(b).isalpha() else 3 if chr(b) == "'" else 2
    for b in range(256)
], np.uint8)


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, by words that were seen before."""

    _of_process: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[int, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordIds:
        """One table for all tasks of a Python worker."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in cls._of_process:
            cls._of_process[path] = cls(path)
        return cls._of_process[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 2000):
            found = self.tokenizer.encode_batch_fast(texts[lo : lo + 2000], add_special_tokens=False)
            out += [np.asarray(e.ids, "<u4").tobytes() for e in found]
        return out

    def learn(self, words: list[tuple[int, bytes]]) -> None:
        """Add words by their hashes.

        Words of Latin letters are one token run that needs no other preparation than lower case, so they go to the
        merges straight away; all others are encoded as texts.
        """
        known, tokenize, plain = self.known, self.tokenizer.model.tokenize, []
        for key, raw in words:
            if raw.isalpha():  # ASCII letters alone
                symbols = raw.lower().decode()
            else:
                low = raw.decode().lower()
                if not low.isalpha() or max(low) >= "\u0250":
                    plain.append((key, raw.decode()))
                    continue
                symbols = "".join(map(_BYTE_SYMBOLS.__getitem__, low.encode()))
            known[key] = array("I", [t.id for t in tokenize(symbols)]).tobytes()
        known.update(zip([k for k, _ in plain], self.encode([w for _, w in plain]), strict=True))

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; offsets, one more than texts)."""
        data, at = utf8(column)
        raw = data.tobytes()
        special = b"<|" in raw  # some words may be special tokens, as they are written
        if not special:
            data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
            raw = data.tobytes()
        kind = _KIND[data]
        new = np.empty(len(data), bool)
        new[:1] = True
        new[1:] = (kind[1:] == 0) | (kind[:-1] == 0)
        if not special:  # letters and marks that meet are token runs of their own
            new[1:] |= (kind[:-1] == 1) & ((kind[1:] == 2) | (kind[1:] == 3)) | (kind[:-1] == 2) & (kind[1:] == 1)
        new[at[:-1][at[:-1] < len(data)]] = True
        heads = np.flatnonzero(new)
        starts = heads[kind[heads] > 0]
        ends = np.append(heads[1:], len(data))[kind[heads] > 0]
        keys, first, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = keys.tolist()
        missing = [k for k, key in enumerate(keys) if key not in self.known]
        if len(self.known) + len(missing) > KNOWN_WORDS:
            self.known.clear()
            missing = list(range(len(keys)))
        lows, highs = starts[first].tolist(), ends[first].tolist()
        self.learn([(keys[k], raw[lows[k] : highs[k]]) for k in missing])
        found = [self.known[key] for key in keys]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(f) // 4 for f in found], np.int64)
        begin = np.cumsum(sizes) - sizes
        size = sizes[word] if len(word) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin[word] - total[:-1], size) + np.arange(total[-1])] if len(word) else flat
        return ids, total[np.searchsorted(starts, at)]


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END) -> DataFrame:
    closing = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.at(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids, at = words.of(part.column(1))
                raw, bounds = ids.tobytes(), (4 * at).tolist()
                out: list[tuple] = []
                for k, doc in enumerate(part.column(0).to_pylist()):
                    own = raw[bounds[k] : bounds[k + 1]] + closing
                    for nth, lo in enumerate(range(0, len(own), 4 * size)):
                        piece = own[lo : lo + 4 * size]
                        out.append((doc, nth, lo // 4, len(piece) // 4, zlib.crc32(piece)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: runs of (length, first rank, count, first sequence, offset)."""
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences that have just that room
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def fill(length: int, rank: int, left: int, first: int, last: int, room: int) -> tuple[int, int]:
        """Place up to `left` pieces into sequences first … last-1, each filled before the next."""
        each = room // length
        whole, rest = divmod(min(left, each * (last - first)), each)
        placed = 0
        for begin, many, times in ((first, whole, each), (first + whole, 1, rest)):
            if many and times:
                for k in range(times):
                    runs.append((length, rank + placed, many, begin, size - room + k * length))
                    placed += many
                free.setdefault(room - times * length, []).append((begin, begin + many))
        begin = first + whole + (rest > 0)
        if begin < last:
            free.setdefault(room, []).append((begin, last))
        return placed, begin

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = min((r for r, have in free.items() if r >= length and have), default=None)
            if room is None:
                need = -(-left // (size // length))
                placed, _ = fill(length, rank, left, opened, opened + need, size)
                opened += need
            else:
                first, last = free[room].pop()
                placed, _ = fill(length, rank, left, first, last, room)
            rank, left = rank + placed, left - placed
    return runs


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END, parts: int = PARTS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    pieces = staged(cut_pieces(docs, tokenizer_path, size, end).withColumn("part", part), "pieces")
    # At most size * parts counts, so they may pass through the driver.
    found = pieces.groupBy("length", "part").count().orderBy("length", "part").collect()
    counts: dict[int, int] = {}
    before = []
    for r in found:
        before.append((r.length, r.part, counts.get(r.length, 0)))
        counts[r.length] = counts.get(r.length, 0) + r["count"]
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    offsets = F.broadcast(spark.createDataFrame(before, "length bigint, part int, before bigint"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    # Runs of a length in order of rank; a row finds its run by counting the first ranks up to its own.
    runs = sorted(plan(counts, size))
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, sequence, offset in runs:
        by_length.setdefault(length, []).append((rank, sequence, offset))
    planned = spark.createDataFrame(
        [(length, *map(list, zip(*own, strict=True))) for length, own in by_length.items()],
        "length bigint, ranks array<bigint>, sequences array<bigint>, offsets array<bigint>",
    )
    nth = F.size(F.filter("ranks", lambda r: r <= F.col("rank")))
    return (
        ranked.join(F.broadcast(planned), "length").withColumn("nth", nth)
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.element_at("sequences", F.col("nth")) + F.col("rank") - F.element_at("ranks", F.col("nth"))).alias("sequence_id"),
            F.element_at("offsets", F.col("nth")).alias("offset"),
        )
    )
