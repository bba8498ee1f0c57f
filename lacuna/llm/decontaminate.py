"""Benchmark decontamination by pigeonhole edit matching.

Text and items are lower-cased with white space as single blanks. An item of n characters may differ from a passage by
k = n // chars_per_edit edits. Cut into k + 1 pieces, one piece must stand in the passage unchanged. The pieces of a
block of items form one automaton that runs over every whole text; each hit fixes a window, and Myers' bit-parallel
distance of the item to the best substring of the window decides. An item of fewer than `exact_below` characters has one
piece and no edits, and must stand between word bounds, since letters inside of other words are no mention of it.

Items are taken in blocks of bounded size, so what is sent to the tasks does not grow with the benchmark; documents are
not shuffled.

Defined results: missing and empty texts match nothing, nor do empty items; `matches` looks for every other item, `clean`
rejects documents for items of at least `min_chars` (as prepared), since a few words say nothing about a document; repeated items and rows are reported each; empty tables give no rows. Extra
columns of `docs` are kept by `clean` and ignored by `matches`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.arrow import tidy

CHARS_PER_EDIT = 16
#: Items shorter than this must stand as they are; documents are not rejected for them.
MIN_CHARS = 24
#: Characters of the items in a block.
BLOCK_CHARS = 8_000_000

MATCHES = "doc_id bigint, item_id bigint, distance int, match_start bigint, match_end bigint"


def prepared(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def between_bounds(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit of the passage continues in the text around it."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    after = end < len(text) and text[end].isalnum() and text[end - 1].isalnum()
    return not before and not after


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of the item cut into edits + 1 parts of about equal length."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(lo, item[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def substring_distance(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of the text, first end of such a substring)."""
    size = len(pattern)
    where: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        where[c] |= 1 << k
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(zero | up))
        minus = up & zero
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Items of one block, their pieces and budgets."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int, exact_below: int = MIN_CHARS):
        import ahocorasick

        self.exact_below = exact_below
        self.items = [(item_id, text, len(text) // chars_per_edit if len(text) >= exact_below else 0) for item_id, text in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                places[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) where an item may stand; overlapping ones are joined."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (size, at) in self.automaton.iter(text):
            for k, offset in at:
                _, item, edits = self.items[k]
                start = last + 1 - size - offset
                if len(item) < self.exact_below and (k in found or not between_bounds(text, start, last + 1)):
                    continue
                found[k].append((start - edits, start + len(item) + edits))
        for k, spans in found.items():
            spans.sort()
            lo, hi = spans[0]
            for a, b in spans[1:]:
                if a > hi:
                    yield k, lo, hi
                    lo = a
                hi = max(hi, b)
            yield k, lo, hi

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the closest passage of each item within its budget."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, lo, hi in self.windows(text):
            _, item, edits = self.items[k]
            lo = max(lo, 0)
            if k in best and best[k][0] == 0:
                continue
            exact = text.find(item, lo, hi)
            if exact >= 0:
                best[k] = (0, exact, exact + len(item))
                continue
            distance, end = substring_distance(item, text[lo:hi])
            if distance <= edits and (k not in best or distance < best[k][0]):
                head = text[lo : lo + end]
                _, back = substring_distance(item[::-1], head[::-1])
                best[k] = (distance, lo + end - back, lo + end)
        return [(self.items[k][0], *found) for k, found in sorted(best.items())]


def _blocks(items: DataFrame, min_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Prepared items in blocks of bounded size."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = 1 + int(chars // BLOCK_CHARS)
    for k in range(many):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(many)) == k).select("item_id", "text").collect()
        block = [(r.item_id, text) for r in own if len(text := prepared(r.text)) >= min_chars]
        if block:
            yield block


def matches(docs: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, exact_below: int = MIN_CHARS) -> DataFrame:
    """The closest passage of each item in each document that holds one within the budget."""
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for block in _blocks(items, 1):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, chars_per_edit, exact_below)
            for batch in batches:
                rows = []
                for k in range(batch.num_rows):
                    found = matcher.find(prepared(batch.column(1)[k].as_py()))
                    rows += [(batch.column(0)[k].as_py(), *f) for f in found]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["doc_id", "item_id", "distance", "match_start", "match_end"],
                    )

        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(tidy(run), MATCHES))
    return out


def clean(docs: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, with all their columns, in which no item stands within its budget."""
    text_at = docs.columns.index("text")
    for block in _blocks(items, min_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, chars_per_edit)
            for batch in batches:
                texts = batch.column(text_at)
                keep = [not matcher.find(prepared(texts[k].as_py())) for k in range(batch.num_rows)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
