"""Language identification by prediction by partial matching.

For each language the training texts give a tree of byte contexts of up to three bytes: how often each byte followed a
context. With these counts frozen, a byte costs -log2 of its share in the longest context that has met it; each longer
context that was met without it first costs an escape (method C: distinct followers / (followers + distinct followers),
without exclusions); a byte that no context knows costs eight bits. The language with the shortest code for the whole
text wins, and the score is its posterior under equal priors.

The trees are a classifier fitted on a bounded sample: about `sample_docs` labelled documents of each language, chosen by
a hash of their ids. Prediction reads every byte of every document.

Defined results: `und` with score 0 where the text is missing or has no letter, or where nothing was learned; ties go to
the first language by name; repeated rows are judged alike; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.arrow import utf8

ORDER = 3
#: Documents of a language from which the trees are learned, at most about so many.
SAMPLE_DOCS = 2_000
#: Cells of a cost matrix held at once.
CELLS = 4_000_000

GRAMS = "lang string, length int, gram bigint, times bigint"


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes that end at each position, as one number; zeros stand before the start."""
    padded = np.concatenate([np.zeros(length - 1, np.uint8), data])
    out = np.zeros(len(data), np.uint32)
    for k in range(length):
        out = (out << np.uint32(8)) | padded[k : k + len(data)]
    return out


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, length, gram, times) over texts with a language: byte runs of 1 … ORDER + 1 bytes within a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                data, at = utf8(batch.column(0).filter(pa.array(langs == lang)))
                place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
                for length in range(1, ORDER + 2):
                    gram, times = np.unique(_grams(data, length)[place >= length - 1], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), length, np.int32)),
                         pa.array(gram.astype(np.int64)), pa.array(times.astype(np.int64))],
                        names=["lang", "length", "gram", "times"],
                    )

    counted = labelled.select("text", "lang").mapInArrow(run, GRAMS)
    return counted.groupBy("lang", "length", "gram").agg(F.sum("times").alias("times"))


class Lookup:
    """Row numbers of sorted keys, by direct addressing; the few keys that share a cell are searched for."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.bits = max(8, min(22, int(len(keys)).bit_length() + 5))
        self.cells = np.full(1 << self.bits, -1, np.int32)
        self.cells[self._cell(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        found = self.cells[self._cell(keys)]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        if len(wrong):
            at = np.minimum(np.searchsorted(self.keys, keys[wrong]), len(self.keys) - 1)
            found[wrong] = np.where(self.keys[at] == keys[wrong], at, -1)
        return found


class Trees:
    """Code lengths in bits of the last byte of a gram, for every language at once."""

    def __init__(self, counts: list[tuple[str, int, int, int]]):
        self.langs = sorted({c[0] for c in counts})
        number = {lang: i for i, lang in enumerate(self.langs)}
        columns = np.array([(number[c[0]], c[1], c[2], c[3]) for c in counts], np.int64).reshape(-1, 4)
        wide = len(self.langs)
        below = np.full((1, wide), 8.0)  # a byte that no context knows
        self.costs, self.escapes, self.grams, self.contexts = [], [], [], []
        for order in range(ORDER + 1):
            own = columns[columns[:, 1] == order + 1]
            grams, row = np.unique(own[:, 2], return_inverse=True)
            times = np.zeros((len(grams), wide))
            times[row, own[:, 0]] = own[:, 3]
            contexts, parent = np.unique(grams >> 8, return_inverse=True)
            total = np.zeros((len(contexts), wide))
            kinds = np.zeros((len(contexts), wide))
            np.add.at(total, parent, times)
            np.add.at(kinds, parent, times > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(times / (total + kinds)[parent])
            shorter = below if order == 0 else below[np.searchsorted(self.grams[-1].keys, grams & ((1 << 8 * order) - 1))]
            cost = np.where(times > 0, seen, escape[parent] + shorter)
            self.costs.append(cost.astype(np.float32))
            self.escapes.append(escape.astype(np.float32))
            self.grams.append(Lookup(grams))
            self.contexts.append(Lookup(contexts))
            below = cost

    def bits(self, gram: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code length of each byte: `gram` holds its last ORDER + 1 bytes, `place` its number in the text."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        rest = np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            able = rest if order == 0 else rest[place[rest] >= order]
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            found = self.grams[order](gram[able] & mask)
            hit = found >= 0
            if hit.all() and len(able) == len(gram):
                return self.costs[order][found]
            out[able[hit]] += self.costs[order][found[hit]]
            lost = able[~hit]
            context = self.contexts[order]((gram[lost] & mask) >> np.uint32(8))
            known = context >= 0
            out[lost[known]] += self.escapes[order][context[known]]
            rest = lost if order == 0 else np.concatenate([rest[place[rest] < order], lost])
        out[rest] += 8.0
        return out


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, int, int, int]]:
    """Counts of the trees from a sample of (doc_id, text, lang); its size, and so theirs, is bounded."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    share = {r.lang: min(1.0, sample_docs / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    if not share:
        return []
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.where(draw < F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv])[F.col("lang")])
    return [tuple(r) for r in count_grams(chosen).collect()]


def predict(docs: DataFrame, counts: list[tuple[str, int, int, int]], held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    light = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"
    if not counts:
        return light.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(counts)
        wide = len(trees.langs)
        step = max(1, CELLS // wide)
        for batch in batches:
            data, at = utf8(batch.column(3))
            total = np.zeros((batch.num_rows, wide))
            for lo in range(0, len(data), step):
                hi = min(len(data), lo + step)
                first = max(0, lo - ORDER)
                doc = np.searchsorted(at, np.arange(lo, hi), "right") - 1 if hi - lo < 64 else np.repeat(
                    np.arange(batch.num_rows), np.clip(np.minimum(at[1:], hi) - np.maximum(at[:-1], lo), 0, None))
                bits = trees.bits(_grams(data[first:hi], ORDER + 1)[lo - first :], np.arange(lo, hi) - at[doc])
                for k in range(wide):
                    total[:, k] += np.bincount(doc, bits[:, k], batch.num_rows)
            best = total.argmin(axis=1)
            score = 1 / np.exp2(-np.minimum(total - total.min(axis=1, keepdims=True), 1000)).sum(axis=1)
            letters = np.asarray(batch.column(2))
            names = [trees.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return light.mapInArrow(run, schema)
