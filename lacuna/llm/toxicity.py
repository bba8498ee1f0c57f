"""Toxicity by weak supervision.

Lexicon entries (words) and patterns (starts of words) that stand out in toxic documents of a labelled sample are dealt
into voters, beside voters on how many entries a text holds, on shouting and on exclamation. A generative model, fitted
by EM without looking at the labels, estimates how often each voter says what for either class; correlations that remain
between voters given the class lower their weight, so that voters that repeat each other count once. The posterior of
the model labels the sample, and a logistic classifier over the entries learns from these posterior labels. It scores
every whole text: each distinct entry counts once.

The classifier and the entries are fitted on about `sample_rows` labelled documents at most, chosen by a hash of their
ids; scoring covers every document. Only texts are inputs of a score.

Defined results: missing and empty texts get the score of a text without entries; with no labelled row of either class
all scores are 0; repeated rows get the same score; an empty table gives no rows. Extra columns are ignored by `score`
and kept by `reject`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.arrow import tidy

SAMPLE_ROWS = 30_000
#: Lexicon entries and patterns kept, the strongest first; a bound on the model.
ENTRIES = 5_000
STARTS = (4, 5, 6)
THRESHOLD = 0.7
VOTERS_OF_A_KIND = 12
KNOWN_WORDS = 200_000
#: An entry must be so many times likelier in toxic documents.
LEAST_RATIO = 50.0

_WORD = re.compile(r"\w+")
FEATURES = "doc bigint, entries array<string>, words int, shouting double, marks int"


def entries_of(word: str) -> list[str]:
    return [word] + [word[:k] + "*" for k in STARTS if len(word) > k]


def _text_features(texts: list[str]) -> list[tuple[list[str], int, float, int]]:
    out = []
    for text in texts:
        words = _WORD.findall(text.lower())
        letters = sum(map(len, words)) or 1
        found = sorted({e for w in set(words) for e in entries_of(w)})
        out.append((found, len(words), sum(c.isupper() for c in text) / letters, text.count("!")))
    return out


@dataclass
class Model:
    """Weights of entries and the bias of the classifier; what the label model found, for inspection."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float | None = None
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None


def votes_of(found: list[set[str]], numbers: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 none) of every voter on every sampled text; `numbers` has words, shouting, marks."""
    dealt = {e: zlib.crc32(e.encode()) % VOTERS_OF_A_KIND + VOTERS_OF_A_KIND * e.endswith("*") for own in found for e in own}
    votes = np.zeros((len(found), 2 * VOTERS_OF_A_KIND + 5), np.int8)
    for row, own in enumerate(found):
        for e in own:
            votes[row, dealt[e]] = 1
    many = np.array([len(own) for own in found])
    votes[:, -5] = np.where(many == 0, -1, 0)
    votes[:, -4] = np.where(many >= 2, 1, np.where(many == 0, -1, 0))
    votes[:, -3] = np.where(many * 100 >= np.maximum(numbers[:, 0], 1), 1, 0)
    votes[:, -2] = np.where(numbers[:, 1] > 0.3, 1, 0)
    votes[:, -1] = np.where(numbers[:, 2] >= 3, 1, 0)
    return votes


def label_model(votes: np.ndarray, share: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1 for each row, chance of each vote given the class, correlations given the class)."""
    onehot = np.stack([(votes == v) for v in (-1, 0, 1)], axis=2).astype(float)
    posterior = np.where((votes == 1).any(axis=1), 0.9, 0.1 * share)
    prior, weight = share, np.ones(votes.shape[1])
    chance = correlation = np.zeros(0)
    for _ in range(rounds):
        classes = np.stack([1 - posterior, posterior])
        chance = (np.einsum("cn,nvk->cvk", classes, onehot) + 0.1) / (classes.sum(axis=1) + 0.3)[:, None, None]
        expected = np.einsum("cn,cv->nv", classes, chance[:, :, 2] - chance[:, :, 0])
        rest = votes - expected
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        correlation = (rest.T @ rest) / len(votes) / np.outer(scale, scale)
        shared = np.clip(correlation, 0, 1).sum(axis=1) - np.clip(np.diag(correlation), 0, 1)
        weight = 1 / (1 + shared)
        ratio = np.log(chance[1]) - np.log(chance[0])
        logit = np.log(prior / (1 - prior)) + np.einsum("nvk,vk,v->n", onehot, ratio, weight)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        prior = float(np.clip(0.5 * share + 0.5 * posterior.mean(), 0.001, 0.999))
    return posterior, chance, correlation


def logistic(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, wide: int, rounds: int = 2000, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier over present entries, by accelerated gradient steps."""
    size = np.bincount(rows, minlength=len(labels)).max(initial=0) + 1.0
    weights = np.zeros(wide + 1)
    ahead, momentum = weights.copy(), 1.0
    step = 4.0 / size
    for _ in range(rounds):
        logit = ahead[-1] + np.bincount(rows, ahead[columns], len(labels))
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
        gradient = np.append(np.bincount(columns, error[rows], wide), error.sum())
        gradient[:-1] += ridge / len(labels) * ahead[:-1]
        if np.abs(gradient).max() < 1e-6:
            break
        new = ahead - step * gradient
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / later * (new - weights)
        weights, momentum = new, later
    return weights[:-1], float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """`learn_from`: a condition on `doc_id` of the labels that may be used."""
    known = labels.where(learn_from & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    many = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample_rows / max(many, 1)) * (1 << 20))))
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text IS NOT NULL").dropDuplicates(["text", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _text_features(batch.column(1).to_pylist())
            kinds = (pa.list_(pa.string()), pa.int32(), pa.float64(), pa.int32())
            columns = list(zip(*made, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], batch.column(2)],
                names=["doc", "entries", "words", "shouting", "marks", "toxic"],
            )

    features = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(tidy(run), FEATURES + ", toxic int").persist()
    sizes = {r.toxic: r["count"] for r in features.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        features.unpersist()
        return Model()
    toxic, clean = sizes[1], sizes[0]
    ratio = ((F.col("n1") + 0.5) / (toxic + 1)) / ((F.col("n0") + 0.5) / (clean + 1))
    counted = (
        features.select("toxic", F.explode("entries").alias("entry"))
        .groupBy("entry").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
        .where((F.col("n1") >= max(3, round(0.008 * toxic))) & (ratio >= LEAST_RATIO))
    )
    entries = [r.entry for r in counted.orderBy(F.desc(ratio * F.log1p("n1")), "entry").limit(ENTRIES).collect()]
    kept = F.array_intersect("entries", F.from_json(F.lit(_json(entries)), "array<string>"))
    rows = features.select("doc", "words", "shouting", "marks", kept.alias("kept")).orderBy("doc", "words").collect()  # about sample_rows
    features.unpersist()
    found = [set(r.kept) for r in rows]
    numbers = np.array([(r.words, r.shouting, r.marks) for r in rows], float).reshape(-1, 3)
    posterior, chance, correlation = label_model(votes_of(found, numbers), toxic / (toxic + clean))
    number = {e: k for k, e in enumerate(entries)}
    at = np.array([(k, number[e]) for k, own in enumerate(found) for e in sorted(own)], np.int64).reshape(-1, 2)
    weights, bias = logistic(at[:, 0], at[:, 1], posterior, len(entries))
    return Model(dict(zip(entries, map(float, weights), strict=True)), bias, chance, correlation)


def _json(values: list[str]) -> str:
    import json

    return json.dumps(values, ensure_ascii=False)


class Scorer:
    """Scores of texts; words are looked up in a table of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def _look(self, word: str) -> tuple[str, ...]:
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(e for e in entries_of(word) if e in self.model.weights)
        return found

    def of(self, text: str | None) -> float:
        if self.model.bias is None:
            return 0.0
        known, hits = self.known, set()
        for word in set(_WORD.findall((text or "").lower())):
            found = known.get(word)
            if found is None:
                found = self._look(word)
            if found:
                hits.update(found)
        logit = self.model.bias + sum(self.model.weights[e] for e in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def score(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = np.array([scorer.of(batch.column(2)[k].as_py()) for k in range(batch.num_rows)], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        tidy(run), "doc_id bigint, held_out boolean, score double, predicted int"
    )


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(text_at)
            yield batch.filter(pa.array([scorer.of(texts[k].as_py()) < threshold for k in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
