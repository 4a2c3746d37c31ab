"""Quality classifier by supervised subword embeddings.

A document is the mean of learned vectors of its words and its character n-grams (hashed), followed by a softmax layer; both
are fitted by stochastic gradient descent in numpy on a bounded sample of labelled documents (``MAX_TRAIN_DOCS`` of
them, chosen by a hash of the id, whole texts). Steps of the vectors are divided by the square root of the feature's
share of the document (a diagonal preconditioner), so that common features of long texts learn as fast as others. As
everything after the mean is linear, scoring folds the output layer into one number per hashed feature, so whole texts
are scored in Arrow batches by table lookups.

Defined results: an empty or null text gets the sample's share of label 1; without any labelled text the score is 0.5;
null labels are ignored; of rows that repeat an id the smallest text is learned from; repeated rows give repeated results;
extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import SPACE, U64, Rolling, blocks, mix, spans, words_per_row

MAX_TRAIN_DOCS = 4000
WORD_BITS, GRAM_BITS = 17, 16
GRAMS = (2, 4)
#: A word that equals the one this many words before counts as a word of its own kind, "again".
AGAIN = (1, 2, 3, 4, 6)
SIZE = 16
EPOCHS = 8
N_FEATURES = (1 << WORD_BITS) + len(GRAMS) * (1 << GRAM_BITS) + len(AGAIN)


@dataclass
class Model:
    """The fitted weights: a vector per feature, an output row per class, and the share of label 1."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    prior: float

    def folded(self) -> np.ndarray:
        """What each feature adds to the log odds of label 1, before the mean."""
        return self.vectors.astype(float) @ (self.output[1] - self.output[0])


def feature_runs(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words and each n-gram size: feature numbers in the order of the text, and where each document's begin."""
    rolling = Rolling(data)
    starts, ends = spans(data, at, ~SPACE)
    hashes, of = rolling(starts, ends), words_per_row(starts, at)
    yield (hashes >> U64(64 - WORD_BITS)).astype(np.int64), of
    doc = np.repeat(np.arange(len(at) - 1), np.diff(of))
    for k, back in enumerate(AGAIN):
        place = np.flatnonzero((hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])) + back
        yield np.full(len(place), N_FEATURES - 1 - k), np.searchsorted(place, of, "left")
    char = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where characters begin
    char_at = np.searchsorted(char, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(char_at))
    for k, size in enumerate(GRAMS):
        n = max(len(doc) - size + 1, 0)
        place = np.flatnonzero(doc[:n] == doc[len(doc) - n :])  # not over the border of two documents
        number = (mix(rolling.raw(char[place], char[place + size]) + U64(size)) >> U64(64 - GRAM_BITS)).astype(np.int64)
        yield (1 << WORD_BITS) + k * (1 << GRAM_BITS) + number, np.searchsorted(place, char_at, "left")


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features and their shares."""
    out = []
    for text in texts:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        numbers = np.concatenate([x for x, _ in feature_runs(raw, np.array([0, len(raw)]))]) if len(raw) else np.zeros(0, np.int64)
        kinds, many = np.unique(numbers, return_counts=True)
        out.append((kinds, (many / max(len(numbers), 1)).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = 2.0, seed: int = 5) -> Model | None:
    """Stochastic gradient descent on the cross entropy, a document a step, with a falling rate and the preconditioner above."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    vectors = (2 * rng.random((N_FEATURES, SIZE), np.float32) - 1) / np.float32(SIZE)
    output, bias = rng.normal(0, 0.1, (2, SIZE)), np.zeros(2)
    sets, steps = bags(texts), epochs * len(texts)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)).tolist():
            step = rate * (1 - done / steps)
            done += 1
            kinds, share = sets[i]
            rows = vectors[kinds]
            hidden = share @ rows
            logits = output @ hidden + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            back = chance @ output
            output -= step * np.outer(chance, hidden)
            bias -= 0.1 * step * chance
            if len(kinds):
                vectors[kinds] = rows - np.sqrt(share)[:, None] * (step * back).astype(np.float32)
    return Model(vectors, output, bias, float(np.mean(labels)))


def scores(model: Model | None, table: np.ndarray | None, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    if model is None:
        return np.full(n, 0.5)
    total, many = np.zeros(n), np.zeros(n)
    for numbers, of in feature_runs(data, at):
        sums = np.concatenate([[0.0], np.cumsum(table[numbers])])
        total += np.diff(sums[of])
        many += np.diff(of)
    odds = total / np.maximum(many, 1) + model.bias[1] - model.bias[0]
    return np.where(many > 0, 1 / (1 + np.exp(-np.clip(odds, -700, 700))), model.prior)


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and score, the chance of label 1."""
    table = None if model is None else model.folded()
    small = None if model is None else Model(np.zeros((0, SIZE)), model.output, model.bias, model.prior)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(small, table, data, at) for _, _, data, at in blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(go, "id long, score double").withColumnRenamed("id", id_col)


def sample(docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAIN_DOCS) -> pd.DataFrame:
    """At most ``most`` labelled documents with their labels, those with the smallest hashes of the id. Only ids and labels are sorted; texts are fetched for the chosen."""
    able = labels.where(learn_from & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["id"])
    chosen = able.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return texts.groupBy("id", "label").agg(F.min("text").alias("text")).toPandas().sort_values("id", kind="stable")


def fit(docs: DataFrame, labels: DataFrame, learn_from, **columns) -> Model | None:
    rows = sample(docs, labels, learn_from, **columns)
    return train(rows["text"].tolist(), rows["label"].tolist())
