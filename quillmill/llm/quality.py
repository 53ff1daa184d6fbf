"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

The model is fitted on a bounded sample of labelled rows (`Settings.sample_rows`, taken in
the order of a hash of doc_id); its weights (2**bits 4-byte floats) are all that a task
needs, so scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Runs of letters, digits and non-ASCII bytes are words; runs of one symbol are words, too.
WORD_CLASS = np.zeros(256, np.uint8)
WORD_CLASS[33:127] = np.arange(2, 96)
for _range in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    WORD_CLASS[list(_range)] = 1

#: Ids (before the modulus) of the two repetition patterns.
SAME_WORD, SAME_THREE = 104_729, 1_299_709


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    grams: int = 2
    sample_rows: int = 8000
    epochs: int = 6
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 10.0


def gram_ids(column: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk: its first text, its number of texts, hashed ids of all 1..grams-grams
    of its words, and the number in the chunk of the text each belongs to. Two patterns have ids of their own: a word equal to the one
    before it, and three words that the text has had before."""
    for at, raw, offsets in arrays.chunks(column):
        kind = WORD_CLASS[raw]
        change = np.ones(len(raw) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[offsets] = True
        edges = np.flatnonzero(change)
        starts, ends = edges[:-1], edges[1:]
        solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
        starts, ends = starts[solid], ends[solid]
        hashes = arrays.substring_hash(arrays.prefix(arrays.ASCII_LOWER[raw]), starts, ends)
        text = np.searchsorted(offsets, starts, "right") - 1
        ids, owners = [], []
        for n in range(1, s.grams + 1):
            grams = arrays.ngrams(hashes, n)
            if not len(grams):
                continue
            inside = text[: len(grams)] == text[n - 1 :]
            ids.append((grams[inside] >> np.uint64(64 - s.bits)).astype(np.int64))
            owners.append(text[: len(grams)][inside])
        if len(hashes) > 1:
            again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]))
            ids.append(np.full(len(again), SAME_WORD % (1 << s.bits)))
            owners.append(text[again])
        if len(hashes) > 2:
            inside = text[:-2] == text[2:]
            owner = text[:-2][inside]
            three = arrays.ngrams(hashes, 3)[inside] ^ arrays.mix(owner.astype(np.uint64))
            again = np.ones(len(three), bool)
            again[np.unique(three, return_index=True)[1]] = False
            ids.append(np.full(int(again.sum()), SAME_THREE % (1 << s.bits)))
            owners.append(owner[again])
        none = [np.zeros(0, np.int64)]
        yield at, len(offsets) - 1, np.concatenate(ids or none), np.concatenate(owners or none)


def train(texts: list[str | None], labels: list[int], s: Settings) -> tuple[np.ndarray, float]:
    """(weights, bias). A feature's value is scale * its share of the text's n-grams."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        ids = np.concatenate([x for _, _, x, _ in gram_ids(pa.array([text], pa.string()), s)])
        found, n = np.unique(ids, return_counts=True)
        rows.append((np.append(found, 1 << s.bits), np.append(s.scale * n / max(1, n.sum()), 1.0)))
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    order = np.random.default_rng(5)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            ids, x = rows[k]
            w = weights(z[ids], n[ids])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / s.alpha * w
            n[ids] += g * g
    w = weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 1 modulo 3. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights from at most sample_rows labelled rows of docs(doc_id, text) that are not
    held out. Null labels, and labels without a document, are left out; two rows for one
    document both count. No labelled row: zero weights, so every score is 0.5."""
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(s.sample_rows)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")  # at most sample_rows rows
        .toPandas()
        .sort_values(["doc_id", "quality", "text"], kind="stable")
    )
    return train(rows["text"].tolist(), (rows["quality"] == 1).astype(int).tolist(), s)


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts get the score of the bias."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, size, ids, owner in gram_ids(batch.column(1), s):
                total[at : at + size] = np.bincount(owner, weights[ids], size)
                count[at : at + size] = np.bincount(owner, minlength=size)
            margin = bias + s.scale * total / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-margin)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs. Only texts enter a score.
    An empty table gives an empty one; other columns are not read."""
    scored = score(docs, fit(docs, labels, s), s)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
