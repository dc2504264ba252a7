"""Toxicity by logistic regression, trained with FTRL-proximal over hashed word n-grams and skip-grams.

Per-coordinate rates let rare words move as far as they must; the L1 term keeps most weights at zero, so the
model is a sorted list of buckets and weights, of at most 2**BITS entries, that is broadcast. Features are
the presence of words, pairs of neighbouring words and pairs with one word between them, over the whole text,
and for the beginnings of words how often they occur, up to REPEATS times.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, map_arrow, sample_by_hash, strings
from .words import WordHashes, words

BITS = 20
#: At most so many labelled rows train the model, those with the least hash of their id.
TRAIN_ROWS, EPOCHS, FOLDS = 8_000, 2, 3
ALPHA, BETA, L1, L2 = 0.2, 1.0, 2.5, 1.0
STEMS, REPEATS = (4, 5, 7), 4
CUT = 0.7
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(rows: np.ndarray) -> np.ndarray:
    """Buckets of a document, with repeats, from the hashes of its words in order."""
    spread = rows[:, 0] * PAIR
    parts = [spread]
    if len(spread) > 1:
        parts.append((spread[:-1] ^ (spread[:-1] >> np.uint64(29))) * SKIP + spread[1:])
    if len(spread) > 2:
        parts.append((spread[:-2] ^ (spread[:-2] >> np.uint64(31))) * PAIR + spread[2:] * SKIP)
    stems = np.sort(rows[:, 1:].ravel())
    stems = stems[np.searchsorted(stems, np.uint64(1)) :]
    if len(stems):
        m = np.arange(len(stems))
        nth = m - np.maximum.accumulate(np.where(np.append(True, stems[1:] != stems[:-1]), m, 0))
        few = nth < REPEATS
        parts.append((stems[few] + nth[few].astype(np.uint64) * np.uint64(1 << 33)) * SKIP)
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """Non-zero weights by bucket, bias, and the line from raw to calibrated log-odds."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.dense = None

    def raw(self, buckets: np.ndarray) -> float:
        if self.dense is None:
            self.dense = np.zeros(1 << BITS, np.float32)
            self.dense[self.buckets] = self.weights
        hit = buckets[self.dense[buckets] != 0]
        return self.bias + float(self.dense[np.unique(hit)].sum(dtype=np.float64)) if len(hit) else self.bias

    def score(self, raw: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30))))


class FTRL:
    """Follow the regularised leader, proximal: the weights follow from the sums z and n of each coordinate."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def calibrate(raw: np.ndarray, label: np.ndarray, cut: float) -> tuple[float, float]:
    """(slope, shift) of log-odds such that the raw score that parts the labels best gets probability `cut`."""
    by = np.argsort(raw, kind="stable")
    r, y = raw[by], label[by]
    ones = y.sum()
    # Taking rows i and above as ones: F1 by i.
    found = ones - np.concatenate([[0], np.cumsum(y)])[:-1]
    f1 = 2 * found / (np.arange(len(r), 0, -1) + ones)
    f1[1:][r[1:] == r[:-1]] = -1
    best = int(np.argmax(f1))
    at = r[best] if best == 0 else (r[best] + r[best - 1]) / 2
    slope = 1.0 / max(1e-3, float(np.std(r)) / 2)
    return slope, float(np.log(cut / (1 - cut)) - slope * at)


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    size = 1 << BITS
    ftrl = FTRL(size)
    for _ in range(EPOCHS):
        for buckets, label in rows:
            ftrl.learn(np.append(buckets, size), label)
    w = ftrl.weights(np.arange(size + 1))
    nonzero = np.flatnonzero(w[:-1])
    return Model(nonzero, w[nonzero], float(w[-1]))


def train(rows: list[tuple[np.ndarray, int]], cut: float = CUT) -> Model:
    """rows: (distinct buckets, label). Each fold is scored by the other folds' model to calibrate the whole one.

    Without at least FOLDS rows of each label every score is 0.
    """
    ones = sum(y for _, y in rows)
    if min(ones, len(rows) - ones) < FOLDS:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    rows = sorted(rows, key=lambda r: r[1])  # stable: labels are spread evenly over the folds
    raw = np.empty(len(rows))
    for k in range(FOLDS):
        mixed = [rows[i] for i in np.random.default_rng(k).permutation(len(rows)) if i % FOLDS != k]
        part = fit(mixed)
        raw[k::FOLDS] = [part.raw(b) for b, _ in rows[k::FOLDS]]
    model = fit([rows[i] for i in np.random.default_rng(FOLDS).permutation(len(rows))])
    model.slope, model.shift = calibrate(raw, np.array([y for _, y in rows]), cut)
    return model


def bucket_sample(docs: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[np.ndarray, int]]:
    """(distinct buckets, label) of at most `rows` labelled documents. labelled: doc_id, label."""
    drawn = sample_by_hash(labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), "doc_id", rows)
    # The drawn ids are at most `rows`, so they can be broadcast.
    text = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text")

    def run(batches: Batches) -> Batches:
        hashes = WordHashes(STEMS)
        for batch in batches:
            found = [np.unique(features(hashes.of(words(x)))).astype(np.int32) for x in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "label", "buckets"])

    found = map_arrow(text, run, "doc_id long, label int, buckets binary").groupBy("doc_id", "label").agg(F.min("buckets").alias("buckets"))  # of rows that repeat an id, one
    got = [(r.doc_id, np.frombuffer(bytes(r.buckets), np.int32).astype(np.int64), r.label) for r in found.toLocalIterator()]
    return [x[1:] for x in sorted(got, key=lambda x: x[0])]


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= cut).

    labels: doc_id and toxic; rows whose crc32(doc_id as text) mod folds is `held` never train. Null labels and ids
    are left out; of several labels of one id the largest counts. Null texts count as empty: no features, and the
    score of the bias. A document with a null id is scored, with held_out false. Without labels of both kinds every
    score is 0. Only the text makes a score.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    labelled = labels.where(~out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(train(bucket_sample(source, labelled, rows), cut))

    def run(batches: Batches) -> Batches:
        model, hashes = shared.value, WordHashes(STEMS)
        for batch in batches:
            score = [model.score(model.raw(features(hashes.of(words(x))))) for x in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(x >= cut) for x in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(source.select("doc_id", out("doc_id").alias("held_out"), "text"), run, SCHEMA)
