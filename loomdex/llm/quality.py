"""Quality by a byte-level convolutional network in numpy.

Filters over WIDTH bytes, one table of weights by byte and offset, run over the whole document. Their rectified
outputs are averaged over overlapping chunks of two blocks, and each filter is max-pooled over the chunks, so a bad
passage counts wherever it stands. A further channel, the share of four-byte strings of a chunk that it holds more
than once, lets the network see repetition, which filters of a few bytes cannot. A logistic unit combines all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, by_bytes, map_arrow, sample_by_hash, strings

BLOCK, WIDTH, FILTERS = 128, 4, 8
#: At most so many labelled rows, and bytes of each, train the model; bytes beyond are left out evenly by whole blocks.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 16_384
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.01, 1e-4
CUT = 0.3
BATCH_BLOCKS = 16_384
#: Bytes of texts that a task scores at a time.
PART_BYTES = 4 << 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, inside, first): rows of BLOCK bytes, which of them belong to a text, and the first row of each text.

    Behind each text stand at least WIDTH zeros, so no filter sees the next one.
    """
    rows = np.array([(len(t) + WIDTH + BLOCK - 1) // BLOCK for t in texts], np.int64)
    first = np.cumsum(rows) - rows
    flat = np.zeros(int(rows.sum()) * BLOCK, np.uint8)
    inside = np.zeros(len(flat), bool)
    for t, at in zip(texts, first * BLOCK, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        inside[at : at + len(t)] = True
    return flat.reshape(-1, BLOCK), inside.reshape(-1, BLOCK), first


def activations(tables: np.ndarray, bias: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Rectified filter outputs at each byte, by filter last. block is flat and followed by WIDTH - 1 bytes."""
    n = len(block) - WIDTH + 1
    out = np.take(tables[0], block[:n], axis=0)
    for k in range(1, WIDTH):
        out += np.take(tables[k], block[k : k + n], axis=0)
    out += bias
    return np.maximum(out, 0, out=out)


def chunked(per_block: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums over chunks of two blocks, the document of each chunk, its first block). A document of one block is one chunk."""
    rows = np.append(first[1:], len(per_block)) - first
    n = np.maximum(rows - 1, 1)
    doc = np.repeat(np.arange(len(first)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    total = per_block[at].copy()
    two = rows[doc] > 1
    total[two] += per_block[at[two] + 1]
    return total, doc, at


def repetition(flat: np.ndarray, at: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of repeated four-byte strings in each chunk."""
    padded = np.concatenate([flat, np.zeros(2 * BLOCK, np.uint8)])
    grams = padded[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        grams |= padded[k : len(padded) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    out = np.empty(len(at), np.float32)
    for lo in range(0, len(at), 4096):
        own = grams[at[lo : lo + 4096, None] * BLOCK + np.arange(2 * BLOCK - 3)]
        # A chunk of one block is followed by zeros or another text there.
        own[~two[lo : lo + 4096], BLOCK - 3 :] = 0
        own.sort(axis=1)
        out[lo : lo + 4096] = ((own[:, 1:] == own[:, :-1]) & (own[:, 1:] != 0)).sum(axis=1) / np.maximum(1, (own != 0).sum(axis=1))
    return out


@dataclass
class Network:
    tables: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(features by document, the chunk that each was taken from, what the gradient needs)."""
        block, inside, first = blocks_of(texts)
        padded = np.concatenate([block.ravel(), np.zeros(WIDTH - 1, np.uint8)])
        sums = np.empty((len(block), FILTERS), np.float32)
        for lo in range(0, len(block), 512):
            hi = min(lo + 512, len(block))
            out = activations(self.tables, self.bias, padded[lo * BLOCK : hi * BLOCK + WIDTH - 1])
            out *= inside[lo:hi].reshape(-1, 1)
            sums[lo:hi] = out.reshape(-1, BLOCK, FILTERS).sum(axis=1)
        length = inside.sum(axis=1, dtype=np.float32)
        total, doc, at = chunked(np.concatenate([sums, length[:, None]], axis=1), first)
        rows = np.append(first[1:], len(block)) - first
        size = np.maximum(total[:, -1:], 1)
        mean = np.concatenate([total[:, :-1] / size, repetition(block.ravel(), at, rows[doc] > 1)[:, None]], axis=1)
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        best = np.maximum.reduceat(mean, head, axis=0)
        return best, mean, (padded, inside, doc, at, size[:, 0], head, rows)

    def raw(self, texts: list[bytes]) -> np.ndarray:
        out, lo = np.empty(len(texts)), 0
        while lo < len(texts):  # by parts of bounded size; a text longer than that is a part of its own
            hi, n = lo + 1, len(texts[lo]) // BLOCK
            while hi < len(texts) and n < BATCH_BLOCKS:
                n += len(texts[hi]) // BLOCK + 1
                hi += 1
            out[lo:hi] = self.pooled(texts[lo:hi])[0] @ self.weights + self.offset
            lo = hi
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.shift, -30, 30)))


def fit(rows: list[tuple[bytes, int]], seed: int = 1) -> Network:
    """Adam on the log-loss; the gradient reaches the chunks that the pooling took."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(np.mean([y for _, y in rows]), 0.01, 0.99))
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.append(rng.normal(0, 0.5, FILTERS), -1).astype(np.float64), float(np.log(share / (1 - share))) + 1)
    params = [net.tables, net.bias, net.weights]
    first, second = [np.zeros_like(p, np.float64) for p in params] + [0.0], [np.zeros_like(p, np.float64) for p in params] + [0.0]
    step, weight = 0, {1: 0.5 / share, 0: 0.5 / (1 - share)}
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            batch = [rows[i] for i in order[lo : lo + BATCH]]
            y = np.array([b[1] for b in batch])
            best, mean, (padded, inside, doc, at, size, head, n_blocks) = net.pooled([b[0] for b in batch])
            z = best @ net.weights + net.offset
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.array([weight[int(v)] for v in y]) / len(y)
            grad = [np.zeros(net.tables.shape), np.zeros(FILTERS), best.T @ g + DECAY * net.weights, g.sum()]
            ends = np.append(head[1:], len(doc))
            for f in range(FILTERS):
                for d in range(len(batch)):
                    c = head[d] + int(np.argmax(mean[head[d] : ends[d], f]))
                    lo_, hi_ = at[c] * BLOCK, (at[c] + min(2, n_blocks[d])) * BLOCK
                    own = padded[lo_ : hi_ + WIDTH - 1]
                    n = hi_ - lo_
                    x = net.tables[0, own[:n], f] + net.bias[f]
                    for k in range(1, WIDTH):
                        x = x + net.tables[k, own[k : k + n], f]
                    live = np.flatnonzero((x > 0) & inside.ravel()[lo_:hi_])
                    up = g[d] * net.weights[f] / size[c]
                    for k in range(WIDTH):
                        grad[0][k, :, f] += np.bincount(own[live + k], minlength=256) * up
                    grad[1][f] += len(live) * up
            step += 1
            new = []
            for i, gr in enumerate(grad):
                first[i] = 0.9 * first[i] + 0.1 * gr
                second[i] = 0.999 * second[i] + 0.001 * gr * gr
                new.append(RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8))
            net.tables -= new[0].astype(np.float32)
            net.bias -= new[1].astype(np.float32)
            net.weights -= new[2] * 3
            net.offset -= float(new[3]) * 3
    return net


def calibrate(raw: np.ndarray, label: np.ndarray, cut: float) -> tuple[float, float]:
    """(slope, shift) such that the raw score with the fewest errors, each label weighing alike, gets probability `cut`."""
    by = np.argsort(raw, kind="stable")
    r, y = raw[by], label[by]
    lost = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    kept = (np.sum(1 - y) - np.concatenate([[0], np.cumsum(1 - y)])) / max(1, np.sum(1 - y))
    error = (lost + kept)[:-1]
    error[1:][r[1:] == r[:-1]] = 9
    best = int(np.argmin(error))
    at = r[best] if best == 0 else (r[best] + r[best - 1]) / 2
    slope = 1.0 / max(1e-3, float(np.std(r)) / 2)
    return slope, float(np.log(cut / (1 - cut)) - slope * at)


def train(rows: list[tuple[bytes, int]], cut: float = CUT) -> Network | None:
    """Every fourth row of each label calibrates. None without four rows of each label."""
    ones = sum(y for _, y in rows)
    if min(ones, len(rows) - ones) < 4:
        return None
    rows = sorted(rows, key=lambda r: r[1])
    net, hold = fit([r for i, r in enumerate(rows) if i % 4]), rows[::4]
    net.slope, net.shift = calibrate(net.raw([t for t, _ in hold]), np.array([y for _, y in hold]), cut)
    return net


def training_texts(docs: DataFrame, labelled: DataFrame, rows: int, most: int = TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """(bytes, label) of at most `rows` labelled documents, drawn by a hash of the id, with `most` bytes of each.

    Of a longer text, pairs of blocks go that stand evenly over the whole of it. Of several texts of one id, that of the
    least hash counts.
    """
    drawn = sample_by_hash(labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), "doc_id", rows)
    text = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text")  # at most `rows` ids

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for x in strings(batch.column(2)):
                b = x.encode("utf-8", "surrogatepass")
                if len(b) > most:
                    pairs = -(-len(b) // (2 * BLOCK))
                    at = np.linspace(0, pairs - 1, most // (2 * BLOCK)).astype(int)
                    b = b"".join(b[i * 2 * BLOCK : (i + 1) * 2 * BLOCK] for i in at)
                out.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "label", "text"])

    found = map_arrow(text, run, "doc_id long, label int, text binary").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label")).alias("m")).select("doc_id", "m.text", "m.label")
    return [x[1:] for x in sorted((r.doc_id, bytes(r.text), r.label) for r in found.toLocalIterator())]


def held_out(column: str, folds: int, held: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))


def shared_network(docs: DataFrame, labels: DataFrame, folds: int, held: int, id_col: str, text_col: str, rows: int, cut: float, most: int) -> Broadcast:
    """A network trained on the labelled rows that are not held out, broadcast; its size is fixed."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labelled = labels.where(~held_out("doc_id", folds, held)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return docs.sparkSession.sparkContext.broadcast(train(training_texts(source, labelled, rows, most), cut))


def scores(net: Network | None, column: pa.Array) -> np.ndarray:
    texts = [x.encode("utf-8", "surrogatepass") for x in strings(column)]
    return net.score(texts) if net else np.ones(len(texts))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, cut: float = CUT, most: int = TRAIN_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: better), predicted (score >= cut).

    labels: doc_id and quality; rows whose crc32(doc_id as text) mod folds is `held` never train. At most `rows` labelled
    documents train, by `most` bytes of each. Null labels and ids are left out; of several labels of one id the largest
    counts. Null and empty texts have all features at 0. A document with a null id is scored, with held_out false. Rows
    that repeat an id are scored each. Without four rows of each label every score is 1, so nothing is rejected. Only the
    text makes a score. An empty table gives no rows. Extra columns are not read.
    """
    shared = shared_network(docs, labels, folds, held, id_col, text_col, rows, cut, most)

    def run(batches: Batches) -> Batches:
        for batch in (part for whole in batches for part in by_bytes(whole, 2, PART_BYTES)):
            score = scores(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source.select("doc_id", held_out("doc_id", folds, held).alias("held_out"), "text"), run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS, cut: float = CUT, most: int = TRAIN_BYTES) -> DataFrame:
    """docs, with all its columns, without the documents that the classifier of score_quality() rejects.

    Each row is judged by its own text, so repeated and null ids make no difference, and nothing is joined.
    """
    shared = shared_network(docs, labels, folds, held, id_col, text_col, rows, cut, most)
    at = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        for batch in (part for whole in batches for part in by_bytes(whole, at, PART_BYTES)):
            yield batch.filter(pa.array(scores(shared.value, batch.column(at)) >= cut))

    return map_arrow(docs, run, docs.schema)
