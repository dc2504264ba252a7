"""Benchmark decontamination with an FM-index per shard of training text.

Each task cuts its documents into shards of a bounded size and indexes each one: words become
symbols (those that occur in no benchmark window share symbol 0), suffixes are sorted by prefix doubling, and
the Burrows-Wheeler transform goes into a wavelet matrix. All distinct windows are searched backward at once;
rows of non-empty ranges are located by walking to sampled suffix positions; overlapping occurrences merge
into removal spans. No document is shuffled.

The windows are broadcast, in blocks of about BLOCK_BYTES of item text. A shard is searched for one block after the other,
and its rows' spans are merged; a worker holds one block at a time, and the corpus is read once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, by_bytes, map_arrow, strings
from .suffixes import sorted_suffixes
from .words import WORD, words

WINDOW, MANY_ITEMS = 8, 2
SHARD_BYTES, SAMPLE_STEP, BLOCK_BYTES = 4 << 20, 16, 16 << 20
SPANS = "array<struct<start:int,end:int>>"
SCHEMA = f"doc_id long, n_words long, hits {SPANS}, spans {SPANS}, items array<string>"


class WaveletMatrix:
    """Ranks of symbols in a sequence: by level from the highest bit, the running count of zero bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.zeros = []
        for level in reversed(range(self.levels)):
            low = (sequence >> level) & 1 == 0
            counts = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(low, out=counts[1:])
            self.zeros.append(counts)
            sequence = np.concatenate([sequence[low], sequence[~low]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        start = np.zeros_like(at)
        for counts, level in zip(self.zeros, reversed(range(self.levels)), strict=True):
            one = (symbol >> level) & 1 == 1
            below = counts[-1].astype(np.int64)
            lo, hi = counts[start].astype(np.int64), counts[at].astype(np.int64)
            start, at = np.where(one, below + start - lo, lo), np.where(one, below + at - hi, hi)
        return at - start


class FMIndex:
    """Backward search and location in a sequence of symbols that ends in 0; patterns hold no 0."""

    def __init__(self, text: np.ndarray, symbols: int, step: int = SAMPLE_STEP):
        suffixes = sorted_suffixes(text)
        self.bwt = text[suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, symbols)
        # Positions behind a 0 are sampled as well: zeros are ordered by position, so no step may cross one.
        kept = (suffixes % step == 0) | (self.bwt == 0)
        self.sampled = np.where(kept, suffixes, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high) of patterns, the rows of a matrix, that occur."""
        which = np.arange(len(patterns))
        last = patterns[:, -1]
        low, high = self.before[last], self.before[last + 1]
        for j in reversed(range(patterns.shape[1] - 1)):
            there = low < high
            which, low, high = which[there], low[there], high[there]
            c = patterns[which, j]
            low, high = self.before[c] + self.tree.rank(c, low), self.before[c] + self.tree.rank(c, high)
        there = low < high
        return which[there], low[there], high[there]

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the range, text position) of each row of the ranges."""
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        at, steps = self.sampled[row], 0
        left = np.flatnonzero(at < 0)
        row = row[left]
        while len(left):
            steps += 1
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
            found = self.sampled[row]
            at[left] = np.where(found >= 0, found + steps, -1)
            left, row = left[found < 0], row[found < 0]
        return of, at


class Windows:
    """Distinct windows of benchmark items, by length, with the items that hold each."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW):
        held: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(len(w) - window + 1, min(len(w), 1))):
                held.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.symbol = {w: i + 1 for i, w in enumerate(sorted({x for k in held for x in k}))}
        self.names = sorted({x for k in held.values() for x in k})
        number = {x: i for i, x in enumerate(self.names)}
        self.patterns: list[np.ndarray] = []
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        for n in sorted({len(k) for k in held}):
            own = [k for k in held if len(k) == n]
            self.patterns.append(np.array([[self.symbol[x] for x in k] for k in own], np.int64))
            sets = [sorted(number[x] for x in held[k]) for k in own]
            self.items.append((np.cumsum([0, *map(len, sets)]), np.array([x for s in sets for x in s], np.int64)))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Unions of overlapping or touching spans."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    head = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[head].tolist(), reach[np.append(head[1:], len(starts)) - 1].tolist(), strict=True))


def leaks(shard: list[np.ndarray], windows: Windows) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
    """By the number of a document in the shard that any window occurs in: merged word spans, item ids."""
    sizes = np.array([len(x) for x in shard], np.int64)
    symbols = np.zeros(int(sizes.sum()) + len(shard), np.int64)
    doc = np.repeat(np.arange(len(shard)), sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    for at, x in zip(first, shard, strict=True):
        symbols[at : at + len(x)] = x
    # A run of words that no window holds needs one symbol only.
    kept = np.flatnonzero((symbols != 0) | np.append(symbols[1:] != 0, True))
    if not len(kept) or not windows.patterns:
        return {}
    index = FMIndex(symbols[kept], len(windows.symbol) + 1)
    docs, starts, ends, items = [], [], [], []
    for patterns, (at, of) in zip(windows.patterns, windows.items, strict=True):
        which, low, high = index.search(patterns)
        if not len(which):
            continue
        found, position = index.locate(low, high)
        position = kept[position]
        d = doc[position]
        docs.append(d)
        starts.append(position - first[d])
        ends.append(position - first[d] + patterns.shape[1])
        pair = np.unique(d * len(patterns) + which[found])
        pd_, w = pair // len(patterns), pair % len(patterns)
        n = at[w + 1] - at[w]
        items.append(np.stack([np.repeat(pd_, n), of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[w], n)]]))
    if not docs:
        return {}
    d, s, e = (np.concatenate(x) for x in (docs, starts, ends))
    by = np.argsort(d, kind="stable")
    d, s, e = d[by], s[by], e[by]
    held = np.unique(np.concatenate(items, axis=1), axis=1)
    out = {}
    for lo, hi in zip(cuts := np.flatnonzero(np.append(True, d[1:] != d[:-1])), np.append(cuts[1:], len(d)), strict=True):
        own = held[1, np.searchsorted(held[0], d[lo]) : np.searchsorted(held[0], d[lo], "right")]
        out[int(d[lo])] = merged(s[lo:hi], e[lo:hi]), sorted(windows.names[i] for i in own)
    return out


def character_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points from the first to the last word of each word span."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(lead[at[s][0]]), int(lead[at[e - 1][1]])) for s, e in hits]


def _held(block: Broadcast, alone: bool) -> Windows:
    """A block's windows. Of several blocks, a worker holds one at a time."""
    return block.value if alone else block.load_from_path(block._path)


def _scanned(batches: Batches, at: int, blocks: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, list[str], list[int], list[tuple[list[tuple[int, int]], list[str]]]]]:
    """(rows, texts, numbers of words, (merged word spans, items) of each row) by shards of a bounded size. at: the text's column."""
    for batch in batches:
        for rows in by_bytes(batch, at, SHARD_BYTES):
            texts = strings(rows.column(at))
            found: list[tuple[list, list]] = [([], []) for _ in texts]
            for block in blocks:
                windows = _held(block, len(blocks) == 1)
                symbol = windows.symbol.get
                shard = [np.array([symbol(w, 0) for w in words(x)], np.int32) for x in texts]
                for i, (spans, items) in leaks(shard, windows).items():
                    if found[i][0]:
                        both = np.array([*found[i][0], *spans])
                        spans, items = merged(both[:, 0], both[:, 1]), sorted({*found[i][1], *items})
                    found[i] = (spans, items)
            yield rows, texts, list(map(len, shard)), found


def window_blocks(benchmark: DataFrame, block_bytes: int) -> list[Broadcast]:
    """The windows of the benchmark, broadcast in blocks of about block_bytes of item text; equal rows are in one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item_id is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // block_bytes))
    sc = benchmark.sparkSession.sparkContext
    part = lambda b: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
    return [sc.broadcast(Windows((r.item_id, r.text) for r in part(b).toLocalIterator())) for b in range(blocks)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, hits and spans (merged removal spans in words and in code points), items.

    Null or empty texts have no words and no hits. Items without words, or with a null id, have no windows; rows
    of one item_id count as one item. Ids of items are given as strings, sorted as such. An empty benchmark
    leaves all documents clean. Rows that repeat a doc_id, or have none, are found each for itself. An empty table gives
    no rows. Extra columns are not read. Rows are the same for any block_bytes.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = window_blocks(benchmark, block_bytes)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    lists = lambda spans: pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], kind)

    def run(batches: Batches) -> Batches:
        for rows, texts, n_words, found in _scanned(batches, 1, blocks):
            chars = [character_spans(t, h) if h else [] for t, (h, _) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words, pa.int64()), lists(h for h, _ in found), lists(chars), pa.array([i for _, i in found], pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "spans", "items"])

    return map_arrow(source, run, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of find_leaks()'s rows."""
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.start)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= MANY_ITEMS).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated documents and, in the others, without the passages that windows cover.

    All columns stay; where passages go, the text closes up with a space. Documents without hits, null texts among them,
    are unchanged. Each row is judged by its own text, so repeated and null ids make no difference, and nothing is joined.
    """
    blocks, at = window_blocks(benchmark, block_bytes), docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        for rows, texts, _, found in _scanned(batches, at, blocks):
            new = rows.column(at).to_pylist()
            for i, (hits, _items) in enumerate(found):
                if hits:
                    spans = character_spans(texts[i], hits)
                    ends, starts = [0, *(b for _, b in spans)], [*(a for a, _ in spans), len(texts[i])]
                    new[i] = " ".join(texts[i][a:b] for a, b in zip(ends, starts, strict=True))
            out = rows.set_column(at, rows.schema.field(at), pa.array(new, rows.schema.field(at).type))
            yield out.filter(pa.array([len(items) < MANY_ITEMS for _, items in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
