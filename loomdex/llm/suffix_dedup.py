"""Removal of repeated byte strings by bounded interval expansion on Burrows-Wheeler transforms of shards.

Each window of LENGTH bytes belongs to its minimizer: the least hash of the GRAM-byte strings in it. Consecutive windows
with the same minimizer form a run; equal windows lie in runs of the same minimizer, wherever they are. So:

1. each task cuts its documents into runs; minimizers are counted by their hash alone, combined on the map side, and those
   that occur once are dropped by a semi-join;
2. equal runs shrink to the one that starts first and a mark that there are more (many), by a digest; the list of all their
   places is kept. Only the first one's bytes are fetched;
3. runs are dealt out by minimizer. Each task builds the Burrows-Wheeler transform of shards of them and derives the common
   prefixes of neighbouring suffixes by increasing value, by breadth-first backward extension of intervals, stopping at
   LENGTH. What has no boundary by then are the sets of equal windows. They decide all: where the run starts first, the
   windows go that have an earlier place in their set; at its other places, those whose set has the run's first place;
4. a minimizer of more than HOT distinct runs (a passage in very many surroundings) is dealt out again, by windows: equal
   ones shrink to the first by a digest, and go to shards by that digest, so no shard holds more than its bound;
5. spans meet their document through the list of places, overlap is merged, and the bytes are cut.

Aggregates combine on the map side; joins are plain equi-joins, which the adaptive planner splits where a key is hot.
Tables between the steps are stored in the shared folder, and their shuffles are dropped as they end.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, by_bytes, map_arrow, store, text_bytes
from .suffixes import sorted_suffixes

LENGTH, GRAM = 100, 16
SHARD_BYTES, HOT = 1 << 18, 6_000
#: Windows that are hashed at a time.
STEP = 1 << 18
#: Bytes of texts that a task works on at a time.
PART_BYTES = 4 << 20
NO_ID = -(1 << 63)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPANS = "array<struct<start:int,end:int>>"


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= M1
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the 16 bytes from each position that has so many."""
    w = data.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    return mixed((w[:-8] * M1) ^ ((w[8:] * M2) >> np.uint64(7)) ^ (w[8:] * M2))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = int(M2) | 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, minimizer, digest, start, bytes, weight) of the runs of windows of texts, whose bytes go from at[i] to at[i + 1].

    The weight is 2 where a run may hold equal windows itself. Those would repeat with a period, so the minimizing string
    would stand at some window's own start other than the last one's. A run goes no further than STEP windows are hashed at
    once, which may part it in two.
    """
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    up, down = powers(STEP + length)
    out = []
    for lo in range(0, len(data) - length + 1, STEP):
        h = gram_hashes(data[lo : lo + STEP + length - 1])
        least = sliding_min(h, length - GRAM + 1)
        n = len(least)
        text = owner[lo : lo + n]
        whole = text == owner[lo + length - 1 : lo + length - 1 + n]
        head = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])))
        end = np.append(head[1:], n)
        kept = whole[head]
        head, end = head[kept], end[kept]
        at_start = np.concatenate([[0], np.cumsum(h[:n] == least)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h) * up[: len(h)], dtype=np.uint64)])
        size = end - head + length - 1
        digest = mixed((total[end + length - GRAM] - total[head]) * down[head] + size.astype(np.uint64))
        out.append((text[head], least[head].view(np.int64), digest.view(np.int64), (head + lo - at[text[head]]).astype(np.int32), size.astype(np.int32), 1 + (at_start[end - 1] > at_start[head]).astype(np.int32)))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int32, np.int64, np.int64, np.int32, np.int32, np.int32))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_windows(texts: list[bytes], length: int = LENGTH, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, text, offset) of the windows that stand more than once in some texts; equal ones are in one set.

    many: texts that stand for several equal ones. All their windows are in sets, be it alone.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum()) + len(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    first = (np.cumsum(sizes + 1) - sizes - 1).astype(np.int32)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    # Symbols are ranks of the bytes that there are, from 1, so as many as possible fit into a word; 0 ends a text.
    rank = np.zeros(256, np.int64)
    there = np.flatnonzero(np.bincount(flat, minlength=256))
    rank[there] = np.arange(1, len(there) + 1)
    kinds = len(there) + 1
    bits = int(kinds - 1).bit_length() or 1
    packs = 62 // bits
    symbols = np.zeros(n + length + 2 * packs, np.int64)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)] = rank[flat]
    packed, alive = symbols[:-packs].copy(), symbols[:-packs] != 0
    for k in range(1, packs):
        nxt = symbols[k : len(symbols) - packs + k]
        alive &= nxt != 0
        packed <<= bits
        packed |= nxt * alive
    suffixes = sorted_suffixes(packed, packs, length)
    suffixes = suffixes[suffixes < n].astype(np.int32)
    symbols = symbols[:n].astype(np.uint8)
    bwt = symbols[suffixes - 1]
    bwt[suffixes == 0] = 0
    # Where the suffix one symbol longer stands: a stable sort of the transform. Ends are symbols of their own.
    up = np.argsort(bwt, kind="stable").astype(np.int32)
    down = np.empty(n, np.int32)
    down[up] = np.arange(n, dtype=np.int32)
    front = np.repeat(np.arange(kinds, dtype=np.uint8), np.bincount(symbols, minlength=kinds))
    interval = np.empty(n, np.int32)
    # Common prefixes shorter than a word are read off the words, which ends cut short.
    word = packed[suffixes]
    left = np.minimum((first + sizes)[owner[suffixes]] - suffixes, packs).astype(np.int8)
    differs, common = word[1:] ^ word[:-1], np.zeros(n - 1, np.int8)
    depth = min(packs, length)
    for k in range(depth):
        common += differs < 1 << (bits * (packs - 1 - k))
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    del packed, alive, word, differs
    boundary = np.ones(n + 1, bool)
    boundary[1:-1] = common < depth
    marks = np.flatnonzero(boundary)
    newest = np.flatnonzero(common[marks[1:-1] - 1] == depth - 1) + 1
    low, high = marks[newest - 1].astype(np.int32), marks[newest].astype(np.int32)
    for _ in range(length - depth):
        if not len(low):
            break
        size = high - low
        one = low[size == 1]
        one = down[one[bwt[one] != 0]]
        new_low, new_high = [one], [one + 1]
        wide = size > 1
        if wide.any():
            lo, w = low[wide], size[wide]
            of = np.repeat(np.arange(len(lo), dtype=np.int32), w)
            at = np.arange(len(of), dtype=np.int32) + np.repeat(lo - np.cumsum(w, dtype=np.int32) + w, w)
            interval[at] = of
            to = np.sort(down[at[bwt[at] != 0]])
            if len(to):
                of = interval[up[to]]
                head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (front[to[1:]] != front[to[:-1]])))
                new_low.append(to[head])
                new_high.append(to[np.append(head[1:], len(to)) - 1] + 1)
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = ~boundary[high]
        low, high = low[fresh], high[fresh]
        boundary[high] = True
    head = np.flatnonzero(boundary[:n])
    size = np.append(head[1:], n) - head
    chosen = size > 1
    if many is not None:
        text = owner[suffixes[head]]
        chosen |= many[text] & (suffixes[head] - first[text] + length <= sizes[text])
    head, size = head[chosen], size[chosen]
    rows = np.repeat(head - np.cumsum(size) + size, size) + np.arange(size.sum())
    place = suffixes[rows]
    text = owner[place]
    return np.repeat(np.arange(len(head)), size), text, place - first[text]


def merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of overlapping or touching spans of a text."""
    by = np.lexsort((start, text))
    text, start, end = text[by], start[by], end[by]
    if not len(text):
        return text, start, end
    # The reach of a text's spans so far; texts are kept apart by an offset that is beyond every end.
    beyond = int(end.max()) + 1
    reach = np.maximum.accumulate(end + text.astype(np.int64) * beyond)
    fresh = np.append(True, (text[1:] != text[:-1]) | (start[1:] + text[1:].astype(np.int64) * beyond > reach[:-1]))
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(text)) - 1
    return text[head], start[head], reach[last] - text[head].astype(np.int64) * beyond


def later_windows(texts: list[bytes], place: np.ndarray, many: np.ndarray, length: int = LENGTH) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Two times (text, start, end): merged spans of windows that also start earlier, where a text stands first, and elsewhere.

    place: the rank of each text's first start. many: which texts stand elsewhere as well.
    """
    of, text, offset = repeated_windows(texts, length, many)
    if not len(of):
        return (of, of, of), (of, of, of)
    where = place[text] + offset
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    later, other = where != np.minimum.reduceat(where, head)[of], many[text]
    return tuple(merged(text[x], offset[x], offset[x] + length) for x in (later, other))


def _runs_of(batches: Batches) -> Batches:
    for batch in (part for whole in batches for part in by_bytes(whole, "text", PART_BYTES)):
        text, least, digest, start, size, weight = runs(*text_bytes(batch.column("text")))
        pick = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(digest), batch.column("doc").take(pick), batch.column("th").take(pick), pa.array(start), pa.array(size), pa.array(weight)], ["least", "digest", "doc", "th", "start", "size", "weight"])


def _units_of(batches: Batches) -> Batches:
    """The bytes of each document's runs, those of hot minimizers by windows. of1, of2: the run that a window is of."""
    names = ["k1", "k2", "doc", "start", "many", "unit", "of1", "of2", "at"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    for batch in (part for whole in batches for part in by_bytes(whole, "raw", PART_BYTES)):
        out: list[list] = [[] for _ in names]
        own = batch.column("runs")
        fields = {f: own.flatten().field(f).to_pylist() for f in ("least", "digest", "start", "size", "many", "hot")}
        row = np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        docs, texts = batch.column("doc").to_pylist(), batch.column("raw").to_pylist()
        for i, least, digest, start, size, many, hot in zip(row, *fields.values(), strict=True):
            if not hot:
                units = [(least, digest, docs[i], start, many, texts[i][start : start + size], None, None, None)]
            else:
                units = []
                for k in range(size - LENGTH + 1):
                    window = texts[i][start + k : start + k + LENGTH]
                    d = hashlib.blake2b(window, digest_size=16).digest()
                    units.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), docs[i], start + k, many, window, least, digest, k))
            for unit in units:
                for x, v in zip(out, unit, strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def span_lists(text: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> pa.Array:
    """The spans of each of so many texts, as lists."""
    at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=rows))]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at), spans)


def _expand(batches: Batches) -> Batches:
    """Spans that go from the distinct units of a task, which holds all those of a k1, sorted by it."""
    names = ["k1", "k2", "doc", "start", "many"]

    def spans(held: list[np.ndarray], units: list[bytes]) -> pa.RecordBatch:
        _, rank = np.unique(held[2], return_inverse=True)
        first, other = later_windows(units, (rank.astype(np.int64) << 32) + held[3], held[4])
        lists = [span_lists(*x, len(units)) for x in (first, other)]
        some = pa.array(np.isin(np.arange(len(units)), np.concatenate([first[0], other[0]])))
        out = pa.RecordBatch.from_arrays([*(pa.array(x) for x in held[:4]), *lists], [*names[:4], "first", "other"])
        return out.filter(some)

    held: list[np.ndarray] = [np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int32, bool)]
    units: list[bytes] = []
    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 2_000):
            part = batch.slice(lo, 2_000)
            own = part.column("unit").to_pylist()
            held = [np.concatenate([x, part.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, names, strict=True)]
            units += own
            size += sum(map(len, own))
            if size >= SHARD_BYTES and (end := int(np.searchsorted(held[0], held[0][-1]))):
                yield spans([x[:end] for x in held], units[:end])
                held, units = [x[end:] for x in held], units[end:]
                size = sum(map(len, units))
    if units:
        yield spans(held, units)


def _cut_spans(batches: Batches) -> Batches:
    for batch in (part for whole in batches for part in by_bytes(whole, "raw", PART_BYTES)):
        data, at = text_bytes(batch.column("raw"))
        lists = batch.column("spans")
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), counts)
        start, end = (lists.flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "end"))
        row, start, end = merged(row, start, end)
        # What is left of a document goes from its start, or the end of a span, to the next span or its end.
        heads, tails = np.sort(np.append(at[:-1], at[row] + end)).tolist(), np.sort(np.append(at[1:], at[row] + start)).tolist()
        left = b"".join(data[a:b].tobytes() for a, b in zip(heads, tails, strict=True))
        sizes = np.diff(at) - np.bincount(row, end - start, batch.num_rows).astype(np.int64)
        kept = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(left)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), span_lists(row, start, end, batch.num_rows), kept], ["doc_id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (maximal spans of bytes), kept (the remaining bytes).

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of a smaller id, or earlier
    in the same one. Null texts count as empty. A null id is smaller than any other. Rows that repeat an id with the same
    text are one place, so neither is earlier; with other texts under one id, their starts count as of one document. Texts
    shorter than LENGTH stay whole. An empty table gives no rows. Extra columns are not read. Minimizers of more than `hot`
    distinct runs are dealt out by windows, with the same result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    places = repeated_places(source)
    spans = store(spans_by_document(places, removals(source, places, hot)))
    return map_arrow(source.join(spans.hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", F.encode("text", "UTF-8").alias("raw"), "spans"), _cut_spans, f"doc_id long, n_bytes long, removed {SPANS}, kept binary")


def repeated_places(source: DataFrame) -> DataFrame:
    """The runs of each document whose minimizer occurs again: (k1, k2) is the run, k1 its minimizer."""
    every = map_arrow(source.where(F.octet_length("text") >= LENGTH).select("doc", "th", "text"), _runs_of, "least long, digest long, doc long, th long, start int, size int, weight int")
    again = store(every.groupBy("least").agg(F.sum("weight").alias("n")).where("n > 1").select("least"))
    return store(every.join(again.hint("shuffle_hash"), "least", "left_semi").select(F.col("least").alias("k1"), F.col("digest").alias("k2"), "doc", "th", "start", "size"))


def removals(source: DataFrame, places: DataFrame, hot: int = HOT) -> DataFrame:
    """By run (k1, k2): where it starts first (doc, start), the spans that go there (first), and those elsewhere (other)."""
    distinct = places.groupBy("k1", "k2").agg(F.min(F.struct("doc", "start", "th")).alias("m"), F.max("size").alias("size"), (F.count(F.lit(1)) > 1).alias("many"))
    distinct = store(distinct.select("k1", "k2", "m.*", "size", "many"))
    crowded = store(distinct.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("k1", F.lit(True).alias("hot")))
    marked = distinct.join(crowded, "k1", "left")
    by_doc = marked.groupBy("doc", "th").agg(F.collect_list(F.struct(F.col("k1").alias("least"), F.col("k2").alias("digest"), "start", "size", "many", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    texts = source.join(by_doc.hint("shuffle_hash"), ["doc", "th"]).select("doc", F.encode("text", "UTF-8").alias("raw"), "runs")
    units = store(map_arrow(texts, _units_of, "k1 long, k2 long, doc long, start int, many boolean, unit binary, of1 long, of2 long, at int"))

    def expanded(shards: DataFrame) -> DataFrame:
        dealt = shards.select("k1", "k2", "doc", "start", "many", "unit").repartition("k1").sortWithinPartitions("k1")
        return map_arrow(dealt, _expand, f"k1 long, k2 long, doc long, start int, first {SPANS}, other {SPANS}")

    found = store(expanded(units.where("of1 is null")))
    if crowded.isEmpty():
        return found
    windows = units.where("of1 is not null")
    places = windows.groupBy("k1", "k2").agg(F.min(F.struct("doc", "start")).alias("m"), ((F.count(F.lit(1)) > 1) | F.max("many")).alias("many"), F.max("unit").alias("unit"))
    gone = store(expanded(places.where("many").select("k1", "k2", "m.*", "many", "unit")).where("size(other) > 0").select("k1", "k2", F.col("doc").alias("doc0"), F.col("start").alias("start0")))
    hit = windows.join(gone, ["k1", "k2"]).select("of1", "of2", "doc", (F.col("start") - F.col("at")).alias("start"), F.struct(F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end")).alias("span"), ((F.col("doc") != F.col("doc0")) | (F.col("start") != F.col("start0"))).alias("late"))
    back = hit.groupBy(F.col("of1").alias("k1"), F.col("of2").alias("k2")).agg(F.min(F.struct("doc", "start")).alias("m"), F.collect_list(F.when(F.col("late"), F.col("span"))).alias("first"), F.collect_list("span").alias("other"))
    return found.unionByName(store(back.select("k1", "k2", "m.*", "first", "other")))


def spans_by_document(places: DataFrame, gone: DataFrame) -> DataFrame:
    """The spans that go from each document (doc, th), as one list."""
    early = gone.select("k1", "k2", F.col("doc").alias("doc0"), F.col("start").alias("start0"), "first", "other")
    own = places.join(early.hint("shuffle_hash"), ["k1", "k2"]).select("doc", "th", F.expr("transform(if(doc = doc0 and start = start0, first, other), x -> struct(start + x.start as start, start + x.end as end))").alias("spans"))
    return own.where("size(spans) > 0").groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of remove_repeats()'s rows."""
    return found.select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
