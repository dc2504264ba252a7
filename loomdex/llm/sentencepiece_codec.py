"""SentencePiece encoding and decoding by suffix-array matching.

The distinct pre-tokens of a batch that the worker has not met yet are joined into one text and their suffixes sorted.
Each piece of the vocabulary is then found by binary search as a range of suffixes; the occurrences are the edges of a
graph over positions, sorted by where they end. Relaxing a position picks the edge that byte-pair encoding would end
its prefix with: the one whose piece can stand behind the piece that ends where it starts. Two neighbouring pieces can
stand if no merge across their border would have come before the merges that made them. Characters without a piece
become byte pieces.

The result is that of the library for models of type BPE with identity normalisation, a dummy prefix and byte fallback,
which Vocabulary checks.
"""

from __future__ import annotations

import codecs
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, by_bytes, map_arrow, strings
from .suffixes import sorted_suffixes
from .token_counts import INNER_MARK, MARK

PACK, BITS = 4, 15
#: Marks with what follows, and what follows a newline.
PART = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
START, UNKNOWN = -1, -2
NEVER = 1 << 40
#: Levels of fewer positions than FEW are relaxed one by one, if there are MANY_LEVELS of them.
FEW, MANY_LEVELS = 8, 64
#: Characters of pre-tokens that are solved at once; a longer one is solved alone.
SOLVED_CHARS = 250_000
CACHE_ENTRIES, CACHED_LENGTH, PART_BYTES = 150_000, 64, 3 << 20
SCHEMA = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"

codecs.register_error("loomdex.bytes", lambda e: ("�" * (e.end - e.start), e.end))


def best_merges(piece: str, rank: dict[str, int]) -> list[str]:
    """The two parts that byte-pair encoding merges last into the piece, or what else it ends with."""
    parts = list(piece)
    while len(parts) > 2 or len(parts) == 2 and "".join(parts) != piece:
        options = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank and a + b != piece]
        if not options:
            break
        _, i = min(options)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Vocabulary:
    """Tables of a model: pieces that encoding can reach, their ranks and last merges, and all pairs that merge."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.size = n
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in plain}
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        rank = {names[i]: k for k, i in enumerate(order)}
        ids = {x: i for i, x in names.items()}
        if sp.encode("ﬁ  x", out_type=str)[:2] == [MARK, "f"] or sp.decode(sp.encode("  x")) != "  x" or any(INNER_MARK.search(x) or "\n" in x for x in names.values()):
            raise ValueError("not a BPE model with identity normalisation whose pieces hold marks in front only, and no newlines")
        self.born = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        reached = []
        for i, x in names.items():
            if len(x) == 1:
                reached.append(i)
                continue
            parts = best_merges(x, rank)
            if len(parts) == 2 and all(p in ids and (len(p) == 1 or rank[p] < rank[x]) for p in parts):
                self.left[i], self.right[i], self.born[i] = ids[parts[0]], ids[parts[1]], rank[x]
                reached.append(i)
        self.reached = np.array(sorted(reached), np.int64)
        pairs = {(ids[x[:k]], ids[x[k:]]): rank[x] for x in names.values() for k in range(1, len(x)) if x[:k] in ids and x[k:] in ids}
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[by], NEVER), np.append(np.array(list(pairs.values()), np.int64)[by], NEVER)
        letters = sorted({c for x in names.values() for c in x})
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.zeros(len(letters) + 1, bool)
        self.single[[self.letter[ord(names[i])] for i in plain if len(names[i]) == 1]] = True
        self.lengths = np.array([len(names[i]) for i in self.reached], np.int64)
        self.longest = int(self.lengths.max())
        blocks = -(-self.longest // PACK)
        codes = np.zeros((len(self.reached), blocks * PACK), np.int64)
        for row, i in enumerate(self.reached):
            codes[row, : len(names[i])] = [self.letter[ord(c)] for c in names[i]]
        self.packed = pack(codes.reshape(-1, blocks, PACK).transpose(2, 0, 1))
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.text = [names[i].replace(MARK, " ").encode() if i in names else b"" for i in range(n)]
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.text[sp.unk_id()] = " ⁇ ".encode()

    def stands(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether byte-pair encoding leaves the pieces x and y side by side.

        Merges inside both are undone from the last to the first. At each time, the pieces at the border could merge
        across it if that merge ranks before the next one that takes either away; of like merges the left one is first.
        """
        ok = np.ones(len(x), bool)
        live = np.arange(len(x))
        end_x, end_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while len(live):
            key = x * self.size + y
            at = np.searchsorted(self.pair_keys, key)
            merge = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            crosses = (merge < end_x) & (merge <= end_y) & (merge < NEVER)
            ok[live[crosses]] = False
            bx, by = self.born[x], self.born[y]
            on = ~crosses & ((bx >= 0) | (by >= 0))
            live, x, y, end_x, end_y, bx, by = (v[on] for v in (live, x, y, end_x, end_y, bx, by))
            undo = bx > by
            end_x, end_y = np.where(undo, bx, end_x), np.where(undo, end_y, by)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok


    def stands_one(self, x: int, y: int) -> bool:
        """stands() of one pair."""
        born, left, right, ranks = self.plain_tables
        end_x = end_y = NEVER
        while True:
            merge = ranks.get(x * self.size + y, NEVER)
            if merge < end_x and merge <= end_y and merge < NEVER:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if bx > by:
                end_x, x = bx, right[x]
            else:
                end_y, y = by, left[y]

    @cached_property
    def plain_tables(self) -> tuple[list[int], list[int], list[int], dict[int, int]]:
        return self.born.tolist(), self.left.tolist(), self.right.tolist(), dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))


def pack(columns) -> np.ndarray:
    """One number of PACK symbols."""
    out = np.zeros_like(columns[0])
    for c in columns:
        out = (out << BITS) | c
    return out


def bisect(keys: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray) -> np.ndarray:
    """First place in each range of sorted keys whose key is not below the target."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        below = open_ & (keys[np.minimum(middle, len(keys) - 1)] < target)
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def occurrences(text: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(start, row of the piece) of every occurrence of every piece in a text of symbols, with zeros behind it."""
    n = len(text) - vocabulary.longest - PACK
    cut = text[:-PACK].copy()
    packed, alive = cut.copy(), cut != 0
    for k in range(1, PACK):
        nxt = text[k : len(text) - PACK + k]
        alive = alive & (nxt != 0)
        packed = (packed << BITS) | np.where(alive, nxt, 0)
    suffixes = sorted_suffixes(packed, PACK, vocabulary.longest)
    suffixes = suffixes[suffixes < n]
    low, high = np.zeros(len(vocabulary.reached), np.int64), np.full(len(vocabulary.reached), len(suffixes), np.int64)
    for b in range(vocabulary.packed.shape[1]):
        own = np.flatnonzero(vocabulary.lengths > b * PACK)
        keys = packed[suffixes + b * PACK]
        target = vocabulary.packed[own, b]
        width = np.minimum(vocabulary.lengths[own] - b * PACK, PACK)
        upto = target + (np.int64(1) << (BITS * (PACK - width)))
        lo, hi = low[own], high[own]
        low[own], high[own] = bisect(keys, lo, hi, target), bisect(keys, lo, hi, upto)
    size = high - low
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    return suffixes[at], row


def parts_of(text: str) -> list[str]:
    """Pre-tokens: without their first mark, or from a newline on. Nothing merges across a newline, which no piece holds."""
    if "  " in text or text.startswith(" ") or MARK in text:
        return [x[1:] if x[0] == MARK else x for x in PART.findall(MARK + text.replace(" ", MARK))]
    return text.replace("\n", " \n").split(" ")


class Codec:
    """Encodes and decodes texts; keeps the ids of pre-tokens as bytes of int32."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def solve(self, segments: list[str]) -> list[bytes]:
        """Ids of each of some distinct pre-tokens."""
        v = self.v
        segments = [x if x[:1] == "\n" else MARK + x for x in segments]
        sizes = np.array([len(x) for x in segments], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        joined = "\0".join(segments) + "\0" * (1 + v.longest + 2 * PACK)
        letters = v.letter[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        n = int(first[-1] + sizes[-1])
        start, row = occurrences(letters, v)
        end = start + v.lengths[row]
        # Edges by where they end, the longest first.
        by = np.argsort(end * 64 - v.lengths[row])
        start, end, piece = start[by], end[by], v.reached[row[by]]
        reach = np.searchsorted(end, np.arange(n + 2))
        last, back = np.full(n + 1, START, np.int64), np.zeros(n + 1, np.int64)
        inside = np.ones(n + 1, bool)
        inside[first] = False
        unknown = np.zeros(n + 1, bool)
        unknown[1:] = ~v.single[letters[:n]]
        unknown &= inside
        last[unknown], back[unknown] = UNKNOWN, 1
        ends = np.flatnonzero(inside & ~unknown)
        # No piece spans a forced border, so nothing merges across it, and what follows does not depend on what ends there.
        spanned = np.cumsum(np.bincount(start + 1, minlength=n + 2) - np.bincount(end, minlength=n + 2))[: n + 1]
        border = spanned == 0
        border[first] = True
        before = np.append(0, np.maximum.accumulate(np.where(border, np.arange(n + 1), 0))[:-1])
        level = ends - before[ends]
        order = np.argsort(level, kind="stable")
        ends, level = ends[order], level[order]
        steps = np.flatnonzero(np.append(True, level[1:] != level[:-1])) if len(ends) else np.zeros(0, np.int64)
        widths = np.diff(np.append(steps, len(ends)))
        deep = int(np.argmax(np.append(widths, 0) < FEW))
        if len(steps) - deep < MANY_LEVELS:
            deep = len(steps)
        for lo, w in zip(steps[:deep], widths[:deep], strict=True):
            self.relax(ends[lo : lo + w], start, piece, reach, last, back)
        if deep < len(steps):
            self.relax_one_by_one(ends[steps[deep] :], start, piece, reach, last, back)
        at, found_at, found = first + sizes, [], []
        of = np.arange(len(segments))
        while len(of) >= FEW:
            live = at > first[of]
            of, at = of[live], at[live]
            found_at.append(at)
            found.append(last[at])
            at = at - back[at]
        steps_back, pieces = (back.tolist(), last.tolist()) if len(of) else ([], [])
        for i, p in zip(of.tolist(), at.tolist(), strict=True):
            own = []
            while p > first[i]:
                own.append(p)
                p -= steps_back[p]
            found_at.append(np.array(own, np.int64))
            found.append(np.array([pieces[p] for p in own], np.int64))
        place, ids = np.concatenate(found_at), np.concatenate(found)
        by = np.argsort(place)
        place, ids = place[by], ids[by]
        plain = np.where(ids >= 0, ids, 0).astype(np.int32)
        cuts = np.searchsorted(place, np.append(first, n + 1), "right")
        out = [plain[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.unique(np.searchsorted(first, place[ids == UNKNOWN], "left") - 1):
            parts = [v.byte[np.frombuffer(joined[p - 1].encode("utf-8", "surrogatepass"), np.uint8)] if t == UNKNOWN else np.array([t], np.int32) for p, t in zip(place[cuts[i] : cuts[i + 1]], ids[cuts[i] : cuts[i + 1]], strict=True)]
            out[i] = np.concatenate(parts).astype(np.int32).tobytes()
        return out

    def relax(self, ends: np.ndarray, start: np.ndarray, piece: np.ndarray, reach: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """Sets the last piece of the prefixes that end at some positions, of which none starts another's edge."""
        edge, limit = reach[ends], reach[ends + 1]
        while len(ends):
            if (edge >= limit).any():
                raise AssertionError("a prefix without an encoding")
            x, y = last[start[edge]], piece[edge]
            good = x < 0
            good[~good] = self.v.stands(x[~good], y[~good])
            last[ends[good]] = y[good]
            back[ends[good]] = ends[good] - start[edge[good]]
            ends, edge, limit = ends[~good], edge[~good] + 1, limit[~good]

    def relax_one_by_one(self, ends: np.ndarray, start: np.ndarray, piece: np.ndarray, reach: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """The same for the positions of few long runs, in order."""
        begins, pieces, at, known = start.tolist(), piece.tolist(), reach.tolist(), last.tolist()
        for p in ends.tolist():
            for edge in range(at[p], at[p + 1]):
                s, y = begins[edge], pieces[edge]
                if known[s] < 0 or self.pair_stands(known[s], y):
                    known[p] = y
                    back[p] = p - s
                    break
            else:
                raise AssertionError("a prefix without an encoding")
        last[:] = known

    def pair_stands(self, x: int, y: int) -> bool:
        """Vocabulary.stands() of one pair, remembered."""
        key = x * self.v.size + y
        if (out := self.pairs.get(key)) is None:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            out = self.pairs[key] = self.v.stands_one(x, y)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = [parts_of(t) for t in texts if t]
        if len(self.known) > CACHE_ENTRIES:  # keep what this batch needs, which the frequent ones are among
            needed = {x for s in split for x in s}
            self.known = {x: self.known[x] for x in needed if x in self.known}
        fresh = list({x for s in split for x in s if x not in self.known})
        lo = 0
        while lo < len(fresh):
            hi, chars = lo, 0
            while hi < len(fresh) and chars < SOLVED_CHARS:
                chars += len(fresh[hi]) + 2
                hi += 1
            self.known.update(zip(fresh[lo:hi], self.solve(fresh[lo:hi]), strict=True))
            lo = hi
        done = iter([b"".join(map(self.known.__getitem__, s)) for s in split])
        out = [next(done) if t else b"" for t in texts]
        for k in fresh:
            if len(k) > CACHED_LENGTH:
                del self.known[k]
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.v.text.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "loomdex.bytes")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def codec_of(shared) -> Codec:
    """The worker's codec for a broadcast vocabulary: what it has met stays known for the next task."""
    key = hash(shared.value.born.tobytes())
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, round_trip (the ids decode to the text).

    ids are those of the library, without begin or end. Null texts count as empty; these have no ids and decode to the
    empty text. A text that holds U+2581 itself decodes to spaces there. Repeated rows are encoded each; null ids of
    documents stay null. Extra columns are not read.
    """
    with open(model_path, "rb") as f:  # a file of the driver's installation, of a fixed size
        shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))

    def run(batches: Batches) -> Batches:
        codec = codec_of(shared)
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                texts = strings(part.column(1))
                found = codec.encode_batch(texts)
                ids = np.frombuffer(b"".join(found), np.int32)
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                same = [codec.decode(ids[a:b]) == t for a, b, t in zip(offsets[:-1], offsets[1:], texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids. Null or no ids give the empty text; bytes that are no UTF-8 give U+FFFD each."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))

    def run(batches: Batches) -> Batches:
        codec = codec_of(shared)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id long, text string")
