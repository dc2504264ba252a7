"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens, of at most FREQUENT entries. Tier two
is a cache in each Python worker, filled by the tokenizer for what tier one misses. No pre-token is ever
shuffled; texts stay in the partition that read them.

A pre-token is a run of word-boundary marks (U+2581, to which the library turns spaces) with the characters
up to the next run. This cut is exact for vocabularies in which no piece holds a mark behind another
character; the constructor of PretokenLengths checks that and otherwise takes whole texts.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, map_arrow, strings

MARK = "▁"
FREQUENT, SAMPLE_ROWS, SAMPLE_TASKS = 40_000, 2_000, 4
CACHE_ENTRIES, CACHED_LENGTH, LIMIT = 300_000, 64, 4096
INNER_MARK = re.compile(f"[^{MARK}]{MARK}")
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PretokenLengths(dict):
    """Numbers of tokens by pre-token, written without its first mark."""

    def __init__(self, model: bytes, frequent: dict[str, int] | None = None):
        super().__init__(frequent or {})
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.cuts = not any(INNER_MARK.search(x) for x in pieces)
        # A newline in no piece is bytes by itself and parts what stands around it.
        self.newline = not any("\n" in x for x in pieces) and self.sp.encode("\n", out_type=str)[-1:] == ["<0x0A>"]
        self.tails: dict[str, int] = {}
        self.base = frequent or {}
        self[""] = 1

    def __missing__(self, key: str) -> int:
        if self.newline and "\n" in key:
            head, *tails = key.split("\n")
            n = self[head] + len(tails) + sum(self.tail(x) for x in tails if x)
        else:
            n = len(self.sp.encode(key.replace(MARK, " ")))
        if len(key) <= CACHED_LENGTH:
            if len(self) > CACHE_ENTRIES + len(self.base):
                self.clear()
                self.update(self.base)
                self[""] = 1
            self[key] = n
        return n

    def tail(self, key: str) -> int:
        """Of what follows a newline, with no mark of its own."""
        if (n := self.tails.get(key)) is None:
            n = len(self.sp.encode("\n" + key)) - 2
            if len(key) <= CACHED_LENGTH:
                if len(self.tails) > CACHE_ENTRIES:
                    self.tails.clear()
                self.tails[key] = n
        return n

    def pretokens(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked:
            return [x[1:] for x in SEGMENT.findall(marked)]
        return marked[1:].split(MARK)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.sp.encode(text))
        return sum(map(self.__getitem__, self.pretokens(text)))


def frequent_lengths(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, top: int = FREQUENT) -> dict[str, int]:
    """Lengths of at most `top` pre-tokens that are frequent in about `rows` documents, drawn by a hash of their ids.

    The table only saves time: what it lacks is encoded, so counts are the same for any table.
    """
    total = docs.count()
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(max(1, total // max(1, rows)))) == 0
    drawn = docs.where(share).select(F.col(text_col).alias("text")).repartition(SAMPLE_TASKS)

    def tally(batches: Batches) -> Batches:
        own, seen = PretokenLengths(model), Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                seen.update(x for x in own.pretokens(text) if len(x) <= CACHED_LENGTH)
        most = [(x, n) for x, n in seen.most_common(top) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in most], pa.string()), pa.array([n for _, n in most], pa.int64())], ["pretoken", "n"])

    seen: Counter[str] = Counter()
    for row in map_arrow(drawn, tally, "pretoken string, n long").toLocalIterator():
        seen[row.pretoken] += row.n
    own = PretokenLengths(model)
    return {x: own[x] for x, _ in seen.most_common(top)} if own.cuts else {}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    n_tokens is what the library gives for the whole text, without begin or end tokens. Null texts count as
    empty and have no tokens; so have empty ones. Repeated rows are counted each; null ids stay null. Extra
    columns are not read.
    """
    with open(model_path, "rb") as f:  # the model is a file of the driver's installation, and of a fixed size
        model = f.read()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model, frequent_lengths(docs, model, id_col, text_col)))

    def run(batches: Batches) -> Batches:
        lengths = PretokenLengths(*shared.value)
        for batch in batches:
            n = [lengths.count(x) for x in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")), run, SCHEMA)
