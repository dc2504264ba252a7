"""Near duplicates by an LSH forest of MinHash signatures.

Each distinct set of shingles gets TREES * DEPTH minima. A tree orders all sets by DEPTH of them; the sets are sorted
once for all trees, by ranges, so however many share a prefix they are dealt out evenly. Neighbours in an order are
candidates while their common prefix is LEAST deep or more. In a region of at most WINDOW + 1 sets those are all that
share it. What stands at the ends of partitions meets in one small task. A dense region, of more sets, is compared as a
whole: all its pairs of different labels, on their full sets, by chunks of bounded size that meet in tasks of their own.

A first round links neighbours and, as a star, the first set of each enclosing region; sets of one component then have
one label, and what has the commonest label of a dense region is compared only with what has another one. A task gives a
forest of the links it finds, so what goes on is linear in the sets however alike they are.

Entries bring BESIDE further minima along, and candidates agree in BESIDE_AGREE of them, so sets that share no more
than a common passage are no candidates. Equal sets are one node, so copies of a text are never compared. Candidates
whose whole signatures agree in a share of AGREE or more are confirmed on their full sets.

A pair of similarity 0.85 shares the first LEAST minima of a tree with probability 0.61, and of at least one of 12 with
more than 0.99998; of further minima it shares too few with probability 0.001 in each tree, independently, and its
whole signatures agree in less than AGREE with probability below 0.0001. Dense regions use neither of these two filters.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded, map_arrow, matched, step, store, strings, without
from .components import components

SHINGLE, PERCENT = 3, 85
TREES, DEPTH, LEAST, WINDOW = 12, 8, 3, 16
FIRST_TREES, FIRST_WINDOW = 2, 2
AGREE = 0.70
#: Minima of other trees that an entry brings along, and how many of them candidates have in common.
BESIDE, BESIDE_AGREE = 16, 9
MIX, A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
FACTORS = (np.random.default_rng(17).integers(1, 1 << 63, TREES * DEPTH, np.uint64) << np.uint64(1)) | np.uint64(1)
KEY = np.dtype(np.uint16)
#: What tells rows apart: the id and two hashes of the text.
KEYS = ["doc_id", "text1", "text2"]
#: A chunk of a dense region has about so many sets, and shingles, at most.
CHUNK, CHUNK_SHINGLES = 1024, 1_000_000
#: Cells of the matrices of a comparison of chunks at a time.
CELLS = 2_000_000


class Shingles(dict):
    """64-bit hashes of words by word, and from them of a document's distinct shingles, sorted."""

    def __init__(self, width: int = SHINGLE, most: int = 200_000):
        super().__init__()
        self.width, self.most = width, most

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, text: str) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        words = text.encode("utf-8", "surrogatepass").lower().split()  # at ASCII white space; lower() takes A to Z only
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(31))) * MIX + h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(29))) * A
        return np.unique(out ^ (out >> np.uint64(32)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each minimum of non-empty sets, by row. Each function is a multiplication and a mixing shift."""
    flat = np.concatenate(sets)
    head = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(FACTORS)), KEY)
    for j, f in enumerate(FACTORS):
        v = flat * f
        least = np.minimum.reduceat(v ^ (v >> np.uint64(31)), head)
        out[:, j] = ((least * B) >> np.uint64(48)).astype(KEY)
    return out


def _sketch(batches: Batches, width: int) -> Batches:
    shingles = Shingles(width)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            sets = [shingles.of(x) for x in strings(part.column("text"))]
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            digest = [hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets]
            sign = [next(rows).astype(">u2").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEYS), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary())], [*KEYS, "n", "digest", "sign"])


def neighbours(key: np.ndarray, tree: np.ndarray, size: np.ndarray, label: np.ndarray, window: int, depths: tuple[int, ...], percent: int = PERCENT) -> np.ndarray:
    """Candidate rows (earlier, later) among sorted rows of minima: near ones, and the first of each region.

    Without depths, regions of more than window + 1 rows are left to dense_links().
    """
    n = len(key)
    if n < 2:
        return np.zeros((2, 0), np.int64)
    key, beside = key[:, :DEPTH], key[:, DEPTH:]
    differs = key[1:] != key[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), key.shape[1])
    common[tree[1:] != tree[:-1]] = 0
    common = np.concatenate([[0], common])  # with the row before
    at = np.arange(n)
    region = np.cumsum(common < LEAST)
    sparse = np.ones(n, bool) if depths else np.bincount(region)[region] <= window + 1
    pairs, shared = [], common.copy()
    for lag in range(1, window + 1):
        if lag > 1:
            shared = np.concatenate([[0], np.minimum(shared[:-1], common[1:])])
        later = at[(shared >= LEAST) & sparse]
        if not (shared >= LEAST).any():
            break
        pairs.append(np.stack([later - lag, later]))
    for d in depths:
        first = np.maximum.accumulate(np.where(common < d, at, 0))
        later = at[first < at]
        pairs.append(np.stack([first[later], later]))
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    good = (label[a] != label[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
    a, b = a[good], b[good]
    good = (beside[a] == beside[b]).sum(axis=1) >= (BESIDE_AGREE if percent >= PERCENT else BESIDE_AGREE - 1)
    return np.unique(np.stack([a[good], b[good]]), axis=1)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").reshape(n, DEPTH + BESIDE).astype(KEY)
    return key, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "rep", "n", "label"))


def candidates(entries: DataFrame, window: int, depths: tuple[int, ...], percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of entries (tree, key, rep, n, label) that are near in an order and have different labels."""
    ordered = entries.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    schema = "a long, b long, tree int, key binary, n long, label long"

    def rows(a, b, tree=None, key=None, n=None, label=None) -> pa.RecordBatch:
        none = lambda x, kind: pa.nulls(len(a), kind) if x is None else pa.array(x, kind)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none(b, pa.int64()), none(tree, pa.int32()), none(key, pa.binary()), none(n, pa.int64()), none(label, pa.int64())], ["a", "b", "tree", "key", "n", "label"])

    def near(batches: Batches, ends: bool) -> Batches:
        """Goes along the order with the rows of a window, and the first of the open regions, carried on."""
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _columns(batch)
            fresh = 0
            if carried is not None:
                fresh = len(carried[1])
                own = tuple(np.concatenate([c, x]) for c, x in zip(carried, own, strict=True))
            key, tree, rep, n, label = own
            a, b = neighbours(key, tree, n, label, window, depths, percent)
            new = b >= fresh
            a, b = rep[a[new]], rep[b[new]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            if pairs.shape[1]:
                yield rows(pairs[0], pairs[1])
            if ends:
                out = range(min(window, len(rep))) if carried is None else ()
                if len(out):
                    yield rows(rep[out], None, tree[out], [key[i].astype(">u2").tobytes() for i in out], n[out], label[out])
            # The heads of the regions that the last row is in, then the window.
            differs = (key[:, :DEPTH] != key[-1, :DEPTH]) | (tree != tree[-1])[:, None]
            common = np.where(differs.any(axis=1), differs.argmax(axis=1), DEPTH)
            heads = {int(np.argmax(common >= d)) for d in depths if common[-1] >= d}
            kept = sorted(heads | set(range(max(0, len(rep) - window), len(rep))))
            carried = tuple(x[kept] for x in own)
        if ends and carried is not None:
            key, tree, rep, n, label = carried
            yield rows(rep, None, tree, [k.astype(">u2").tobytes() for k in key], n, label)

    found = store(map_arrow(ordered.select("tree", "key", "rep", "n", "label"), lambda it: near(it, True), schema))
    inner = found.where("b is not null").select("a", "b")
    # Of each partition some 2 * window rows at most, and each tree's in a task of their own.
    seam = found.where("b is null").select("tree", "key", F.col("a").alias("rep"), "n", "label").distinct().repartition("tree").sortWithinPartitions("tree", "key", "rep")
    between = map_arrow(seam, lambda it: near(it, False), schema).select("a", "b")
    return inner.unionByName(between).distinct()


def sets_of(nodes: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """id and shingles (bytes) of nodes (rep and KEYS), from the text of the row they were made of.

    Nodes are counted: few are broadcast, so no text moves; more are joined by a shuffle.
    """

    def run(batches: Batches) -> Batches:
        shingles = Shingles(width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([shingles.of(x).tobytes() for x in strings(batch.column("text"))], pa.binary())], ["id", "shingles"])

    ids = bounded(nodes.select("rep", *(F.col(k).alias(f"{k}_") for k in KEYS)).distinct())
    own = matched(source, ids, KEYS, "inner")
    return map_arrow(own.select("rep", "text"), run, "id long, shingles binary")


def links(pairs: DataFrame, reps: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """The candidate pairs whose full sets are alike."""
    share = AGREE * percent / PERCENT

    def agree(batches: Batches) -> Batches:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), KEY).reshape(n, -1) for c in ("sign_a", "sign_b"))
            kept = pa.array((x == y).mean(axis=1) >= share) if n else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    def confirm(batches: Batches) -> Batches:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                kept.append(100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("sign").alias(f"sign_{c}"))
    likely = store(map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sign_a", "sign_b"), agree, "a long, b long"))
    ends = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
    sets = sets_of(reps.join(ends, "rep", "left_semi"), source, width)
    first, second = (sets.select(F.col("id").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return map_arrow(likely.join(first, "a").join(second, "b").select("a", "b", "x", "y"), confirm, "a long, b long").distinct()


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Some of the edges (a, b), which connect what all of them do."""
    root: dict[int, int] = {}
    out = []
    for edge in np.unique(np.stack([a, b]), axis=1).T.tolist():
        ends = []
        for x in edge:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            ends.append(x)
        if ends[0] != ends[1]:
            root[max(ends)] = min(ends)
            out.append((edge[0], edge[1]))
    return out


def alike(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets of the left are linked with which of the right (a matrix of bools), by the sizes of all intersections."""
    sizes = [np.array([len(s) for s in x], np.int64) for x in (left, right)]
    words = np.intersect1d(np.concatenate(left), np.concatenate(right))  # what only one side holds is in no intersection
    at = []
    for x, size in zip((left, right), sizes, strict=True):
        flat = np.concatenate(x)
        place = np.searchsorted(words, flat)
        held = np.isin(flat, words)
        row, col = np.repeat(np.arange(len(x)), size)[held], place[held]
        order = np.argsort(col, kind="stable")
        at.append((row[order], col[order]))
    both = np.zeros((len(left), len(right)), np.float32)
    step = max(1, CELLS // max(len(left), len(right)))
    for lo in range(0, len(words), step):
        sides = []
        for (row, col), x in zip(at, (left, right), strict=True):
            i, j = np.searchsorted(col, [lo, lo + step])
            m = np.zeros((len(x), min(step, len(words) - lo)), np.float32)
            m[row[i:j], col[i:j] - lo] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def _compare(group: pa.Table, percent: int) -> pa.Table:
    """A forest of the links of two chunks, or within one, between labels."""
    chunk = group.column("chunk").to_numpy()
    label = group.column("label").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    a = b = np.zeros(0, np.int64)
    if len(left) and len(right):
        linked = alike([sets[k] for k in left], [sets[k] for k in right], percent) & (label[left][:, None] != label[right][None, :])
        x, y = np.nonzero(linked)
        a, b = label[left[x]], label[right[y]]
    edges = forest(np.minimum(a, b), np.maximum(a, b))
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def dense_links(entries: DataFrame, reps: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (a, b) of labels by all pairs of the regions of entries with more than WINDOW + 1 sets; None if there are none.

    Chunks 0, 1, ... hold the sets whose label is not the commonest of their region, and -1, -2, ... those whose label it
    is. Each of the former meets every chunk. A region is
    known by a hash of its tree and prefix; two that share one are compared together, which costs time only.
    """
    own = entries.select(F.xxhash64("tree", F.substring("key", 1, 2 * LEAST)).alias("region"), "rep", "n", "label")
    regions = own.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"))
    regions = store(regions.where((F.col("sets") > WINDOW + 1) & (F.col("low") != F.col("high"))).select("region"))
    if regions.isEmpty():
        return None
    rows = store(own.join(regions, "region"))
    by_label = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"))
    parts = lambda sets, size: F.greatest(F.lit(1), F.ceil(sets / CHUNK), F.ceil(size / CHUNK_SHINGLES)).cast("int")
    most = by_label.groupBy("region").agg(F.max(F.struct("sets", "label", "size")).alias("m"), F.sum("sets").alias("sets"), F.sum("size").alias("size"))
    most = most.select("region", F.col("m.label").alias("common"), parts(F.col("m.sets"), F.col("m.size")).alias("same"), parts(F.col("sets") - F.col("m.sets"), F.col("size") - F.col("m.size")).alias("other"))
    # Rows of one id and text are one document: of one set.
    sets = sets_of(reps.join(rows.select("rep").distinct(), "rep", "left_semi"), source, width).groupBy("id").agg(F.max("shingles").alias("shingles"))
    dealt = rows.join(most, "region").withColumn("chunk", F.when(F.col("label") == F.col("common"), -1 - F.pmod(F.xxhash64("rep"), F.col("same"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("other"))).cast("int"))
    meet = F.when(F.col("chunk") < 0, F.expr("transform(sequence(0, other - 1), x -> struct(x as i, chunk as j))")).otherwise(
        F.expr("concat(transform(sequence(0, other - 1), x -> struct(least(x, chunk) as i, greatest(x, chunk) as j)), transform(sequence(1, same), x -> struct(chunk as i, -x as j)))")
    )
    dealt = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").select("region", "label", "chunk", "shingles", F.inline(meet))
    return store(dealt.groupBy("region", "i", "j").applyInArrow(lambda group: _compare(group, percent), "a long, b long").distinct())


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, nulls: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, reps): rows has KEYS, n and the digest of the set of each row; reps has digest, the KEYS of the row of the
    least id that has that set, and its component, which all sets share that links reach. nulls: null ids link as well,
    ranked last.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text1"), F.xxhash64(F.lit(1), text).alias("text2"), text.alias("text"))
    sketches = store(map_arrow(source, lambda it: _sketch(it, width), "doc_id long, text1 long, text2 long, n long, digest binary, sign binary"))
    some = sketches.where("digest is not null" if nulls else "doc_id is not null and digest is not null")
    reps = some.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), *KEYS, "n", "sign")).alias("r")).select("digest", *(F.col(f"r.{c}").alias(c) for c in (*KEYS, "n", "sign")))
    reps = store(reps.withColumn("rep", F.monotonically_increasing_id()))  # stored, so each use sees the same numbers

    def entries(labels: DataFrame | None, trees: range) -> DataFrame:
        own = reps.select("rep", "n", "sign", F.col("rep").alias("label"))
        if labels is not None:
            own = own.drop("label").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "n", "sign", F.coalesce("component", "rep").alias("label"))
        return own.select("rep", "n", "label", F.explode(F.sequence(F.lit(trees[0]), F.lit(trees[-1]))).alias("tree"), "sign").withColumn("key", F.substring(F.concat("sign", F.substring("sign", 1, 2 * BESIDE)), F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * (DEPTH + BESIDE)))).drop("sign")

    def joined(labels: DataFrame, *more: DataFrame | None) -> DataFrame:
        new = [x for x in more if x is not None]
        return components(reduce(DataFrame.unionByName, new, labels.select(F.col("node").alias("a"), F.col("component").alias("b")))) if new else labels

    near = lambda labels, trees, window, depths: links(candidates(entries(labels, trees), window, depths, percent), reps, source, width, percent)
    dense = lambda labels, trees: dense_links(entries(labels, trees), reps, source, width, percent)
    spark = docs.sparkSession
    first = step(spark, lambda: components(near(None, range(FIRST_TREES), FIRST_WINDOW, (LEAST, DEPTH))))
    # The first tree's dense regions alone leave few labels in hot groups for those of the others.
    second = step(spark, lambda: joined(first, near(first, range(TREES), WINDOW, ()), step(spark, lambda: dense(first, range(1)))))
    labels = step(spark, lambda: joined(second, step(spark, lambda: dense(second, range(1, TREES)))))
    return sketches.select(*KEYS, "n", "digest"), reps.select("rep", "digest", *KEYS).join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Sets are of distinct shingles of `width` words; of fewer words, the whole sequence is one shingle. Documents are linked
    when 100 * intersection >= percent * union (80 at least), and component_id is the least id that links reach. Null and
    empty texts, and such of white space, have no shingles and are linked with nothing. Rows with a null id have a null
    component_id and are kept; they link nothing. Rows that repeat an id are each of their own set. Extra columns are not
    read. An empty table gives no rows.
    """
    rows, reps = classes(docs, id_col, text_col, width, percent, False)
    least = reps.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(reps.select("digest", "component").join(least, "component").drop("component"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, with all its columns, with one row of each component: one of the least id. A null id ranks behind every other.

    Each row is a document of its own, also where ids repeat or are null: rows that share id and text are copies, and any
    one of them stays. Texts without words stay. An empty table stays empty.
    """
    rows, reps = classes(docs, id_col, text_col, width, percent, True)
    kept = reps.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), *KEYS)).alias("m")).select("component", *(F.col(f"m.{k}").alias(f"{k}_") for k in KEYS))
    stays = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in KEYS))
    marked = store(rows.join(reps.select("digest", "component").join(kept, "component"), "digest").select(*KEYS, stays.alias("stays")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({"doc_id__": F.col(id_col).cast("long"), "text1__": F.xxhash64(text), "text2__": F.xxhash64(F.lit(1), text)})
    named = marked.select(*(F.col(k).alias(f"{k}__") for k in KEYS), "stays")
    keys = [f"{k}__" for k in KEYS]
    return without(own, keys, named.where("not stays"), named.where("stays").groupBy(keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")).select(*docs.columns)
