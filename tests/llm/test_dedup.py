import hashlib

import numpy as np

from loomdex.llm import near_dedup, suffix_dedup
from loomdex.llm.components import components
from loomdex.llm.exact_dedup import drop_exact_duplicates, radix_groups

from .conftest import LONG, ODD, WORDS, frame


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        ids = [x for x in own if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_radix_groups(spark, odd):
    assert sorted(map(tuple, radix_groups(odd).collect()), key=str) == brute_groups(ODD)


def test_radix_groups_of_narrow_digits_and_repeated_rows(spark):
    rows = [(i, "ab" * (i % 5) + "c" * (i % 3)) for i in range(60)] + [(7, "abababab")] * 2
    found = sorted(map(tuple, radix_groups(frame(spark, rows), first=2, widen=1).collect()), key=str)
    assert found == brute_groups(rows)


def test_radix_groups_of_nothing(none):
    assert radix_groups(none).count() == 0


def test_drop_exact_duplicates_keeps_columns(odd):
    left = drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, *_rest in brute_groups(ODD) if _rest[2])


def brute_components(rows):
    shingles = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        shingles[i] = {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, min(1, len(w))))}
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = [i for i, _ in rows if i is not None]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            s, t = shingles[a], shingles[b]
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(shingles[i]), None if i is None else find(i)) for i, _ in rows}


def test_near_duplicates_of_odd_rows(odd):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(odd).collect()}
    assert found == brute_components(ODD)


def test_near_duplicates_of_nothing(none):
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_documents(docs, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == brute_components(list(texts.items()))


def test_near_duplicates_in_a_hot_group(spark):
    """Many variants of one text, around a passage that unlike texts share too: no link is lost."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        words = list(WORDS[:150])
        for k in rng.integers(0, 150, rng.integers(1, 4)):
            words[k] = f"v{i}k{k}"
        if i % 3 == 0:  # the passage only
            words = WORDS[:80] + [f"u{i}n{k}" for k in range(70)]
        rows.append((i, " ".join(words)))
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    truth = {i: c for i, (_, c) in brute_components(rows).items()}
    assert found == truth


def test_near_duplicates_of_pairs_at_the_threshold_in_a_hot_group(spark):
    """Sets of regions of hundreds, most pairs a little below 0.85 and a few of each set at it or above: no link is lost."""
    rng = np.random.default_rng(4)
    rows = []
    for i in rng.permutation(500).tolist():
        words = [f"b{k}" for k in range(1500)]
        for k in rng.choice(1500, 23, replace=False):
            words[k] = f"v{i}k{k}"
        rows.append((i, " ".join(words)))
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)]
    names = {g: k for k, g in enumerate(set().union(*sets))}
    held = np.zeros((len(rows), len(names)), np.float32)
    for k, own in enumerate(sets):
        held[k, [names[g] for g in own]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    label = np.array([i for i, _ in rows])
    for x, y in zip(*np.nonzero(100 * both >= 85 * (size[:, None] + size - both)), strict=True):
        label[label == max(label[x], label[y])] = min(label[x], label[y])
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert 1 < len(set(label)) < len(rows)
    assert found == {i: c for (i, _), c in zip(rows, label.tolist(), strict=True)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)] + [(200, x) for x in range(201, 230)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100} | {x: 200 for x in range(201, 230)}


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone, fresh = bytearray(len(b)), []
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
        assert fresh == []
    return out


def removed(df, **kw):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.summary(suffix_dedup.remove_repeats(df, **kw)).collect()}


def test_remove_repeats_of_odd_rows(odd):
    assert removed(odd) == brute_repeats(ODD)


def test_remove_repeats_of_documents(docs, texts):
    assert removed(docs) == brute_repeats(list(texts.items()))


def test_remove_repeats_within_texts(spark):
    rng = np.random.default_rng(2)
    block = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    p, q = block(130), block(400)
    rows = [(1, p + block(50) + p), (2, q[50:300] + block(20) + p[:99]), (3, block(30) + q + p[1:]), (4, "ab" * 300), (5, "x" + "ab" * 80), (6, q), (7, q)]
    assert removed(frame(spark, rows)) == brute_repeats(rows)


def test_remove_repeats_of_a_passage_in_many_surroundings(spark):
    """A minimizer of thousands of distinct runs, dealt out by runs and by windows."""
    rng = np.random.default_rng(5)
    block = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage, edge = block(180), block(60)
    rows = [(i, block(120) + (edge if i % 3 else "") + passage + block(120)) for i in range(3_000)]
    rows += [(5_000 + i, rows[i][1]) for i in range(0, 3_000, 7)] + [(9_000, passage[:99]), (9_001, passage[40:140] * 2)]
    truth = brute_repeats(rows)
    assert removed(frame(spark, rows)) == truth
    assert removed(frame(spark, rows), hot=50) == truth


def test_remove_repeats_by_windows(docs, texts):
    assert removed(docs, hot=1) == brute_repeats(list(texts.items()))


def test_runs_of_parted_texts(monkeypatch, spark):
    """Texts longer than what is hashed at once."""
    monkeypatch.setattr(suffix_dedup, "STEP", 64)
    data = np.frombuffer(LONG.encode() * 2 + ODD[4][1][:500].encode(), np.uint8)
    at = np.array([0, 0, len(LONG), 2 * len(LONG), len(data), len(data)])
    text, least, digest, start, size, _ = suffix_dedup.runs(data, at)
    windows = sorted((int(t), int(s) + k) for t, s, n in zip(text, start, size, strict=True) for k in range(n - 99))
    assert windows == [(t, s) for t in range(5) for s in range(max(0, at[t + 1] - at[t] - 99))]
    same = {}
    for t, m, d, s, n in zip(text, least, digest, start, size, strict=True):
        same.setdefault(bytes(data[at[t] + s : at[t] + s + n]), set()).add((m, d))
    assert all(len(x) == 1 for x in same.values()) and len({x for v in same.values() for x in v}) == len(same)


def test_remove_repeats_of_nothing(none):
    assert removed(none) == {}


def test_repeated_windows_are_all_sets_of_equal_windows():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (300, 250, 40, 12)]
    of, text, offset = suffix_dedup.repeated_windows(texts, 12)
    found = {}
    for s, t, o in zip(of, text, offset):
        found.setdefault(int(s), set()).add((int(t), int(o)))
    truth = {}
    for t, x in enumerate(texts):
        for o in range(len(x) - 11):
            truth.setdefault(x[o : o + 12], set()).add((t, o))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in truth.values() if len(v) > 1)


def test_long_constant():
    assert len(LONG) > 500
