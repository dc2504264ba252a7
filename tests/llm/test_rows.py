"""Stages decide by row: ids may repeat or be null."""

from loomdex.llm.decontamination import decontaminate, find_leaks
from loomdex.llm.exact_dedup import drop_exact_duplicates
from loomdex.llm.near_dedup import drop_near_duplicates
from loomdex.llm.quality import keep_good, score_quality

from .conftest import LONG, WORDS, frame

LARGE = "/root/testdata/sf0.01"
OTHER = " ".join(WORDS[200:])


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_duplicates_by_row(spark):
    rows = [(1, "a"), (2, "a"), (1, "b"), (3, "c"), (3, "c"), (None, "a"), (None, "d"), (None, "d")]
    assert left(drop_exact_duplicates(frame(spark, rows))) == sorted([(2, "a"), (1, "b"), (3, "c"), (None, "d")], key=str)


def test_near_duplicates_by_row(spark):
    rows = [(1, LONG), (2, LONG + " changed"), (2, OTHER), (1, LONG), (None, LONG + " more"), (None, "x y z"), (None, "x y z"), (4, ""), (4, "")]
    assert left(drop_near_duplicates(frame(spark, rows))) == sorted([(1, LONG), (2, OTHER), (None, "x y z"), (4, ""), (4, "")], key=str)


def test_decontamination_by_row(spark):
    first, second = " ".join(WORDS[:9]), " ".join(WORDS[20:30])
    bench = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    both = f"{first} and {second}"
    rows = [(1, f"{first} one"), (1, f"two {second}"), (1, "three"), (2, both), (2, "four"), (None, both), (None, f"{first} five")]
    assert [(i, t.strip()) for i, t in left(decontaminate(frame(spark, rows), bench))] == sorted([(1, "one"), (1, "two"), (1, "three"), (2, "four"), (None, "five")], key=str)


def test_leaks_by_row_for_any_size_of_block(spark):
    """The same rows, with repeated and null ids, however many blocks the benchmark is dealt to."""
    items = [(i, " ".join(WORDS[10 * i : 10 * i + 9])) for i in range(12)]
    bench = spark.createDataFrame([*items, (3, items[4][1]), (None, "a b c")], "item_id long, text string")
    rows = [(1, items[0][1] + " one " + items[1][1]), (1, "two " + items[2][1]), (None, items[3][1]), (None, items[4][1] + " " + items[5][1]), (1, None), (2, "clean"), (2, "clean")]
    found = [sorted(map(tuple, find_leaks(frame(spark, rows), bench, block_bytes=size).collect()), key=str) for size in (1 << 20, 300, 150)]
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    assert sorted(len(r[4]) for r in found[0]) == [0, 0, 0, 1, 1, 2, 3]
    left = [sorted(((r.doc_id, r.text) for r in decontaminate(frame(spark, rows), bench, block_bytes=size).collect()), key=str) for size in (1 << 20, 200)]
    assert left[0] == left[1] and len(left[0]) == 5


def test_quality_by_row(spark):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    bad, good = (texts[f(scores, key=scores.get)] for f in (min, max))
    more = docs.limit(0).unionByName(spark.createDataFrame([(10**9, bad), (10**9, good), (None, bad)], "doc_id long, text string"), allowMissingColumns=True)
    out = left(keep_good(docs.unionByName(more), labels).where(f"doc_id is null or doc_id = {10**9}"))
    assert out == [(10**9, good)]
