import zlib

import corpus_pipeline
import __spark_entry__ as entry
from loomdex.llm.quality import score_quality
from loomdex.llm.toxicity import score_toxicity

from .conftest import ODD, SF, frame

LARGE = "/root/testdata/sf0.01"


def accuracy(rows, truth):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity(spark, odd, none):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = score_toxicity(spark.read.parquet(f"{LARGE}/documents.parquet"), labels).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert accuracy(rows, {r.doc_id: r.toxic for r in labels.collect()}) > 0.9
    few = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 1, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, toxic int, quality int")
    assert {r.doc_id: r.predicted for r in score_toxicity(odd, few).collect()} == {i: 0 for i, _ in ODD}
    assert score_toxicity(none, few).count() == 0 and score_toxicity(odd, few.limit(0)).count() == len(ODD)


def test_quality(spark, odd, none):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = score_quality(spark.read.parquet(f"{LARGE}/documents.parquet"), labels).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, {r.doc_id: r.quality for r in labels.collect()}) > 0.9
    few = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, quality int")
    assert {r.doc_id: r.predicted for r in score_quality(odd, few).collect()} == {i: 1 for i, _ in ODD}
    assert score_quality(none, few).count() == 0


def test_quality_of_all_odd_rows_with_a_model(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = frame(spark, [(i if i is None else 10_000 + i, t) for i, t in ODD]).select("doc_id", "text")
    rows = score_quality(base.unionByName(odd), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(rows) == 200 + len(ODD) and all(0 <= r.score <= 1 for r in rows)


def test_pipeline(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = None
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert ids == good
        elif name == "exact_dedup":
            assert ids == set({texts[i]: i for i in sorted(kept)}.values())
        else:
            assert ids <= kept
        kept = ids
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == kept and all(r.round_trip for r in last)


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
