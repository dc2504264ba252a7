import datetime as dt
import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomdex.functions import programs as P
from loomdex.functions import questions as Q
from loomdex.functions import records as R
from loomdex.functions import text as T
from loomdex.operators import chunking, documents, evaluation, incremental, retrieval, rules
from loomdex.sources import files
from loomdex.streaming import events


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_text_forms(spark):
    assert values(spark, T.normal_spaces, "a\r\nb  c", "hyphen-\nated", "x\n\n\n\ny") == ["a\nb c", "hyphenated", "x\n\ny"]
    assert values(spark, T.slug, "Über die B.Sc. in CSE!", "", None) == ["ber-die-b-sc-in-cse", "item", "item"]
    assert values(spark, T.canonical_url, "HTTP://Ex.COM:80?b=2&utm_source=x&a=1#f", "https://e.org/p/?ref=1") == ["http://ex.com/?a=1&b=2", "https://e.org/p/"]
    assert values(spark, T.safe_url, "https://a.b/c", "ftp://a", "http://u@h/", None) == [True, False, False, False]
    assert values(spark, T.safe_relative_path, "a/b", "/a", "a/../b", "..") == [True, False, False, False]
    assert values(spark, T.urls_in, "see https://a.b/c, and http://d.e.") == [["https://a.b/c", "http://d.e"]]
    assert values(spark, lambda c: T.shingles(T.token_list(c), 2), "a b c", "a", "") == [["a b", "b c"], ["a"], []]


def test_authority_gate(spark):
    rows = [(1, "current_date_sensitive", "success", False), (2, "stable_reference", "success", False), (3, "historical", "success", False), (4, "uncertain", "success", False), (5, "current_date_sensitive", "success", True), (6, "stable_reference", "partial", False)]
    df = spark.createDataFrame(rows, "id int, currency_status string, extraction_status string, manual_review boolean")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(retrieval.eligible(df)) == [1, 2]
    assert ids(retrieval.eligible(df, historical=True, uncertain=True, manual=True, partial=True)) == [1, 2, 3, 4, 5, 6]


def test_lane_ties_keep_the_first_lane(spark):
    a, b = (spark.createDataFrame([(1, 0.5, x)], "id int, similarity double, lane string") for x in "ab")
    assert retrieval.merge_lanes([a, b]).head().lane == "a"


def test_select_diverse(spark):
    rows = [(1, 1, 10, "s", "h1", ["a", "b"]), (1, 2, 11, "s", "h1", ["c"]), (1, 3, 12, "s", "h2", ["a", "b"]), (1, 4, 13, "s", "h3", ["d"]), (1, 5, 14, "s", "h4", ["e"]), (1, 6, 15, "t", "h5", ["f"])]
    df = spark.createDataFrame(rows, "query_id long, rank int, id long, source string, content_hash string, words array<string>")
    assert [(r.id, r.place) for r in retrieval.select_diverse(df, 3, 2).orderBy("place").collect()] == [(10, 1), (13, 2), (15, 3)]


def test_rouge_known_answers(spark):
    df = spark.createDataFrame([(1, "a b c d", "a x b c d"), (2, "one", "one"), (3, "", "x")], "id long, prediction string, reference string")
    found = {r.id: (r.precision, r.recall) for r in evaluation.longest_common(df).collect()}
    assert found == {1: (1.0, 0.8), 2: (1.0, 1.0), 3: (0.0, 0.0)}
    assert {r.id: r.f1 for r in evaluation.ngram_scores(df, 2).collect()}[2] == 0.0


def test_near_pairs(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "short")], "doc_id long, text string")
    assert [(r.a, r.b) for r in documents.near_pairs(df, 0.9).collect()] == [(1, 3)]
    assert [(r.a, r.b) for r in documents.exact_pairs(df).collect()] == [(1, 2)]


def test_near_pairs_of_unequal_length(spark):
    """85 of the shorter one's 92 shingles are shared; the longer one has 15 of its own, more than its first 9."""
    same = [f"s{i}" for i in range(89)]
    short, long = " ".join(same + [f"a{i}" for i in range(7)]), " ".join(same + [f"b{i}" for i in range(15)])
    for rows in ([(1, short), (2, long)], [(1, long), (2, short)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert [(r.a, r.b, r.overlap) for r in documents.near_pairs(df).collect()] == [(1, 2, round(85 / 92, 6))]


@pytest.mark.parametrize(
    "inputs,rows,decision",
    [
        ({"ssc": "4.0"}, [("r", 1, "numeric_range", "ssc", 3.0, None, True)], "eligible"),
        ({"ssc": "2.5"}, [("r", 1, "numeric_range", "ssc", 3.0, None, True)], "not_eligible"),
        ({"ssc": "2.5"}, [("r", 1, "numeric_range", "ssc", 3.0, None, False)], "insufficient_information"),
        ({}, [("r", 1, "numeric_range", "ssc", 3.0, None, True)], "insufficient_information"),
        ({"ssc": "5.0"}, [("r", 1, "numeric_range", "ssc", 0.0, 5.0, True)], "eligible"),
        ({"ssc": "5.1"}, [("r", 1, "numeric_range", "ssc", 0.0, 5.0, True)], "not_eligible"),
        ({"ssc": "4.0"}, [("r", 1, "numeric_range", "ssc", 3.0, None, True), ("q", 2, "numeric_range", "hsc", 3.0, None, True)], "insufficient_information"),
        ({"ssc": "4.0"}, [("r", 1, "strange", "ssc", None, None, True)], "insufficient_information"),
    ],
)
def test_decisions(spark, inputs, rows, decision):
    applicants = spark.createDataFrame([(1, inputs)], "applicant_id int, inputs map<string,string>")
    table = spark.createDataFrame([(*r, "") for r in rows], rules.RULE_SCHEMA)
    assert rules.decisions(rules.matches(applicants, table)).head().decision == decision


def test_invalid_rules(spark):
    table = spark.createDataFrame([("a", 1, "numeric_range", None, None, None, True, ""), ("b", 2, "odd", "x", None, None, True, ""), ("c", 3, "required", "x", None, None, True, "")], rules.RULE_SCHEMA)
    assert sorted((r.rule_id, r.error) for r in rules.invalid_rules(table).collect()) == [("a", "numeric_range needs a field and a bound"), ("b", "unknown type")]


def test_chunks():
    text = "Fees and Costs\nThe fee is 10. It is paid once.\n- one\n- two\n\nOther Things:\n" + "word " * 400
    found = chunking.chunks_of(text, most=300, overlap=50, least=20)
    assert all(len(c) <= 300 for _, c in found) and found[0][0] == "Fees and Costs" and "- one\n- two" in found[0][1]
    assert chunking.chunks_of("") == []


def test_clean_page():
    html = "<html><title> A &amp; B </title><nav>menu</nav><div class='ad'>buy</div><article><p>Hello <b>there</b></p><a href='/x'>link</a><table><tr><th>P</th><th>F</th></tr><tr><td>1</td><td>2</td></tr></table></article><script>x</script>"
    assert chunking.clean_page(html) == ("A & B", "Hello there\nlink", ["/x"], [[["P", "F"], ["1", "2"]]])


def test_registry(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿source_id, url ,notes\na,http://a,n1\n,,\nb,http://b,\n", encoding="utf-8")
    assert [(r.source_id, r.url, r.extras) for r in files.read_registry(spark, str(path), ["source_id", "url"]).collect()] == [("a", "http://a", {"notes": "n1"}), ("b", "http://b", {"notes": None})]
    path.write_text("source_id,source_id\na,b\n")
    with pytest.raises(files.SourceError):
        files.read_registry(spark, str(path), ["source_id"])
    path.write_text("source_id,url\na,b,c\n")
    with pytest.raises(files.SourceError):
        files.read_registry(spark, str(path), ["source_id"])


def test_manifest(spark, tmp_path):
    root = tmp_path / "records"
    root.mkdir()
    for i in range(3):
        (root / f"{i}.json").write_text(json.dumps({"id": i}))
    digest = lambda i: hashlib.sha256((root / f"{i}.json").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([(0, "2.json", digest(2)), (1, "0.json", digest(0))], "pos int, record_path string, record_file_hash string")
    assert [r.record.id for r in files.read_manifest(spark, str(root), manifest, "id int").collect()] == [2, 0]
    (root / "0.json").write_text("{}")
    with pytest.raises(Exception, match="missing or was changed"):
        files.read_manifest(spark, str(root), manifest, "id int").collect()


def test_publish(spark, tmp_path):
    root = str(tmp_path / "p")
    files.publish(spark.range(3).toDF("id"), root)
    with pytest.raises(files.SourceError):
        files.publish(spark.range(1).toDF("id"), root, at_least=2)
    assert files.read_published(spark, root).count() == 3


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    assert {r.k: r.change for r in incremental.changes(old, new, "k", "v").collect()} == {1: "unchanged", 2: "updated", 3: "removed", 4: "new"}
    assert sorted(map(tuple, incremental.upsert(old, new, "k").collect())) == [(1, "a"), (2, "x"), (3, "c"), (4, "d")]


def test_rate_limit_does_not_record_what_it_rejects(spark):
    assert events.admitted([0, 1, 2, 61, 61.5], [], 2, 60)[0] == [True, True, False, True, True]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 7, start + dt.timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 61, 61.5))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    assert [r.admitted for r in events.rate_limit(df, 2, 60).orderBy("event_id").collect()] == [True, True, False, True, True]


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(minutes=7 * i), "click", 1.0) for i in range(40)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp, event_type string, value double").parquet(source)
    q = events.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("loomdex_t").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert sum(r.n for r in spark.table("loomdex_t").collect()) == 40
    q = events.rate_limit(stream, 2, 3600).writeStream.outputMode("append").format("memory").queryName("loomdex_r").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    batch = {r.event_id: r.admitted for r in events.rate_limit(spark.read.parquet(source), 2, 3600).collect()}
    assert {r.event_id: r.admitted for r in spark.table("loomdex_r").collect()} == batch
    root = str(tmp_path / "snap")
    events.refresh(stream, root, "user_id", str(tmp_path / "c3")).awaitTermination(60)
    assert {r.user_id: r.event_id for r in files.read_published(spark, root).collect()} == {0: 39, 1: 37, 2: 38}
    assert os.path.isdir(root)


def test_longest_common_is_that_of_the_table(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(0, 90))), " ".join(rng.choices("abcdef", k=rng.randrange(0, 90)))) for i in range(60)] + [(60, None, "a"), (61, "a b", "")]

    def table(p, r):
        last = [0] * (len(r) + 1)
        for x in p:
            row = [0]
            for j, y in enumerate(r):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
            last = row
        return last[-1]

    found = {r.id: r for r in evaluation.longest_common(spark.createDataFrame(rows, "id long, prediction string, reference string")).collect()}
    for i, p, r in rows:
        p, r = (p or "").split(), (r or "").split()
        n = table(p, r)
        assert found[i].precision == (n / len(p) if p else 0) and found[i].recall == (n / len(r) if r else 0)


def test_registry_with_a_quoted_header(spark, tmp_path):
    path = tmp_path / "registry.csv"
    path.write_text('﻿id,"name, full",category\n1,"A, B",x\n', encoding="utf-8")
    row = files.read_registry(spark, str(path), ["id"]).head()
    assert row.id == "1" and row.extras == {"name, full": "A, B", "category": "x"}


def test_summary_of_no_answers(spark):
    none = spark.createDataFrame([], "in_domain boolean, domain_adherence double, n_fabricated int, f1 double")
    assert evaluation.generation_summary(none, ["f1"]).head().asDict() == {"in_domain_count": 0, "out_of_domain_count": 0, "fabricated_question_count": 0, "refusal_accuracy": 0.0, "f1": 0.0}
    answers = spark.createDataFrame([("", ["a b"]), ("one two three", []), ("one two", ["x", "zero one two three"]), (None, ["a"])], "a string, e array<string>")
    assert [r[0] for r in answers.select(evaluation.groundedness(F.col("a"), F.col("e"))).collect()] == [0.0, 0.0, 1.0, 0.0]


def test_matrix_of_many_rows(spark):
    """Width and used columns are found once a table, not for each cell of it."""
    small = [["", " a  b ", None], ["", ""], [" "], ["", "c", "", " d"]]
    column = "array<array<string>>"
    found = spark.createDataFrame([(small,), ([],), (None,)], f"c {column}").select(R.normal_matrix(F.col("c"))).collect()
    assert [r[0] for r in found] == [[["a b", ""], ["c", "d"]], [], None]
    tall = spark.createDataFrame([([["", f"x{i}", " ", f"y {i}"] for i in range(3000)],)], f"c {column}")
    began = time.time()
    assert tall.select(R.normal_matrix(F.col("c")).alias("m")).head().m[-1] == ["x2999", "y 2999"]
    assert time.time() - began < 20


def test_lines_of_a_long_text(spark):
    """Lines are made once a text, not for each line of it."""
    lines = [f"line  {i}" for i in range(4000) for _ in range(2)]
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    began = time.time()
    row = df.select(T.normal_lines(F.col("t")).alias("n"), documents.without_repeats(F.col("t")).alias("w"), documents.near_lines(F.col("t"), "  3999").alias("l")).head()
    assert row.n.split("\n") == [f"line {i}" for i in range(4000)] and row.w == lines[::2] and row.l == lines[:1] + lines[-6:]
    assert time.time() - began < 20


def test_groundedness_of_a_long_answer(spark):
    words = [f"w{i}" for i in range(6000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:3000]))], "a string, e string")
    began = time.time()
    row = df.select(evaluation.groundedness(F.col("a"), F.array("e")).alias("g"), evaluation.containment(F.col("a"), F.col("e"), 3).alias("c"), F.size(T.shingles(T.token_list(F.col("a")), 5)).alias("s")).head()
    assert (row.g, row.c, row.s) == (2997 / 5997, 2998 / 5998, 5996)
    assert time.time() - began < 20


def test_groundedness_of_many_answers(spark):
    """Runs of words are looked up by place, not sliced out of the list; shares are those of sets of runs."""
    rng = random.Random(6)
    text = lambda most: " ".join(rng.choices("abc", k=rng.randrange(most)))
    rows = [(i, text(12), [None if rng.random() < 0.1 else text(30) for _ in range(rng.randrange(3))]) for i in range(200)] + [(200, None, ["a"])]
    df = spark.createDataFrame(rows, "i int, a string, e array<string>")
    for n in (1, 3, 4):
        shares = df.select("i", evaluation.groundedness(F.col("a"), F.col("e"), n).alias("g"))
        assert "slice(" not in shares._jdf.queryExecution().optimizedPlan().expressions().mkString()
        found = {r.i: r.g for r in shares.collect()}
        for i, a, e in rows:
            k = min(n, len((a or "").split())) or 1
            own, held = ({tuple(w[j : j + k]) for w in (t.split() for t in texts if t) for j in range(len(w) - k + 1)} for texts in ([a], e))
            assert found[i] == (len(own & held) / len(own) if own else 0)


def evaluations(df, pattern):
    """How often a part of an expression stands in the optimised plan."""
    return df._jdf.queryExecution().optimizedPlan().expressions().mkString("\n").count(pattern)


def test_forms_and_intents_are_made_once_a_question(spark):
    programs = (P.Program("cse", "Computer Science and Engineering", ("computer science", "cse"), "undergraduate"), P.Program("civil", "Civil Engineering", ("civil", "ce"), "undergraduate"))
    df = spark.createDataFrame([("fees of M.Sc. in CSE",), ("the CE & computer science",), (None,)], "q string")
    q = F.col("q")
    named = df.select("q", P.single(P.named_programs(q, programs)).alias("m"))
    assert [r.m for r in named.collect()] == ["cse", "cse", None]
    assert evaluations(named, "master(?:") == 1
    rows = df.select(P.level_matches(q, F.lit("M.Sc in CSE"), F.lit("cse"), programs), P.row_matches(F.lit("CSE (x)"), F.lit("cse"), programs), P.degree_level(q))
    assert [tuple(r) for r in rows.collect()] == [(True, False, "postgraduate"), (False, False, None), (False, False, None)]
    facts = df.select(Q.fact(q, F.lit(None).cast("string")).alias("f"))
    assert [r.f for r in facts.collect()] == ["tuition", None, None]
    assert evaluations(facts, "guarantee") == 1


def test_metrics_by_class_are_those_of_listed_gold(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 2, None])) for i in range(60)] + [(60, 9)]
    classes = spark.createDataFrame(rows, "id long, label int")
    queries = classes.where("id % 5 = 0").select(F.col("id").alias("query_id"), "label")
    found = spark.createDataFrame([(q, i, r + 1) for q in range(0, 61, 5) for r, i in enumerate(rng.sample([x for x in range(61) if x != q], 10))], "query_id long, id long, rank int")
    gold = queries.join(classes, "label").where("query_id != id").select("query_id", "id")
    listed = retrieval.ranking_metrics(found, gold)
    counted = retrieval.class_metrics(found, classes, queries)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.collect()))


def test_nearest_by_tiles(spark):
    """Tiles smaller than the batch, equal vectors (ties go by id) and fewer rows than k."""
    rng = random.Random(4)
    some = [[rng.choice([-1.0, 1.0, 2.0]) for _ in range(3)] for _ in range(12)]
    rows = [(i, some[rng.randrange(12)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    queries = lambda n: df.where(f"vec_id < {n}").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    found = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest_to_each(df, queries(300), 4).collect()}
    for q in range(0, 300, 37):
        best = sorted((i for i, _ in rows if i != q), key=lambda i: (-round(cos(rows[q][1], rows[i][1]), 9), i))[:4]
        assert [found[q, r] for r in (1, 2, 3, 4)] == best
    assert retrieval.nearest_to_each(df.where("vec_id < 3"), queries(3), 4).count() == 6


def test_near_pairs_deal_out_all_shingles_once(spark):
    """And shingles of one set alone, though left out, still take its first places."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (3, text + " more"), (4, " ".join(f"v{i}" for i in range(80)))], "doc_id long, text string")
    pairs = documents.near_pairs(df, 0.9)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 3)]
    aggregates = pairs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate [s#" in x for x in aggregates)  # counted where they are, not joined with a count
