"""Queries over answers: support by evidence, citations, refusals and summaries of evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.operators import evaluation
from loomdex.plans.document_queries import PAIRS_SQL, _pairs, words_sql
from loomdex.plans.registry import query, table

RECORDS_SQL = f"""{PAIRS_SQL}, t AS (SELECT id, reference AS evidence, CASE id % 3 WHEN 0 THEN reference WHEN 1 THEN left(reference, 60) || ' ' || prediction ELSE prediction END || CASE WHEN id % 5 = 0 THEN ' Sorry, I cannot answer.' ELSE '' END AS answer FROM p),
    w AS (SELECT id, {words_sql('answer')} AS a, {words_sql('evidence')} AS e FROM t),
    k AS (SELECT *, greatest(least(4, len(a)), 1) AS n FROM w),
    g AS (SELECT id, a, e, list_distinct([array_to_string(list_slice(a, i, i + n - 1), ' ') FOR i IN range(1, len(a) - n + 2)]) AS x, [array_to_string(list_slice(e, i, i + n - 1), ' ') FOR i IN range(1, len(e) - n + 2)] AS y FROM k),
    c AS (SELECT id, (array_to_string(a, ' ') = array_to_string(e, ' '))::INT::DOUBLE AS exact_match, coalesce(len(list_intersect(x, y)) / nullif(len(x), 0), 0) AS groundedness, (id % 7 <> 0) AS in_domain, (id % 5 = 0) = (id % 7 = 0) AS adheres, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS n_fabricated FROM g)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Answers of known support: the evidence itself, its beginning and more, or another text, some of them refusals, with citations."""
    kind, own = F.col("id") % 3, F.col("reference")
    answer = F.when(kind == 0, own).when(kind == 1, F.concat(F.substring(own, 1, 60), F.lit(" "), "prediction")).otherwise(F.col("prediction"))
    rows = _pairs(spark, d).select("id", own.alias("evidence"), F.concat(answer, F.when(F.col("id") % 5 == 0, " Sorry, I cannot answer.").otherwise("")).alias("answer"))
    cited = F.concat(F.lit("See https://example.com/a, and https://example.com/"), F.when(F.col("id") % 4 == 0, "c").otherwise("b"), F.lit("."))
    refused = T.any_phrase(F.col("answer"), ("i cannot answer",))
    return rows.select(
        "id", evaluation.exact_match(F.col("answer"), F.col("evidence")).alias("exact_match"), evaluation.groundedness(F.col("answer"), F.array("evidence")).alias("groundedness"), (F.col("id") % 7 != 0).alias("in_domain"),
        evaluation.domain_adherence(refused, F.col("id") % 7 == 0).alias("domain_adherence"), F.size(evaluation.fabricated_urls(cited, F.array(F.lit("https://example.com/a"), F.lit("https://example.com/b")))).alias("n_fabricated"),
    )


@query("answer_support", f"WITH {RECORDS_SQL} SELECT id, exact_match, round(groundedness, 6) AS groundedness, round(1 - groundedness, 6) AS hallucination, adheres::INT::DOUBLE AS domain_adherence, n_fabricated FROM c")
def answer_support(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", "exact_match", F.round("groundedness", 6).alias("groundedness"), F.round(1 - F.col("groundedness"), 6).alias("hallucination"), "domain_adherence", "n_fabricated")


@query("generation_summary", f"WITH {RECORDS_SQL} SELECT count(*) FILTER (WHERE in_domain) AS in_domain_count, count(*) FILTER (WHERE NOT in_domain) AS out_of_domain_count, count(*) FILTER (WHERE in_domain AND n_fabricated > 0) AS fabricated_question_count, round(coalesce(avg(adheres::INT) FILTER (WHERE NOT in_domain), 0), 4) AS refusal_accuracy, round(coalesce(avg(exact_match) FILTER (WHERE in_domain), 0), 4) AS exact_match, round(coalesce(avg(groundedness) FILTER (WHERE in_domain), 0), 4) AS groundedness, round(coalesce(avg(adheres::INT) FILTER (WHERE in_domain), 0), 4) AS domain_adherence FROM c")
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.generation_summary(_records(spark, d), ["exact_match", "groundedness", "domain_adherence"])


@query("snippet_containment", f"WITH {PAIRS_SQL}, w AS (SELECT id, {words_sql('left(reference, 40)')} AS a, {words_sql('CASE WHEN id % 2 = 0 THEN reference ELSE prediction END')} AS e FROM p), k AS (SELECT *, greatest(least(3, len(a)), 1) AS n FROM w), g AS (SELECT id, list_distinct([array_to_string(list_slice(a, i, i + n - 1), ' ') FOR i IN range(1, len(a) - n + 2)]) AS x, [array_to_string(list_slice(e, i, i + n - 1), ' ') FOR i IN range(1, len(e) - n + 2)] AS y FROM k) SELECT id, round(coalesce(len(list_intersect(x, y)) / nullif(len(x), 0), 0), 6) AS contained FROM g")
def snippet_containment(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("id") % 2 == 0, F.col("reference")).otherwise(F.col("prediction"))
    return _pairs(spark, d).select("id", F.round(evaluation.containment(F.substring("reference", 1, 40), text, 3), 6).alias("contained"))


@query("condition_deltas", "WITH v AS (SELECT doc_id % 2 AS c, avg(quality) AS quality, avg(toxic) AS toxic FROM labels GROUP BY 1), m AS (SELECT c, 'quality' AS metric, round(quality, 4) AS value FROM v UNION ALL SELECT c, 'toxic', round(toxic, 4) FROM v UNION ALL SELECT 1, 'only_other', 0.5) SELECT metric, max(value) FILTER (WHERE c = 0) AS base, max(value) FILTER (WHERE c = 1) AS other, round(max(value) FILTER (WHERE c = 1) - max(value) FILTER (WHERE c = 0), 4) AS delta FROM m GROUP BY metric")
def condition_deltas(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "labels").groupBy((F.col("doc_id") % 2).alias("c")).agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"), F.max(F.lit(0.5)).alias("only_other"))
    rows = means.unpivot("c", ["quality", "toxic", "only_other"], "metric", "value")
    return evaluation.deltas(rows.where("c = 0 and metric != 'only_other'"), rows.where("c = 1"))
