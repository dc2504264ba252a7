"""Queries over vectors: search, lanes, ranking, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import vectors as V
from loomdex.operators import evaluation, retrieval
from loomdex.plans.registry import query, table

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
ONE = f"SELECT e.vec_id, e.label, {COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
FROM_ALL = f"SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS s, e.label, q.label AS own FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id"


def first_vector(emb: DataFrame) -> list[float]:
    return emb.where("vec_id = 0").select("embedding").head()[0]


@query("vector_topk", f"SELECT vec_id, round(s, 6) AS similarity FROM ({ONE}) ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    return retrieval.nearest(emb, first_vector(emb), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vector_topk_filtered", f"SELECT vec_id, label, round(s, 6) AS similarity FROM ({ONE}) WHERE label IN (1, 3) ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    return retrieval.nearest(emb, first_vector(emb), 10, where=F.col("label").isin(1, 3)).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("vector_topk_per_label", f"SELECT label, vec_id, round(s, 6) AS similarity FROM ({ONE}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= 3")
def vector_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    emb = table(spark, d, "embeddings")
    q = F.array(*(F.lit(float(x)) for x in first_vector(emb)))
    s = emb.select("label", "vec_id", V.cosine(F.col("embedding"), q).alias("s"))
    return s.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))).where("n <= 3").select("label", "vec_id", F.round("s", 6).alias("similarity"))


def _from_all(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    emb = table(spark, d, "embeddings")
    return retrieval.nearest_to_each(emb, emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k)


@query("vector_multi_query_topk", f"SELECT query_id, id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM ({FROM_ALL}) QUALIFY rank <= 10")
def vector_multi_query_topk(spark: SparkSession, d: str) -> DataFrame:
    return _from_all(spark, d).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("vector_checks", "SELECT vec_id, len(embedding) = 64 AND list_max([abs(x) FOR x IN embedding]) > 0 AS ok, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.valid(F.col("embedding"), 64).alias("ok"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("lane_merge_max", f"WITH s AS ({ONE}), a AS (SELECT vec_id AS id, s, 0 AS lane FROM s WHERE label <= 5), b AS (SELECT vec_id AS id, s * 1.0 AS s, 1 AS lane FROM s WHERE label >= 4) SELECT id, round(s, 6) AS similarity, lane FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, lane) = 1")
def lane_merge_max(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    q = F.array(*(F.lit(float(x)) for x in first_vector(emb)))
    s = emb.select(F.col("vec_id").alias("id"), V.cosine(F.col("embedding"), q).alias("similarity"), "label")
    lane = lambda cond, n: s.where(cond).select("id", "similarity", F.lit(n).alias("lane"))
    return retrieval.merge_lanes([lane("label <= 5", 0), lane("label >= 4", 1)]).select("id", F.round("similarity", 6).alias("similarity"), "lane")


@query("relevance_score", f"SELECT vec_id, round(greatest(-1, least(1, s + CASE WHEN label = 0 THEN 0.1 ELSE 0 END - CASE WHEN label = 1 THEN 0.5 ELSE 0 END)), 6) AS relevance, CASE WHEN s >= 0.85 THEN 'high' WHEN s >= 0.72 THEN 'medium' ELSE 'low' END AS confidence FROM ({ONE})")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    s = emb.select("vec_id", "label", V.cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in first_vector(emb)))).alias("s"))
    bonus = F.when(F.col("label") == 0, 0.1).otherwise(0.0)
    mismatch = F.when(F.col("label") == 1, -0.5).otherwise(0.0)
    return s.select("vec_id", F.round(V.relevance(F.col("s"), bonus, mismatch), 6).alias("relevance"), V.confidence(F.col("s")).alias("confidence"))


@query(
    "authority_ranked",
    """SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN extraction = 'success' THEN 0 ELSE 1 END, CASE currency WHEN 'current_date_sensitive' THEN 0 WHEN 'stable_reference' THEN 1 WHEN 'uncertain' THEN 2 WHEN 'historical' THEN 3 ELSE 4 END, n_chars DESC, doc_id) AS place
    FROM (SELECT doc_id, n_chars, CASE WHEN quality = 1 THEN 'success' WHEN quality = 0 THEN 'partial' END AS extraction, CASE doc_id % 4 WHEN 0 THEN 'current_date_sensitive' WHEN 1 THEN 'stable_reference' WHEN 2 THEN 'historical' ELSE 'uncertain' END AS currency FROM documents LEFT JOIN labels USING (doc_id)) ORDER BY place LIMIT 100""",
)
def authority_ranked(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select("doc_id", "n_chars", F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "partial").alias("extraction"), F.element_at(F.array(*map(F.lit, ("current_date_sensitive", "stable_reference", "historical", "uncertain"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("currency"))
    keys = [*retrieval.authority_order(F.col("extraction"), F.col("currency")), F.desc("n_chars"), F.col("doc_id")]
    top = rows.orderBy(*keys).limit(100)  # a top-k report: the places of its rows are found among these alone
    return top.select("doc_id", F.row_number().over(Window.orderBy(*keys)).alias("place"))


@query(
    "eligible_documents",
    """SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND doc_id % 4 IN (0, 1)""",
)
def eligible_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    rows = rows.select("doc_id", F.when(F.col("quality") == 1, "success").otherwise("partial").alias("extraction_status"), (F.col("toxic") == 1).alias("manual_review"), F.element_at(F.array(*map(F.lit, ("current_date_sensitive", "stable_reference", "historical", "uncertain"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("currency_status"))
    return retrieval.eligible(rows).select("doc_id")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    queries = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return retrieval.class_metrics(_from_all(spark, d), emb.select(F.col("vec_id").alias("id"), "label"), queries).join(queries, "query_id")


METRICS_SQL = f"""r AS (SELECT query_id, id, (label = own)::INT AS hit, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, own FROM ({FROM_ALL}) QUALIFY rank <= 10),
    f AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM r),
    g AS (SELECT q.vec_id AS query_id, count(e.vec_id) AS gold, any_value(q.label) AS label FROM embeddings q LEFT JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id),
    m AS (SELECT g.query_id, g.label, coalesce(1.0 / min(rank) FILTER (WHERE hit = 1), 0) AS rr, sum(CASE WHEN hit = 1 THEN found / rank ELSE 0 END) / any_value(gold) AS ap, sum(hit) / any_value(gold) AS recall_10, sum(hit) FILTER (WHERE rank <= 5) / 5 AS precision_5 FROM g JOIN f USING (query_id) WHERE gold > 0 GROUP BY ALL)"""


@query("knn_recall_at_k", f"WITH {METRICS_SQL} SELECT query_id, round(rr, 6) AS reciprocal_rank, round(ap, 6) AS average_precision, round(recall_10, 6) AS recall_10, round(precision_5, 6) AS precision_5 FROM m")
def knn_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", *(F.round(c, 6).alias(c) for c in ("reciprocal_rank", "average_precision", "recall_10", "precision_5")))


@query("metric_grouping_sets", f"WITH {METRICS_SQL} SELECT label, count(*) AS n, round(avg(round(rr, 6)), 4) AS reciprocal_rank, round(avg(round(recall_10, 6)), 4) AS recall_10 FROM m GROUP BY GROUPING SETS ((), (label))")
def metric_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).select("label", *(F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall_10")))
    return evaluation.summarise(m, ["reciprocal_rank", "recall_10"], "label")


@query("greedy_select")
def greedy_select(spark: SparkSession, d: str) -> DataFrame:
    found = _from_all(spark, d, 20)
    rows = found.select("query_id", "rank", "id", F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.sha2((F.col("id") % 17).cast("string"), 256).alias("content_hash"), F.array((F.col("id") % 5).cast("string"), (F.col("id") % 7).cast("string"), F.col("id").cast("string")).alias("words"))
    return retrieval.select_diverse(rows, 5, 2)
