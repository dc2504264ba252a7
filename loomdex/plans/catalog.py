"""All registered queries of the engine itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.plans import answer_queries, document_queries, question_queries, record_queries, registry, table_queries, vector_queries  # noqa: F401  they register themselves


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to vector 0 of two categories."""
    return vector_queries.vector_topk_filtered(spark, sf_dir)
