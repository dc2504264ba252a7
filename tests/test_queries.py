"""Each registered query of the engine against its SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomdex.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(con.execute(catalog.oracles()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() == 10


def test_pairs_of_one_small_file_go_to_several_tasks(spark, tmp_path):
    own = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").crossJoin(spark.range(4))
    own.withColumn("conv_id", F.col("conv_id") + 1_000_000 * F.col("id")).drop("id").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalog.queries()["answer_support"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 4 * 2121 and len({r.task for r in rows}) > 2
