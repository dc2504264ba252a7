"""Queries over relational tables and events: snapshots, rules, catalogs, streams and general SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.operators import catalog, incremental, rules
from loomdex.plans.registry import query, table
from loomdex.streaming import events as streams

OLD_SQL = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3"
NEW_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 5"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two derived snapshots of orders, as the last and the next state."""
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 10 != 3").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 10 != 5").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return old, new


@query("change_summary", f"SELECT CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_totalprice = n.o_totalprice THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM ({OLD_SQL}) o FULL JOIN ({NEW_SQL}) n USING (o_orderkey) GROUP BY 1")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changes(*_snapshots(spark, d), "o_orderkey", "o_totalprice").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_result", f"SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT * FROM ({NEW_SQL}) UNION ALL SELECT * FROM ({OLD_SQL}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({NEW_SQL})))")
def upsert_result(spark: SparkSession, d: str) -> DataFrame:
    return incremental.upsert(*_snapshots(spark, d), "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("stale_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber % 3 = 0")
def stale_delete(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    incoming = stored.where("l_linenumber % 3 != 0").select("key")
    processed = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    gone = incremental.stale(stored, incoming, processed, "key", "l_orderkey")
    return gone.select(F.split_part("key", F.lit("-"), F.lit(1)).cast("long").alias("l_orderkey"), F.split_part("key", F.lit("-"), F.lit(2)).cast("int").alias("l_linenumber"))


@query("reuse_embeddings", "SELECT needs_embedding, count(*) AS n FROM (SELECT vec_id, label % 2 = 1 OR vec_id % 10 = 0 AS needs_embedding FROM embeddings) GROUP BY 1")
def reuse_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    stored = e.where("vec_id % 10 != 0").select("vec_id", F.col("label").alias("content"), "embedding")
    candidates = e.select("vec_id", F.when(F.col("label") % 2 == 1, F.col("label") + 1000).otherwise(F.col("label")).alias("content"))
    return incremental.reuse(candidates, stored, "vec_id", "content", "embedding").groupBy("needs_embedding").agg(F.count(F.lit(1)).alias("n"))


@query("collapse_guard", "SELECT p_brand, count(*) AS n, count(*) >= greatest(1, ceil(sum(CASE WHEN p_size > 10 THEN 2 ELSE 0 END) * 0.6)) AS ok FROM part GROUP BY p_brand")
def collapse_guard(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("p_size") > 10, 2).otherwise(0)).alias("before"))
    return n.select("p_brand", "n", incremental.collapse_guard(F.col("n"), F.col("before"), 0.6).alias("ok"))


@query("set_mismatch", "SELECT side, count(*) AS n FROM (SELECT 'left' AS side FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'right' FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)) GROUP BY side")
def set_mismatch(spark: SparkSession, d: str) -> DataFrame:
    left, right = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return incremental.set_mismatch(left, right).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    applicants = c.select(F.col("c_custkey").alias("applicant_id"), F.create_map(F.lit("balance"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal").cast("string")), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("n_name")).alias("inputs"))
    rows = [("R1", 1, "numeric_range", "balance", 0.0, None, True, "a balance"), ("R2", 2, "required", "segment", None, None, False, "a segment"), ("R3", 3, "registry", "nation", None, None, False, "a known nation")]
    registered = table(spark, d, "nation").where("n_regionkey != 2").select(F.col("n_name").alias("name"))
    return rules.matches(applicants, spark.createDataFrame(rows, rules.RULE_SCHEMA), registered)


STATUS_SQL = "s AS (SELECT c_custkey AS applicant_id, CASE WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_acctbal >= 0 THEN 'pass' ELSE 'fail' END AS r1, CASE WHEN c_mktsegment IS NULL THEN 'missing' ELSE 'pass' END AS r2, CASE WHEN n_regionkey <> 2 THEN 'pass' ELSE 'fail' END AS r3 FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("rule_matches", f"WITH {STATUS_SQL} SELECT rule_id, status, count(*) AS n FROM (SELECT unnest(['R1', 'R2', 'R3']) AS rule_id, unnest([r1, r2, r3]) AS status FROM s) GROUP BY ALL")
def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("rule_decision", f"WITH {STATUS_SQL} SELECT applicant_id, CASE WHEN r1 = 'fail' THEN 'not_eligible' WHEN r1 = 'missing' OR r2 = 'missing' OR r3 = 'missing' THEN 'insufficient_information' WHEN r2 = 'fail' OR r3 = 'fail' THEN 'insufficient_information' ELSE 'eligible' END AS decision, concat_ws('; ', 'R1: ' || r1, 'R2: ' || r2, 'R3: ' || r3) AS reason FROM s")
def rule_decision(spark: SparkSession, d: str) -> DataFrame:
    return rules.decisions(_found(spark, d))


@query("registry_lookup", "SELECT c_custkey AS key_id, n_nationkey AS entry FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    keys = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("key"))
    registry = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("nation-"), F.col("n_nationkey"))).alias("tags"))
    return rules.registry_lookup(keys, registry).select(F.col("c_custkey").alias("key_id"), F.col("entry").cast("int").alias("entry"))


@query("catalog_dedup_merge", "SELECT lower(p_name) AS name, min(p_partkey) AS first_key, arg_min(p_brand, p_partkey) AS brand, arg_min(CASE WHEN p_size > 20 THEN p_size END, CASE WHEN p_size > 20 THEN p_partkey END) AS size FROM part GROUP BY lower(p_name)")
def catalog_dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_name", "p_partkey", "p_brand", F.when(F.col("p_size") > 20, F.col("p_size")).alias("size"))
    return catalog.merge_by_name(rows, "p_name", "p_partkey", "p_brand", "size").select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("first_key"), F.col("p_brand").alias("brand"), "size")


@query("unique_ids", "SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '-' || regexp_replace(regexp_replace(lower(p_name || p_partkey), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name || p_partkey), p_name || p_partkey) AS n FROM part)")
def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    return catalog.unique_ids(rows, "p_brand", "name").select("p_partkey", "unique_id")


@query("catalog_by_group", "SELECT n_regionkey, count(*) AS n, string_agg(n_name, '|' ORDER BY n_name) AS names FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY n_regionkey")
def catalog_by_group(spark: SparkSession, d: str) -> DataFrame:
    return catalog.by_group(table(spark, d, "nation"), "n_regionkey", "n_name")


@query("program_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')")
def program_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(table(spark, d, "part"), "AN", "p_name", "p_type").select("p_partkey")


@query("majority_value", "WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT c_nationkey, max(n) AS n FROM n GROUP BY c_nationkey) SELECT c_nationkey, CASE WHEN count(*) = 1 THEN max(c_mktsegment) END AS c_mktsegment FROM n JOIN t USING (c_nationkey, n) GROUP BY c_nationkey")
def majority_value(spark: SparkSession, d: str) -> DataFrame:
    return catalog.majority(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return streams.tumbling(_events(spark, d), "1 hour").withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 2)})


@query("event_sliding", "SELECT time_bucket(INTERVAL 30 minute, ts) - k * INTERVAL 30 minute AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return streams.tumbling(_events(spark, d), "1 hour", slide="30 minutes").withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 2)})


@query("event_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 hour THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 hour AS session_end, count(*) AS n FROM s GROUP BY user_id, s")
def event_session(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(_events(spark, d), "2 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 seconds PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("loomdex_events")
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM loomdex_events")


@query("rate_limit_admission")
def rate_limit_admission(spark: SparkSession, d: str) -> DataFrame:
    return streams.rate_limit(_events(spark, d), limit=2, seconds=3600)


@query("event_dedup", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("props_json", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_discount, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


@query("revenue_rollup", "SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    # Totals by customer first: the joins then carry a row for each customer instead of each order.
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = per.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum("total"), 2).alias("total"), F.sum("n").alias("n"))


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("metadata_counts", "SELECT (SELECT count(*) FROM part) AS n_parts, (SELECT count(*) FROM supplier) AS n_suppliers, (SELECT max(o_orderdate) FROM orders) AS last_date")
def metadata_counts(spark: SparkSession, d: str) -> DataFrame:
    for t in ("part", "supplier", "orders"):
        table(spark, d, t).createOrReplaceTempView(f"loomdex_{t}")
    return spark.sql("SELECT (SELECT count(*) FROM loomdex_part) AS n_parts, (SELECT count(*) FROM loomdex_supplier) AS n_suppliers, (SELECT max(o_orderdate) FROM loomdex_orders) AS last_date")
