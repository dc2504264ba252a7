"""Queries over record columns: checks, fees, retries, tables of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import records as R
from loomdex.functions import text as T
from loomdex.operators import catalog, chunking, documents, incremental
from loomdex.plans.registry import query, table


@query("fee_format", "SELECT p_partkey, format('{:,}', (p_retailprice * 100)::BIGINT) AS fee FROM part")
def fee_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", R.fee((F.col("p_retailprice") * 100).cast("decimal(20,0)").cast("string")).alias("fee"))


@query("retry_delays", "SELECT event_id, least(30.0, greatest(0.5 * pow(2.0, event_id % 8), CASE WHEN event_type = 'error' THEN 12.0 ELSE 0.0 END)) AS delay, (event_id % 600) IN (408, 425) OR (event_id % 600) BETWEEN 500 AND 599 AS again FROM events")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", R.retry_delay(F.col("event_id") % 8, 0.5, F.when(F.col("event_type") == "error", 12.0)).alias("delay"), R.retryable(F.col("event_id") % 600).alias("again"))


@query("table_acceptance", "SELECT doc_id, len(cells) AS n_rows, len(cells) >= 2 AND len([x FOR x IN cells IF len(x) <> len(cells[1])]) = 0 AND len(cells[1]) >= 2 AND len([x FOR x IN cells[1] IF trim(x) = '']) = 0 AND len([x FOR x IN cells IF len([c FOR c IN x IF trim(c) <> '']) < 2]) = 0 AS reliable FROM (SELECT doc_id, [string_split(x, ' | ') FOR x IN string_split(text, chr(10))] AS cells FROM documents WHERE contains(text, ' | '))")
def table_acceptance(spark: SparkSession, d: str) -> DataFrame:
    cells = F.transform(F.split("text", "\n"), lambda x: F.split(x, r" \| "))
    rows = table(spark, d, "documents").where(F.contains("text", F.lit(" | "))).select("doc_id", cells.alias("cells"))
    return rows.select("doc_id", F.size("cells").alias("n_rows"), R.reliable_table(F.col("cells")).alias("reliable"))


@query(
    "record_errors",
    "SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN length(trim(text)) >= 200 THEN NULL ELSE 'long_enough' END, CASE WHEN lang IN ('en', 'de', 'fr') THEN NULL ELSE 'language' END, CASE WHEN n_chars = length(text) THEN NULL ELSE 'length' END, CASE WHEN quality IS NOT NULL THEN NULL ELSE 'labelled' END] IF x IS NOT NULL], ',') AS errors FROM documents LEFT JOIN labels USING (doc_id)",
)
def record_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    found = R.errors(long_enough=F.length(F.trim("text")) >= 200, language=F.col("lang").isin("en", "de", "fr"), length=F.col("n_chars") == F.length("text"), labelled=F.col("quality").isNotNull())
    return rows.select("doc_id", F.array_join(found, ",").alias("errors"))


@query("url_safety", r"SELECT page_id, regexp_full_match(url, 'https?://[^/@?#\x00-\x20]+([/?#][^\x00-\x1f]*)?') AS safe, CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN page_id % 2 = 1 THEN 'rendered' ELSE 'static' END AS method FROM pages")
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_url(F.col("url")).alias("safe"), R.fetch_method(F.col("url"), F.col("page_id") % 2 == 1).alias("method"))


@query("record_keys", "SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'item') || '-' || left(sha256(source || chr(0) || 'https://example.com/' || doc_id::VARCHAR), 16) AS document_key, sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(lang, chr(0)), coalesce(source, chr(0)))) AS row_hash FROM documents")
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.document_key(F.col("source"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))).alias("document_key"), incremental.row_hash("doc_id", "lang", "source").alias("row_hash"))


@query("question_forms", r"SELECT conv_id, turn, regexp_replace(trim(lower('  ' || text || ' ?  ')), '\s+', ' ', 'g') AS form, contains(' ' || lower(text) || ' ', ' the ') AS holds FROM conversations")
def question_forms(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.question_form(F.concat(F.lit("  "), text, F.lit(" ?  "))).alias("form"), T.holds_phrase(F.lower(text), F.lit("the")).alias("holds"))


@query("header_policy", "SELECT event_id, 'content-type,etag' AS allowed, event_id % 3 = 0 AS prohibited FROM events")
def header_policy(spark: SparkSession, d: str) -> DataFrame:
    third = F.when(F.col("event_id") % 3 == 0, "Set-Cookie").otherwise("X-Other")
    rows = table(spark, d, "events").select("event_id", F.map_from_arrays(F.array(F.lit("Content-Type"), third, F.lit("ETag")), F.array(F.col("event_type"), F.lit("x"), F.lit("y"))).alias("h"))
    return rows.select("event_id", F.array_join(F.array_sort(F.map_keys(R.allowed_headers(F.col("h"), ("etag", "content-type")))), ",").alias("allowed"), R.has_prohibited_header(F.col("h"), ("set-cookie", "authorization")).alias("prohibited"))


CELLS_SQL = """c AS (SELECT doc_id, [list_concat(list_concat(['', ' '], string_split(x, ' | ')), CASE WHEN length(x) % 2 = 0 THEN [''] ELSE [] END) FOR x IN list_concat(string_split(text, chr(10)), ['', '  |  '])] AS cells FROM documents WHERE contains(text, ' | ')),
    p AS (SELECT doc_id, [[trim(regexp_replace(coalesce(x[i], ''), '\\s+', ' ', 'g')) FOR i IN range(1, list_max([len(y) FOR y IN cells]) + 1)] FOR x IN cells] AS cells FROM c),
    k AS (SELECT doc_id, [x FOR x IN cells IF len([y FOR y IN x IF y <> '']) > 0] AS cells FROM p),
    m AS (SELECT doc_id, [[x[i] FOR i IN range(1, len(x) + 1) IF len([y FOR y IN cells IF y[i] <> '']) > 0] FOR x IN cells] AS cells FROM k)"""


@query("cell_matrices", f"WITH {CELLS_SQL} SELECT doc_id, array_to_string([array_to_string(x, '|') FOR x IN cells], chr(10)) AS matrix, coalesce(len(cells[1]) BETWEEN 2 AND 12 AND len([y FOR y IN flatten(cells) IF y <> '']) / len(flatten(cells)) >= 0.72 AND len([x FOR x IN cells IF len([y FOR y IN x IF y <> '']) < 2]) = 0, FALSE) AS dense FROM m")
def cell_matrices(spark: SparkSession, d: str) -> DataFrame:
    lines = F.concat(F.split("text", "\n"), F.array(F.lit(""), F.lit("  |  ")))
    row = lambda x: F.concat(F.array(F.lit(""), F.lit(" ")), F.split(x, r" \| "), F.when(F.length(x) % 2 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    rows = table(spark, d, "documents").where(F.contains("text", F.lit(" | "))).select("doc_id", F.transform(lines, row).alias("cells"))
    rows = rows.select("doc_id", R.normal_matrix(F.col("cells")).alias("cells"))
    return rows.select("doc_id", F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "\n").alias("matrix"), R.dense_table(F.col("cells")).alias("dense"))


@query("published_rows", "SELECT doc_id FROM labels WHERE doc_id % 5 <> 4")
def published_rows(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("", "1", "TRUE", "draft"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "labels").where(R.published(status)).select("doc_id")


@query("pdf_bodies", "SELECT doc_id, doc_id % 3 = 0 AS pdf FROM documents")
def pdf_bodies(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.repeat(F.lit("x"), F.when(F.col("doc_id") % 3 == 0, 1019).otherwise(1020).cast("int")), F.lit("%PDF-1.7"), F.col("text")).cast("binary")
    return table(spark, d, "documents").select("doc_id", R.is_pdf(body).alias("pdf"))


@query("manifest_counts", "SELECT o_orderkey, array_to_string([x FOR x IN [CASE WHEN o_orderkey % 4 = 0 THEN 'attempted' END, CASE WHEN o_orderkey % 6 = 0 THEN 'selected' END] IF x IS NOT NULL], ',') AS errors FROM orders")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = R.count_errors(k + 2, k + F.when(k % 4 == 0, 0).otherwise(1), F.lit(1), k + 5, F.when(k % 6 == 0, F.lit(None).cast("int")).otherwise(3))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(found, ",").alias("errors"))


@query("removed_percent", r"SELECT page_id, CASE WHEN length(html) > 0 THEN round(greatest(0, length(html) - length(regexp_replace(html, '<[^>]*>', '', 'g'))) / length(html) * 100, 2) ELSE 0.0 END AS removed FROM pages")
def removed_percent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.removed_percent(F.length("html"), F.length(F.regexp_replace("html", "<[^>]*>", ""))).alias("removed"))


@query("new_content", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 3 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY text")
def new_content(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return incremental.immutable_append(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 != 0"), "digest", "doc_id")


@query("alias_merge", "WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 3 = 0 THEN 'full-' || s_nationkey::VARCHAR WHEN s_nationkey % 3 = 1 THEN 'full-' || s_suppkey::VARCHAR END AS full_id FROM supplier), n AS (SELECT s_nationkey, count(DISTINCT full_id) AS n, min(full_id) AS f FROM s GROUP BY 1) SELECT s_suppkey, CASE WHEN n = 1 THEN f ELSE s_nationkey::VARCHAR END AS canonical FROM s JOIN n USING (s_nationkey)")
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    nation = F.col("s_nationkey").cast("string")
    full = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("full-"), nation)).when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit("full-"), F.col("s_suppkey").cast("string")))
    return catalog.alias_merge(table(spark, d, "supplier").select("s_suppkey", nation.alias("alias"), full.alias("full_id")), "alias", "full_id").select("s_suppkey", "canonical")


@query("registry_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'")
def registry_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.registry_rows(table(spark, d, "orders"), o_orderpriority=[" 1-urgent", "2-High"], o_orderstatus=["f"], o_clerk=[]).select("o_orderkey")


@query("table_row_chunks", "WITH t AS (SELECT doc_id, string_split(string_split(text, chr(10))[1], ' | ') AS h, string_split(text, chr(10))[2:] AS r FROM documents WHERE contains(text, ' | ')), x AS (SELECT doc_id, h, unnest(r) AS line, generate_subscripts(r, 1) - 1 AS row FROM t) SELECT doc_id, row::INT AS row, array_to_string([coalesce(h[i] || ': ', '') || coalesce(string_split(line, ' | ')[i], '') FOR i IN range(1, greatest(len(h), len(string_split(line, ' | '))) + 1)], ' | ') AS text FROM x")
def table_row_chunks(spark: SparkSession, d: str) -> DataFrame:
    lines, cells = F.split("text", "\n"), lambda x: F.split(x, r" \| ")
    rows = table(spark, d, "documents").where(F.contains("text", F.lit(" | "))).select("doc_id", cells(lines[0]).alias("headers"), F.transform(F.slice(lines, F.lit(2), F.size(lines)), cells).alias("rows"))
    return chunking.table_chunks(rows)


LINES_SQL = "l AS (SELECT doc_id, pos - 1 AS pos, CASE WHEN pos % 11 = 4 THEN ' Quick Links ' WHEN pos % 11 = 7 THEN 'contact us' WHEN pos % 13 = 0 THEN 'Copyright 2020' ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("pos") + 1
    line = F.when(at % 11 == 4, " Quick Links ").when(at % 11 == 7, "contact us").when(at % 13 == 0, "Copyright 2020").otherwise(F.col("line"))
    return documents.lines_of(table(spark, d, "documents")).withColumn("line", line)


@query("boilerplate_regions", f"WITH {LINES_SQL}, m AS (SELECT *, coalesce(last_value(CASE lower(trim(line)) WHEN 'quick links' THEN TRUE WHEN 'contact us' THEN FALSE END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS inside FROM l) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM m WHERE NOT inside AND lower(trim(line)) <> 'contact us' AND NOT starts_with(lower(trim(line)), 'copyright') GROUP BY doc_id")
def boilerplate_regions(spark: SparkSession, d: str) -> DataFrame:
    return documents.rejoin(documents.without_boilerplate(_page_lines(spark, d), ("Contact us",), ("copyright",), "Quick Links", "Contact Us"))


@query("headings_carried", f"WITH {LINES_SQL} SELECT doc_id, pos::INT AS pos, last_value(CASE WHEN length(line) < 40 AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM l")
def headings_carried(spark: SparkSession, d: str) -> DataFrame:
    return documents.carry_heading(_page_lines(spark, d), (F.length("line") < 40) & (F.col("line") != "")).select("doc_id", "pos", "heading")


@query("normal_lines", r"""WITH t AS (SELECT doc_id, text || chr(10) || text || chr(13) || chr(10) || 'an exam-' || chr(10) || '  ple' || chr(10) || chr(10) || chr(10) || chr(10) || '▪  point' || chr(10) || '• point' || chr(10) || chr(10) || '• point' || chr(10) AS text FROM documents),
    l AS (SELECT doc_id, [regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[▪◦‣]\s*', '• ') FOR x IN string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '([\pL\pN_])-\n\s*([a-z])', '\1\2', 'g'), chr(10))] AS l FROM t),
    k AS (SELECT doc_id, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF i = 1 OR l[i] = '' OR l[i] <> l[i - 1]], chr(10)) AS text FROM l)
    SELECT doc_id, regexp_replace(regexp_replace(text, '^\n+|\n+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM k""")
def normal_lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit("\n"), "text", F.lit("\r\nan exam-\n  ple\n\n\n\n▪  point\n• point\n\n• point\n"))
    return table(spark, d, "documents").select("doc_id", T.normal_lines(text).alias("text"))
