"""Queries over documents, pages, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.functions import vectors as V
from loomdex.operators import chunking, documents, evaluation
from loomdex.plans.registry import query, table

WORDS_SQL = "regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9\\x{{80}}-\\x{{FFFF}}]+')"

def words_sql(c: str) -> str:
    return WORDS_SQL.format(c)


@query("doc_statistics", "SELECT count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, count(DISTINCT text) AS n_texts, count(*) FILTER (WHERE length(trim(text)) < 200) AS n_short, round(avg(length(text)), 2) AS mean_chars FROM documents")
def doc_statistics(spark: SparkSession, d: str) -> DataFrame:
    return documents.statistics(table(spark, d, "documents"))


@query("doc_by_lang", "SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, count(DISTINCT text) AS n_texts, count(*) FILTER (WHERE length(trim(text)) < 200) AS n_short, round(avg(length(text)), 2) AS mean_chars FROM documents GROUP BY lang")
def doc_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return documents.statistics(table(spark, d, "documents"), "lang")


@query("doc_exact_duplicates", "SELECT a, b FROM (SELECT doc_id AS b, min(doc_id) OVER (PARTITION BY text) AS a FROM documents) WHERE a <> b")
def doc_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return documents.exact_pairs(table(spark, d, "documents"))


@query("shared_hashes", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text HAVING count(*) > 1")
def shared_hashes(spark: SparkSession, d: str) -> DataFrame:
    return documents.shared_texts(table(spark, d, "documents"))


@query(
    "doc_near_duplicates",
    r"""WITH t AS (SELECT min(doc_id) AS id, regexp_extract_all(lower(text), '[A-Za-z0-9_$%\x{80}-\x{FFFF}]+') AS w FROM documents GROUP BY text),
    s AS (SELECT DISTINCT id, len(w) AS n, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 50)),
    c AS (SELECT id, n, count(*) AS size FROM s GROUP BY id, n),
    p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
    SELECT a, b, round(k / least(x.size, y.size), 6) AS overlap FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b
    WHERE least(x.n, y.n) >= 0.92 * greatest(x.n, y.n) AND round(k / least(x.size, y.size), 6) >= 0.92""",
)
def doc_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return documents.near_pairs(table(spark, d, "documents"))


@query(
    "quality_flag_histogram",
    """SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN length(trim(text)) < 200 THEN 'short' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'manual_review' END, CASE WHEN quality IS NULL THEN 'unlabelled' END]) AS flag
    FROM documents LEFT JOIN labels USING (doc_id)) WHERE flag IS NOT NULL GROUP BY flag""",
)
def quality_flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return documents.flag_histogram(documents.with_flags(joined, short=F.length(F.trim("text")) < 200, low_quality=F.col("quality") == 0, manual_review=F.col("toxic") == 1, unlabelled=F.col("quality").isNull()))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("document_id", "SELECT page_id, 'page-' || left(sha256(concat_ws(chr(31), url, page_id::VARCHAR)), 24) AS record_id FROM pages")
def document_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.record_key("page-", F.col("url"), F.col("page_id")).alias("record_id"))


@query("word_sets", f"SELECT doc_id, len({words_sql('text')}) AS n_words, len(list_distinct([x FOR x IN {words_sql('text')} IF length(x) > 1])) AS n_distinct FROM documents")
def word_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.word_list(F.col("text"))).alias("n_words"), F.size(T.word_set(F.col("text"))).alias("n_distinct"))


@query("slugs", "SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'item') AS slug FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query(
    "url_canonical",
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages),
    p AS (SELECT page_id, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS h, regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)', 1) AS path, regexp_extract(b, '\?(.*)$', 1) AS q FROM u),
    s AS (SELECT *, array_to_string(list_sort([x FOR x IN string_split(q, '&') IF x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('fbclid','gclid','ref','mc_cid','mc_eid') AND NOT starts_with(lower(x), 'utm_')]), '&') AS k FROM p)
    SELECT page_id, regexp_replace(regexp_replace(h, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN coalesce(k, '') = '' THEN '' ELSE '?' || k END AS url FROM s""",
)
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("url_host_counts", r"SELECT host, count(*) AS n, count(*) FILTER (WHERE host = 'example.com' OR ends_with(host, '.example.com')) AS n_allowed FROM (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS host FROM pages) GROUP BY host")
def url_host_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(T.host_allowed(F.col("url"), "example.com")).alias("n_allowed"))


@query("html_title", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("n_links"))


@query("secret_scan", "SELECT doc_id, regexp_matches(text, '(?i)(password|secret|token|api_?key) *[:=] *\"?[A-Za-z0-9+/_.=-]{8,}') AS has_token, regexp_matches(text, '(/Users/|/home/|C:\\\\)') AS has_path FROM documents")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike('(?i)(password|secret|token|api_?key) *[:=] *"?[A-Za-z0-9+/_.=-]{8,}').alias("has_token"), t.rlike(r"(/Users/|/home/|C:\\)").alias("has_path"))


@query("line_dedup", "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE line IS DISTINCT FROM b GROUP BY doc_id")
def line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(documents.without_repeats(F.col("text"))).cast("long").alias("n_lines"))


@query("context_lines", "SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT doc_id, pos, line, max(CASE WHEN contains(line, 'Licen') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE near = 1 OR pos = 1 GROUP BY doc_id")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    near = table(spark, d, "documents").select("doc_id", documents.near_lines(F.col("text"), "Licen").alias("l"))
    return near.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.aggregate("l", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"))


@query("line_islands", "WITH l AS (SELECT doc_id, pos - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE length(line) > 120), g AS (SELECT doc_id, pos, coalesce((pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 4)::INT, 0) AS new FROM l), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g) SELECT doc_id, island::BIGINT AS island, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos, count(*) AS n FROM i GROUP BY doc_id, island")
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    return documents.islands(documents.lines_of(table(spark, d, "documents")).where(F.length("line") > 120))


@query("boilerplate_filter", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT doc_id) >= 20) SELECT doc_id, count(*) AS n_lines FROM l WHERE line NOT IN (SELECT line FROM c) GROUP BY doc_id")
def boilerplate_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = documents.lines_of(table(spark, d, "documents"))
    common = lines.groupBy("line").agg(F.countDistinct("doc_id").alias("n")).where("n >= 20").select("line")
    return lines.join(common, "line", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("script_detect", "SELECT turn_script, count(*) AS n FROM (SELECT CASE WHEN bn + la = 0 THEN 'none' WHEN 2 * bn >= bn + la THEN 'bn' WHEN bn > 0 THEN 'mixed' ELSE 'latin' END AS turn_script FROM (SELECT len(regexp_extract_all(t, '[ঀ-৿]')) AS bn, len(regexp_extract_all(t, '[A-Za-z]')) AS la FROM (SELECT CASE turn % 5 WHEN 0 THEN '১২৩ আবেদন ' || left(text, 4) WHEN 1 THEN text || ' আবেদন' WHEN 2 THEN '12 - 34' ELSE text END AS t FROM conversations))) GROUP BY turn_script")
def script_detect(spark: SparkSession, d: str) -> DataFrame:
    turn, text = F.col("turn") % 5, F.col("text")
    t = F.when(turn == 0, F.concat(F.lit("১২৩ আবেদন "), F.substring(text, 1, 4))).when(turn == 1, F.concat(text, F.lit(" আবেদন"))).when(turn == 2, "12 - 34").otherwise(text)
    return table(spark, d, "conversations").groupBy(T.script(t).alias("turn_script")).agg(F.count(F.lit(1)).alias("n"))


@query("history_last6", "SELECT conv_id, turn, count(*) OVER w AS n_before, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)")
def history_last6(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.count(F.lit(1)).over(w).alias("n_before"), F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("n_chars"))


@query("latest_user_value", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user_chars FROM conversations")
def latest_user_value(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.length("text")), ignorenulls=True).over(w).alias("last_user_chars"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the turn before. Both sides are dealt out by key: a broadcast would leave all work on the texts to the few
    tasks that a small file has."""
    c = table(spark, d, "conversations")
    u, a = c.where("role = 'user'").hint("merge"), c.where("role = 'assistant'")
    return u.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference")).join(a.select("conv_id", "turn", F.col("text").alias("prediction")), ["conv_id", "turn"]).select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "prediction", "reference")


PAIRS_SQL = "p AS (SELECT a.conv_id * 10000 + a.turn AS id, a.text AS prediction, u.text AS reference FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' AND a.role = 'assistant')"


def _ngram_sql(n: int) -> str:
    grams = lambda c: f"SELECT id, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS g, count(*) AS n FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT id, {words_sql(c)} AS w FROM p)) GROUP BY ALL"
    return f"""WITH {PAIRS_SQL}, x AS ({grams('prediction')}), y AS ({grams('reference')}),
    s AS (SELECT id, sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS s, sum(x.n) AS p, sum(y.n) AS r FROM x FULL JOIN y USING (id, g) GROUP BY id),
    m AS (SELECT p.id, coalesce(s.s / nullif(s.p, 0), 0) AS p, coalesce(s.s / nullif(s.r, 0), 0) AS r FROM p LEFT JOIN s USING (id))
    SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m"""


@query("rouge1_pairs", _ngram_sql(1))
def rouge1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ngram_scores(_pairs(spark, d), 1)


@query("rouge2_pairs", _ngram_sql(2))
def rouge2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ngram_scores(_pairs(spark, d), 2)


@query("rouge_l")
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.longest_common(_pairs(spark, d))


@query("jaccard_pairs", f"WITH {PAIRS_SQL}, w AS (SELECT id, list_distinct({words_sql('prediction')}) AS a, list_distinct({words_sql('reference')}) AS b FROM p) SELECT id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard, round(coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0), 6) AS overlap, round(coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0), 6) AS coverage FROM w")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array_distinct(T.word_list(F.col("prediction"))), F.array_distinct(T.word_list(F.col("reference")))
    return _pairs(spark, d).select("id", a.alias("a"), b.alias("b")).select("id", F.round(V.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(V.overlap(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(V.coverage(F.col("a"), F.col("b")), 6).alias("coverage"))


@query("benchmark_contamination", f"WITH b AS (SELECT sha256(array_to_string({words_sql('text')}, ' ')) AS h FROM benchmark) SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT -length(text) AS doc_id, '  ' || text || ' !' AS line FROM benchmark) WHERE sha256(array_to_string({words_sql('line')}, ' ')) IN (SELECT h FROM b)")
def benchmark_contamination(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.sha2(T.normal_words(F.col(c)), 256)
    held = table(spark, d, "benchmark").select(key("text").alias("h")).distinct()
    seeded = table(spark, d, "benchmark").select((-F.length("text")).cast("long").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("  "), "text", F.lit(" !")).alias("line"))
    lines = documents.lines_of(table(spark, d, "documents")).unionByName(seeded)  # the items themselves, set otherwise, are hits
    return lines.withColumn("h", key("line")).join(held, "h", "left_semi").select("doc_id", "line")


@query("chunk_documents")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(table(spark, d, "documents"))


@query("clean_html_pages")
def clean_html_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.clean_pages(table(spark, d, "pages"))


@query("nfkc_normalize", "SELECT doc_id, replace(lower(text), 'ß', 'ss') AS text FROM documents")
def nfkc_normalize(spark: SparkSession, d: str) -> DataFrame:
    return chunking.nfkc(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("stream_tokens", r"SELECT conv_id, turn, len(regexp_extract_all(text, '[^\s.!?;:]*[\s.!?;:]|[^\s.!?;:]+$')) AS n_tokens, CASE WHEN length(text) > 80 THEN rtrim(left(text, 79)) || '…' ELSE text END AS short_text FROM conversations")
def stream_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.stream_tokens(F.col("text"))).alias("n_tokens"), T.shortened(F.col("text"), 80).alias("short_text"))
