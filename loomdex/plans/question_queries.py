"""Queries over questions, programs and evidence. Questions are made for the rules: a template by the key of part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import programs as P
from loomdex.functions import questions as Q
from loomdex.functions import text as T
from loomdex.operators import retrieval
from loomdex.plans.registry import query, table

OWN, OTHERS = ("acme", "acme college"), ("northfield", "nfu")
QUESTIONS = (
    "How do I apply for the CSE program?", "which documents do I need?", "What papers are needed for a diploma application", "Tell me the tuition fee of BBA", "total cost for international students in USD", "waiver for high GPA in MBA", "Is there any financial aid?", "Am I eligible for Civil Engineering?",
    "requirements", "requirements for LL.B.", "What is the minimum GPA required for admission in CSE", "foreign student contact", "list of all programs", "Which degrees are offered", "Computer Science", "admission deadline 2025", "when to apply?", "phone and email please", "acme", "what is the weather", "my application status",
    "guarantee me a scholarship", "is northfield better than nfu", "Does Acme accept credits from Northfield?", "vorti kivabe korbo", "CSE er tuition koto taka", "ভর্তির যোগ্যতা কি", "বৃত্তি আছে?", "টিউশন ফি কত", "online application documents for master's program", "programs outside engineering", "M.Sc in Computer Science fees",
    "the CE department", "since the ce of it", "Bachelor of Laws & MBA", "  spaced   ’quoted’  question ", "%", "bachelor documents checklist", "diploma holder documents", "admission details", "fees in taka of Civil Engineering",
)
PROGRAMS = (
    P.Program("cse", "Computer Science and Engineering", ("computer science", "cse"), "undergraduate"),
    P.Program("msc", "Master of Computer Science", ("m.sc in computer science", "master's of computer science"), "postgraduate"),
    P.Program("civil", "Civil Engineering", ("civil", "ce"), "undergraduate"),
    P.Program("bba", "Bachelor of Business Administration", ("bba",), "undergraduate"),
    P.Program("mba", "Master of Business Administration", ("mba",), "postgraduate"),
    P.Program("llb", "Bachelor of Laws", ("ll.b.",), "undergraduate"),
)
ROWS = ("B.Sc. in Computer Science and Engineering", "Computer Science and Engineering (Diploma Holder)", "Master of Computer Science", "BBA", "BBA in Finance", "Master of Business Administration (Evening)", "Civil Engineering", "Bachelor of Laws (Hons)", "", "PGD in Analytics")
CATEGORIES = ("tuition_and_fees", "international_admission", "waivers", "scholarships", "required_admission_documents", "admission_process", "admission_application_process", "undergraduate_programs", "program_specific_admission", "admission_contact_information", "admission_overview", "admission_notices", "current_admission_information")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def m(pattern: str, c: str = "q") -> str:
    return f"regexp_matches({c}, {quoted(f'(?i)(?:{pattern})')})"


def pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


ASKED_SQL = f"SELECT p_partkey, {listed(QUESTIONS)}[p_partkey % {len(QUESTIONS)} + 1] AS q FROM part"


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", pick(QUESTIONS, F.col("p_partkey")).alias("q"))


def form_sql(c: str) -> str:
    out = f"trim(regexp_replace(replace(regexp_replace(replace(replace(lower({c}), '’', ''''), '‘', ''''), 'master(''s|s)?', 'master', 'g'), '&', ' and '), '[^a-z0-9_\\x{{980}}-\\x{{9FF}}]+', ' ', 'g'))"
    for p, r in P.JOINED:
        out = f"regexp_replace({out}, {quoted(p)}, {quoted(r)}, 'g')"
    return out


NAMES_SQL = ", ".join(f"({quoted(p.marker)}, {quoted(p.canonical)}, {quoted(n)}, {quoted(p.level or '')})" for p in PROGRAMS for n in (*p.aliases, p.canonical))
#: qs: each question with its form and the marker, if a single program is named most specifically.
QS_SQL = f"""names(marker, canonical, name, level) AS (VALUES {NAMES_SQL}),
asked AS ({ASKED_SQL}), forms AS (SELECT *, {form_sql("q")} AS form FROM asked),
phrases AS (SELECT *, {form_sql("name")} AS phrase FROM names),
hits AS (SELECT p_partkey, marker, len(string_split(phrase, ' ')) * 1000 + length(phrase) AS w FROM forms JOIN phrases ON contains(' ' || form || ' ', ' ' || phrase || ' ') AND (phrase <> 'ce' OR regexp_matches(q, '(^|[^A-Za-z0-9])CE($|[^A-Za-z0-9])'))),
best AS (SELECT p_partkey, CASE WHEN count(DISTINCT marker) = 1 THEN min(marker) END AS marker FROM hits h WHERE w = (SELECT max(w) FROM hits x WHERE x.p_partkey = h.p_partkey) GROUP BY 1),
qs AS (SELECT f.p_partkey, f.q, f.form, b.marker, n.canonical, n.level FROM forms f LEFT JOIN best b USING (p_partkey) LEFT JOIN (SELECT DISTINCT marker, canonical, level FROM names) n ON n.marker = b.marker)"""


def with_program(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d).withColumn("marker", P.single(P.named_programs(F.col("q"), PROGRAMS)))
    return q.withColumn("canonical", P.canonical_name(F.col("marker"), PROGRAMS))


def level_sql(form: str) -> str:
    return f"CASE WHEN list_has_any(string_split({form}, ' '), {listed(P.POSTGRADUATE)}) OR contains({form}, 'post graduate') OR starts_with({form}, 'pgd ') THEN 'postgraduate' WHEN list_has_any(string_split({form}, ' '), {listed(P.UNDERGRADUATE)}) THEN 'undergraduate' END"


@query("program_resolution", f"WITH {QS_SQL} SELECT p_partkey, form, {level_sql('form')} AS level, marker, canonical, CASE WHEN length(s) >= 3 THEN s END AS phrase FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(form, {quoted(P.FILLER)}, ' ', 'g'), '\\b(acme)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM qs)")
def program_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows, form = with_program(spark, d).withColumn("form", P.program_form(F.col("q"))), F.col("form")
    return rows.select("p_partkey", "form", P.form_level(form).alias("level"), "marker", "canonical", P.form_phrase(form, OWN[:1]).alias("phrase"))


INTENT_SQL = f"""CASE WHEN {m(Q.UNSUPPORTED)} THEN NULL WHEN {m(Q.DIPLOMA)} AND ({m(Q.APPLY)} OR {m(Q.ELIGIBILITY)}) THEN 'diploma_application'
WHEN {m(Q.WAIVER)} THEN 'waiver' WHEN {m(Q.SCHOLARSHIP)} THEN 'scholarship' WHEN {m(Q.TUITION)} THEN 'tuition'
WHEN {m(Q.ELIGIBILITY)} OR (canonical IS NOT NULL AND {m(Q.REQUIREMENT)}) THEN 'eligibility' WHEN {m(Q.INTERNATIONAL)} THEN 'international'
WHEN {m(Q.DOCUMENT)} OR {m(Q.REQUIREMENT)} THEN 'documents' WHEN {m(Q.APPLY)} THEN 'application_process' WHEN {m(Q.DEADLINE)} THEN 'deadline'
WHEN {m(Q.CONTACT)} THEN 'contact' WHEN {m(Q.PROGRAM_LIST)} THEN 'program_catalog' WHEN canonical IS NOT NULL OR {m(Q.PROGRAM_WORD)} THEN 'program_info'
WHEN {m(Q.ADMISSION)} OR {m('\\bacme\\b')} THEN 'admission_overview' END"""
FACT_SQL = f"CASE WHEN {m(Q.ADMISSION_GPA)} THEN 'admission_gpa' WHEN intent = 'application_process' THEN 'admission_process' WHEN intent <> 'program_catalog' THEN intent " + " ".join(f"WHEN {m(p)} THEN '{k}'" for k, p in Q.LATER_FACTS) + " END"
INTENTS_SQL = f"{QS_SQL}, ints AS (SELECT *, {INTENT_SQL} AS intent FROM qs), facts AS (SELECT *, {FACT_SQL} AS fact FROM ints)"
LANE_SQL = f"CASE WHEN intent = 'tuition' THEN CASE WHEN {m(Q.DOLLARS)} THEN 'international_admission' ELSE 'tuition_and_fees' END WHEN intent IN ('program_info', 'eligibility') THEN 'undergraduate_programs' WHEN intent = 'waiver' THEN 'waivers' END"


def understood(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    rows = with_program(spark, d).withColumn("intent", Q.intent(q, F.col("canonical"), OWN))
    return rows.withColumn("fact", Q.fact(q, F.col("canonical"), OWN, F.col("intent")))


@query("intent_classify", f"WITH {INTENTS_SQL} SELECT p_partkey, CASE WHEN regexp_matches(q, '[ঀ-৿]') THEN 'bn' WHEN {m(Q.ROMANISED)} THEN 'banglish' ELSE 'en' END AS language, intent, fact, {LANE_SQL} AS lane, NOT {m(Q.UNSUPPORTED)} AND (intent IS NOT NULL OR canonical IS NOT NULL OR {m(Q.ADMISSION)} OR {m('\\bacme\\b')}) AS asks_admission FROM facts")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return understood(spark, d).select("p_partkey", Q.question_language(q).alias("language"), "intent", "fact", Q.lane_category(q, F.col("intent")).alias("lane"), Q.about_admission(q, F.col("canonical"), OWN, F.col("intent")).alias("asks_admission"))


@query(
    "search_text",
    f"""WITH {INTENTS_SQL}, p AS (SELECT *, coalesce(' ' || canonical, '') AS about FROM ints)
    SELECT p_partkey, trim(regexp_replace(CASE intent WHEN 'application_process' THEN 'acme admission application process flow online apply new applicant' WHEN 'documents' THEN 'acme required admission documents checklist certificate transcript online application'
    WHEN 'diploma_application' THEN 'Online Admission Form Local Bachelor Program Diploma Apply Type' WHEN 'tuition' THEN CASE WHEN {m(Q.INTERNATIONAL)} THEN 'acme international student tuition fees USD total program fees cost' ELSE 'acme local student tuition fees payable during admission total program fees cost' END || about
    WHEN 'scholarship' THEN 'acme financial aid scholarships local students scholarship categories' WHEN 'waiver' THEN 'acme official waiver policy tuition fee waiver categories' || about WHEN 'program_catalog' THEN 'acme complete program catalog across all faculties programs offered'
    WHEN 'program_info' THEN 'acme official program catalog' || about || ' program details' WHEN 'eligibility' THEN 'acme' || about || ' program eligibility verification official program catalog' WHEN 'deadline' THEN 'acme current admission notice application deadline last date'
    WHEN 'contact' THEN 'acme official admission contact phone email address' WHEN 'international' THEN 'acme international student admission policy tuition contact' WHEN 'admission_overview' THEN 'acme official admission information overview'
    ELSE trim(regexp_replace(replace(replace(q, '’', ''''), '‘', ''''), '\\s+', ' ', 'g')) END, '\\s+', ' ', 'g')) AS search FROM p""",
)
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return understood(spark, d).select("p_partkey", Q.search_text(Q.normal_question(F.col("q")), F.col("intent"), F.col("canonical"), "acme").alias("search"))


@query("out_of_domain", f"WITH asked AS ({ASKED_SQL}) SELECT p_partkey, {m('\\b(?:northfield|nfu)\\b')} AND NOT {m('\\b(?:acme|acme college)\\b')} AS out_of_domain, {m(Q.OUTSIDE)} AS no_engineering FROM asked")
def out_of_domain(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("p_partkey", Q.foreign(F.col("q"), OWN, OTHERS).alias("out_of_domain"), Q.excludes_engineering(F.col("q")).alias("no_engineering"))


#: Evidence rows for each question, five of them.
EVIDENCE_SQL = f"""rows AS (SELECT f.*, k AS chunk, p_partkey * 5 + k AS n FROM facts f, range(5) t(k)),
evidence AS (SELECT *, {listed(CATEGORIES)}[n * 7 % {len(CATEGORIES)} + 1] AS category, {listed(ROWS)}[n * 3 % {len(ROWS)} + 1] AS program, CASE WHEN n % 3 = 0 THEN 'costs $100' ELSE 'costs 100 taka' END AS content, CASE WHEN n % 4 = 0 THEN 'text' ELSE 'table' END AS content_type FROM rows),
pforms AS (SELECT *, {form_sql("program")} AS pform, {form_sql("regexp_replace(program, '[(][^)]*[)]', ' ', 'g')")} AS bare, {form_sql("canonical")} AS cform, coalesce({level_sql("form")}, level) AS expected FROM evidence),
matched AS (SELECT *, coalesce(CASE WHEN marker IN ('bba', 'mba') THEN bare = marker OR bare = cform ELSE contains(' ' || pform || ' ', ' ' || cform || ' ') END, false) AS of_program,
  NOT (contains(pform, 'diploma holder') AND NOT contains(form, 'diploma')) AND (expected IS NULL OR expected IS NOT DISTINCT FROM {level_sql("pform")}) AS of_level FROM pforms)"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = understood(spark, d).withColumn("asked", P.asked_level(F.col("q"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("n", F.col("p_partkey") * 5 + F.col("chunk"))
    n = F.col("n")
    rows = rows.withColumns({"category": pick(CATEGORIES, n * 7), "program": pick(ROWS, n * 3), "content": F.when(n % 3 == 0, "costs $100").otherwise("costs 100 taka"), "content_type": F.when(n % 4 == 0, "text").otherwise("table")})
    return rows.withColumns({"of_program": P.row_matches(F.col("program"), F.col("marker"), PROGRAMS), "of_level": P.matches_asked(F.col("asked"), F.col("program"), F.col("marker"), PROGRAMS)})


@query(
    "evidence_gate",
    f"""WITH {INTENTS_SQL}, {EVIDENCE_SQL}, g AS (SELECT *, marker IS NOT NULL AS named, program <> '' AND of_program AND of_level AS good FROM matched)
    SELECT p_partkey, chunk, of_program, of_level, CASE
    WHEN fact = 'tuition' THEN category = CASE WHEN {m(Q.DOLLARS)} THEN 'international_admission' ELSE 'tuition_and_fees' END AND NOT ({m(Q.TAKA)} AND contains(content, '$')) AND (NOT named OR good)
    WHEN fact = 'admission_gpa' AND named THEN category = 'program_specific_admission' AND good
    WHEN fact = 'waiver' THEN category = 'waivers' AND (NOT named OR (NOT ({m(Q.GPA)} AND content_type <> 'table') AND of_program AND of_level))
    WHEN fact = 'scholarship' THEN category = 'scholarships'
    WHEN fact = 'documents' THEN category = 'required_admission_documents' AND CASE WHEN {m('\\bonline\\b')} THEN contains(lower(program), 'online') WHEN {m('\\bdiploma\\b')} THEN contains(lower(program), 'diploma') WHEN {m('\\b(?:masters?|postgraduate)\\b')} THEN contains(lower(program), 'master') AND NOT contains(lower(program), 'diploma')
      WHEN {m('\\b(?:bachelors?|undergraduate)\\b')} THEN contains(lower(program), 'bachelor') AND NOT contains(lower(program), 'diploma') AND NOT contains(lower(program), 'online') ELSE true END
    WHEN fact = 'admission_process' THEN category = 'admission_process' WHEN fact = 'diploma_application' THEN category = 'admission_application_process' WHEN fact = 'contact' THEN category = 'admission_contact_information'
    WHEN fact = 'international' THEN category = 'international_admission' WHEN fact = 'admission_overview' THEN category IN ('admission_overview', 'current_admission_information')
    WHEN fact = 'deadline' THEN category IN ('admission_notices', 'admission_overview', 'current_admission_information')
    WHEN fact IN ('eligibility', 'program_info') THEN category = 'undergraduate_programs' AND (NOT named OR good)
    WHEN fact IS NULL AND named THEN category IN ('undergraduate_programs', 'program_specific_admission') AND good ELSE true END AS fits FROM g""",
)
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    fits = retrieval.answers_fact(F.col("fact"), F.col("q"), F.col("category"), F.col("program"), F.col("content"), F.col("content_type"), F.col("marker").isNotNull(), F.col("of_program") & F.col("of_level"))
    return evidence(spark, d).select("p_partkey", "chunk", "of_program", "of_level", fits.alias("fits"))


def topic_sql() -> str:
    whens = " ".join(f"WHEN {m(p, 'lower(q)')} AND category = '{c}' THEN {b}" for p, cs in Q.TOPICS for c, b in cs)
    return f"CASE {whens} WHEN {m(Q.TOPICS[3][0], 'lower(q)')} AND {m('international|বিদেশ', 'lower(q)')} AND category = 'international_admission' THEN 0.065 ELSE 0.0 END"


@query(
    "evidence_ranking",
    f"""WITH {INTENTS_SQL}, {EVIDENCE_SQL}, s AS (SELECT *, (n * 37 % 101) / 101.0 AS similarity, CASE n % 5 WHEN 0 THEN 'current_date_sensitive' WHEN 1 THEN 'stable_reference' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'historical' ELSE 'unknown' END AS currency, n % 7 = 0 AS manual, CASE WHEN n % 6 = 0 THEN 'partial' ELSE 'success' END AS extraction,
      {topic_sql()} AS topic, CASE WHEN category = 'undergraduate_programs' AND program = '' AND {m('\\bprograms?|courses?|degrees?\\b', 'lower(q)')} THEN 0.045 ELSE 0.0 END AS broad FROM matched),
    t AS (SELECT *, CASE WHEN marker IS NOT NULL AND NOT of_program THEN broad ELSE broad + CASE WHEN marker IS NULL THEN 0.0 ELSE 0.035 + CASE WHEN NOT of_level THEN 0.0 WHEN level = 'postgraduate' THEN 0.030 ELSE 0.025 END END + CASE WHEN content_type = 'table' AND {m(Q.STRUCTURED, 'lower(q)')} THEN 0.05 ELSE 0.0 END END AS metadata FROM s),
    u AS (SELECT *, greatest(-1.0, least(1.0, similarity + CASE currency WHEN 'current_date_sensitive' THEN 0.035 WHEN 'stable_reference' THEN 0.02 WHEN 'uncertain' THEN -0.07 WHEN 'historical' THEN -0.11 ELSE -0.08 END + CASE WHEN manual THEN -0.1 ELSE 0.0 END + CASE WHEN extraction <> 'success' THEN -0.08 ELSE 0.0 END
      + topic + metadata + CASE WHEN marker IS NOT NULL AND program <> '' AND NOT of_program THEN -0.5 ELSE 0.0 END)) AS relevance FROM t)
    SELECT p_partkey, chunk, round(relevance, 6) AS relevance, similarity >= 0.3 AND relevance >= 0.25 AS reached, row_number() OVER (PARTITION BY p_partkey ORDER BY manual::INT + (extraction <> 'success')::INT, CASE currency WHEN 'current_date_sensitive' THEN 0 WHEN 'stable_reference' THEN 1 WHEN 'uncertain' THEN 2 WHEN 'historical' THEN 3 ELSE 4 END, relevance DESC, topic DESC, metadata DESC, similarity DESC, chunk) AS place FROM u""",
)
def evidence_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows, n = evidence(spark, d), F.col("n")
    marker, program, of_program = F.col("marker"), F.col("program"), F.col("of_program")
    rows = rows.withColumns({"similarity": (n * 37 % 101) / 101.0, "currency_status": pick(("current_date_sensitive", "stable_reference", "uncertain", "historical", "unknown"), n), "manual_review": n % 7 == 0, "extraction_status": F.when(n % 6 == 0, "partial").otherwise("success"), "topic_bonus": Q.topic_bonus(F.col("q"), F.col("category")), "cross_score": F.lit(0.0), "chunk_id": F.col("chunk")})
    rows = rows.withColumn("metadata_bonus", retrieval.metadata_bonus(F.col("q"), F.col("category"), program, F.col("content_type"), marker, of_program, F.col("of_level"), P.of_marker(marker, {p.marker: p.level for p in PROGRAMS})))
    weight = retrieval.authority_weight(F.col("extraction_status"), F.col("currency_status"), F.col("manual_review"))
    rows = rows.withColumn("relevance", retrieval.vectors.relevance(F.col("similarity"), weight, F.col("topic_bonus"), F.col("metadata_bonus"), retrieval.mismatch_penalty(marker, program, of_program)))
    return retrieval.ranked_evidence(rows, "p_partkey").select("p_partkey", "chunk", F.round("relevance", 6).alias("relevance"), retrieval.reached(0.3, 0.25).alias("reached"), "place")


ANSWERS = ("The fee is 100.", "I'm sorry, that is OUT OF SCOPE.", "আমি জানি না", "Please ask the office", "jani na", "There is not enough information here", "আবেদন online")


@query("refusal_flag", f"SELECT p_partkey, {' OR '.join(f'contains(a, {quoted(x)})' for x in T.REFUSALS)} AS refused, (p_partkey % 2 = 0) = ({' OR '.join(f'contains(a, {quoted(x)})' for x in T.REFUSALS)}) AS adheres FROM (SELECT p_partkey, lower({listed(ANSWERS)}[p_partkey % {len(ANSWERS)} + 1]) AS a FROM part)")
def refusal_flag(spark: SparkSession, d: str) -> DataFrame:
    refused = T.any_phrase(pick(ANSWERS, F.col("p_partkey")), T.REFUSALS)
    return table(spark, d, "part").select("p_partkey", refused.alias("refused"), ((F.col("p_partkey") % 2 == 0) == refused).alias("adheres"))


@query("language_adherence", f"SELECT p_partkey, round(CASE WHEN bn + la = 0 THEN 0.0 WHEN asked = 'bn' THEN least(1.0, bn / (bn + la) / 0.5) WHEN asked = 'banglish' THEN (bn = 0)::INT::DOUBLE ELSE least(1.0, la / (bn + la) / 0.5) END, 6) AS adherence FROM (SELECT p_partkey, ['en', 'bn', 'banglish'][p_partkey % 3 + 1] AS asked, len(regexp_extract_all(a, '[ঀ-৿]')) AS bn, len(regexp_extract_all(a, '[A-Za-z]')) AS la FROM (SELECT p_partkey, {listed((*ANSWERS, '12'))}[p_partkey % {len(ANSWERS) + 1} + 1] AS a FROM part))")
def language_adherence(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.round(T.language_adherence(pick((*ANSWERS, "12"), key), pick(("en", "bn", "banglish"), key)), 6).alias("adherence"))
