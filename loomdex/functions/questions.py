"""What a question asks for: normal form, language, intent, fact, lane and canonical search text. All stay in the JVM.

Names of the institution that owns the knowledge base are parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.binding import bound

# The wording by which subjects are told apart. Results depend on each of them.
UNSUPPORTED = r"\b(?:my|personal)\s+(?:application|admission)\s+status\b|\binsurance\s+documents?\b|\b(?:guarantee|secret|unofficial|leaked)\b.*\b(?:admission|scholarship|waiver)\b"
DOCUMENT = r"\b(?:documents?|docs?|papers?|paperwork|certificates?|transcripts?)\b|ডকুমেন্ট|কাগজপত্র|কাগজ|সার্টিফিকেট|ট্রান্সক্রিপ্ট|\bkagoj(?:potro)?\b"
REQUIREMENT = r"\b(?:admission\s+)?requirements?\b|ভর্তির\s+শর্ত|কি\s+কি\s+লাগবে|\bki\s+ki\s+lagbe\b"
DIPLOMA = r"\bdiploma\b|ডিপ্লোমা"
APPLY = r"\b(?:apply\w*|application|admission\s+process|application\s+process|admission\s+flow(?:chart)?|admission\s+steps?)\b|\b(?:vorti|bhorti)\b.*\b(?:kivabe|korbo|hobe)\b|কীভাবে\s+আবেদন|কিভাবে\s+আবেদন|আবেদন\s+করব|ভর্তির\s+প্রক্রিয়া"
ELIGIBILITY = r"\b(?:eligible|eligibility|admission\s+condition|admission\s+criteria|joggota|jogyota|condition)\b|যোগ্য(?:তা)?|ভর্তির\s+যোগ্য(?:তা)?"
TUITION = r"\b(?:tuition|fees?|cost|payable|total\s+fee|admission\s+fee)\b|টিউশন|ফি|খরচ"
WAIVER = r"\bwaivers?\b|ওয়েভার|ওয়েভার"
SCHOLARSHIP = r"\b(?:scholarships?|financial\s+aid)\b|বৃত্তি|স্কলারশিপ"
PROGRAM_LIST = r"\b(?:what|which)\b.*\b(?:programs?|courses?|degrees?)\b|\b(?:show|list|available|offered|all)\b.*\b(?:programs?|courses?|degrees?)\b|\b(?:programs?|courses?|degrees?)\b.*\b(?:available|offered|list)\b|\b(?:programs?|courses?|degrees?)\b.*\b(?:offer|offers)\b|\b(?:show|list)\b.*\bprogram\s+catalog\b|\bprogram\s+catalog\b|প্রোগ্রাম|কোর্স"
PROGRAM_WORD = r"\b(?:programs?|courses?|degrees?)\b|প্রোগ্রাম|কোর্স"
DEADLINE = r"\b(?:deadline|last\s+date|when\s+to\s+apply)\b|শেষ\s+তারিখ"
CONTACT = r"\b(?:contact|phone|email|address)\b|যোগাযোগ"
INTERNATIONAL = r"\b(?:international|foreign|overseas)\b|বিদেশি"
ADMISSION = r"\b(?:admission|admit|apply\w*|vorti|bhorti)\b|ভর্তি|আবেদন"
ADMISSION_GPA = r"\b(?:gpa|grades?)\b.*\b(?:admission|apply|required|requirement|minimum|needed|eligible|eligibility)\b|\b(?:admission|apply|required|requirement|minimum|needed|eligible|eligibility)\b.*\b(?:gpa|grades?)\b"
ROMANISED = r"\b(?:vorti|bhorti|kivabe|korbo|lagbe|koto|joggota|jogyota|kono|ache|ar|ami|ki|er|jonno)\b"
BENGALI = r"[ঀ-৿]"
DOLLARS = r"\b(?:usd|dollars?|international|foreign)\b|\$"
TAKA = r"\b(?:bdt|taka|tk\.?|local|domestic|bangladeshi)\b|৳"
GPA = r"\b(?:gpa|grades?)\b"
OUTSIDE = r"\b(?:outside|other than|except|excluding|not|non-?)\b.*\bengineering\b"
FACTS = {"waiver": "waiver", "scholarship": "scholarship", "tuition": "tuition", "documents": "documents", "application_process": "admission_process", "diploma_application": "diploma_application", "eligibility": "eligibility", "program_info": "program_info", "deadline": "deadline", "contact": "contact", "international": "international", "admission_overview": "admission_overview"}
LATER_FACTS = (("waiver", r"\bwaivers?\b|ওয়েভার|ওয়েভার"), ("scholarship", r"\bscholarships?\b|বৃত্তি|স্কলারশিপ"), ("tuition", r"\b(?:tuition|fees?|cost)\b|টিউশন|ফি|খরচ"), ("documents", r"\bdocuments?\b|ডকুমেন্ট|কাগজপত্র|কাগজ"), ("deadline", r"\bdeadlines?\b"), ("admission_process", r"\b(?:admission|application)\s+process\b|\bhow\s+(?:do|can|to)\s+(?:i\s+)?apply\b|আবেদন"))
TOPICS = (
    (r"documents?|certificate|transcript|ডকুমেন্ট|কাগজ", (("required_admission_documents", 0.080),)),
    (r"\bapply|application\b|আবেদন", (("admission_application_process", 0.080), ("admission_process", 0.040))),
    (r"\bprograms?|courses?|degrees?\b|প্রোগ্রাম|কোর্স", (("undergraduate_programs", 0.070),)),
    (r"\btuition|fees?|cost\b|টিউশন|ফি|খরচ", (("tuition_and_fees", 0.065),)),
    (r"\bscholarships?\b|বৃত্তি|স্কলারশিপ", (("scholarships", 0.070),)),
    (r"\bwaivers?\b|ওয়েভার|ওয়েভার", (("waivers", 0.070),)),
    (r"\bcurrent\s+admission|admission\s+details", (("admission_overview", 0.070),)),
)
STRUCTURED = r"\b(?:waivers?|scholarships?|tuition|fees?|cost|rates?|gpas?|percentages?|deadlines?|requirements?)\b|%|বৃত্তি|টিউশন|ফি|খরচ|ওয়েভার|ওয়েভার"


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case, by Unicode's letters; false for null."""
    return F.coalesce(text.rlike(f"(?iU)(?:{pattern})"), F.lit(False))


def normal_question(text: Column) -> Column:
    """Straight quotes and single blanks; a blank question is null, as it cannot be asked."""
    t = F.trim(F.regexp_replace(F.translate(text, "’‘", "''"), r"(?U)\s+", " "))
    return bound(t, lambda own: F.nullif(own, F.lit("")))


def question_language(text: Column) -> Column:
    """bn by script, banglish by romanised words, else en."""
    return F.when(has(text, BENGALI), "bn").when(has(text, ROMANISED), "banglish").otherwise("en")


def chosen(rules: list[tuple[Column, str]]) -> Column:
    """The label of the first rule that holds, else null."""
    (first, label), *rest = rules
    return reduce(lambda out, r: out.when(r[0], r[1]), rest, F.when(first, label))


def names(text: Column, own: tuple[str, ...]) -> Column:
    """Whether one of some words stands in the text."""
    return has(text, r"\b(?:" + "|".join(own) + r")\b") if own else F.lit(False)


def intent(text: Column, program: Column, own: tuple[str, ...] = ()) -> Column:
    """One of 13 intents by a fixed precedence, else null. program: the program that the question names, or null."""
    q, named = text, program.isNotNull()
    rules = [
        (has(q, UNSUPPORTED), None),
        (has(q, DIPLOMA) & (has(q, APPLY) | has(q, ELIGIBILITY)), "diploma_application"),
        (has(q, WAIVER), "waiver"),
        (has(q, SCHOLARSHIP), "scholarship"),
        (has(q, TUITION), "tuition"),
        (has(q, ELIGIBILITY) | (named & has(q, REQUIREMENT)), "eligibility"),
        (has(q, INTERNATIONAL), "international"),
        (has(q, DOCUMENT) | (has(q, REQUIREMENT) & ~named), "documents"),
        (has(q, APPLY), "application_process"),
        (has(q, DEADLINE), "deadline"),
        (has(q, CONTACT), "contact"),
        (has(q, PROGRAM_LIST), "program_catalog"),
        (named | has(q, PROGRAM_WORD), "program_info"),
        (has(q, ADMISSION) | names(q, own), "admission_overview"),
    ]
    return chosen(rules)


def about_admission(text: Column, program: Column, own: tuple[str, ...] = (), kind: Column | None = None) -> Column:
    """Whether the question belongs to the knowledge base's domain at all. kind: its intent, where that is known."""
    kind = intent(text, program, own) if kind is None else kind
    return ~has(text, UNSUPPORTED) & (kind.isNotNull() | program.isNotNull() | has(text, ADMISSION) | names(text, own))


def fact(text: Column, program: Column, own: tuple[str, ...] = (), kind: Column | None = None) -> Column:
    """The fact that evidence has to state: required grades before all, then the intent, then single words. kind: the intent,
    where it is known."""
    mapped = bound(intent(text, program, own) if kind is None else kind, lambda k: chosen([(k == i, v) for i, v in FACTS.items()]))
    later = chosen([(has(text, p), label) for label, p in LATER_FACTS])
    return F.when(has(text, ADMISSION_GPA), "admission_gpa").otherwise(F.coalesce(mapped, later))


def lane_category(text: Column, kind: Column) -> Column:
    """The category to which a supplemental search by program name is narrowed, or null."""
    return F.when(kind == "tuition", F.when(has(text, DOLLARS), "international_admission").otherwise("tuition_and_fees")).when(kind.isin("program_info", "eligibility"), "undergraduate_programs").when(kind == "waiver", "waivers")


def search_text(text: Column, kind: Column, program: Column, owner: str = "") -> Column:
    """What to search for: wording of the official evidence for each intent, else the question itself."""
    about = F.coalesce(F.concat(F.lit(" "), program), F.lit(""))
    money = F.when(has(text, INTERNATIONAL), f"{owner} international student tuition fees USD total program fees cost").otherwise(f"{owner} local student tuition fees payable during admission total program fees cost")
    # The wording of the evidence sought.
    wording = {
        "application_process": F.lit(f"{owner} admission application process flow online apply new applicant"),
        "documents": F.lit(f"{owner} required admission documents checklist certificate transcript online application"),
        "diploma_application": F.lit("Online Admission Form Local Bachelor Program Diploma Apply Type"),
        "tuition": F.concat(money, about),
        "scholarship": F.lit(f"{owner} financial aid scholarships local students scholarship categories"),
        "waiver": F.concat(F.lit(f"{owner} official waiver policy tuition fee waiver categories"), about),
        "program_catalog": F.lit(f"{owner} complete program catalog across all faculties programs offered"),
        "program_info": F.concat(F.lit(f"{owner} official program catalog"), about, F.lit(" program details")),
        "eligibility": F.concat(F.lit(owner), about, F.lit(" program eligibility verification official program catalog")),
        "deadline": F.lit(f"{owner} current admission notice application deadline last date"),
        "contact": F.lit(f"{owner} official admission contact phone email address"),
        "international": F.lit(f"{owner} international student admission policy tuition contact"),
        "admission_overview": F.lit(f"{owner} official admission information overview"),
    }
    out = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(wording.items())[1:], F.when(kind == "application_process", wording["application_process"]))
    return F.trim(F.regexp_replace(F.coalesce(out, text), r"\s+", " "))


def foreign(text: Column, own: tuple[str, ...], others: tuple[str, ...]) -> Column:
    """Whether the question names another institution and not the own one: out of the domain."""
    return names(text, others) & ~names(text, own)


def topic_bonus(text: Column, category: Column) -> Column:
    """A small bonus where the question names the category's subject."""
    low, own = F.lower(text), F.lower(category)
    out = chosen([(has(low, p) & (own == c), F.lit(b)) for p, cs in TOPICS for c, b in cs] + [(has(low, TOPICS[3][0]) & has(low, "international|বিদেশ") & (own == "international_admission"), F.lit(0.065))])
    return F.coalesce(out, F.lit(0.0))


def excludes_engineering(text: Column) -> Column:
    return has(text, OUTSIDE)
