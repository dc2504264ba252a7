"""Text functions on Columns: normal forms, tokens, identifiers, URLs and detectors. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.binding import bound

WORD = r"[a-z0-9\u0080-￿]+"
TOKEN = r"[A-Za-z0-9_$%\u0080-￿]+"
# Phrases by which an answer says that it does not answer.
REFUSALS = (
    "i could not find enough", "cannot answer", "can't answer", "i don't know", "i do not know", "i am unable", "i'm unable", "unable to answer", "cannot help", "cannot determine", "cannot confirm", "cannot provide", "can't provide", "unable to provide", "out of scope", "outside the scope",
    "not enough information", "insufficient information", "insufficient evidence", "cannot verify", "not able to", "no information available", "i'm sorry", "i am sorry", "don't have specific", "do not have specific", "don't have enough information", "do not have enough information", "don't have access",
    "do not have access", "as of my last update", "there isn't specific", "does not have specific tuition fee details", "পর্যাপ্ত যাচাইকৃত তথ্য পাওয়া যায়নি", "যাচাইকৃত তথ্য পাওয়া যায়নি", "আমি জানি না", "জানি না", "জানতে পারি না", "তথ্য পাওয়া যায়নি", "তথ্য নেই", "apnar proshner uttor dewar jonno",
    "uttor dewar jonno", "enough verified information", "paowa jay ni", "jani na", "jaani na",
)
TRACKING = ("fbclid", "gclid", "ref", "mc_cid", "mc_eid")


def fold(text: Column) -> Column:
    """Lower case with the sharp s spelled out, as case folding has it."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def word_list(text: Column) -> Column:
    """Words of the folded text in order, with repeats."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), 0)


def word_set(text: Column, least: int = 2) -> Column:
    """Distinct words of at least so many code points, in order of first use."""
    return F.array_distinct(F.filter(word_list(text), lambda w: F.length(w) >= least))


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def normal_words(text: Column) -> Column:
    """Words joined by single spaces: the form in which answers are compared."""
    return F.array_join(word_list(text), " ")


def normal_spaces(text: Column) -> Column:
    """LF line ends, no soft hyphens or zero-width spaces, words joined over hyphenated breaks, single blanks, two line ends at most."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, "[­​]", "")
    t = F.regexp_replace(t, r"([A-Za-z])-\n([a-z])", "$1$2")
    t = F.regexp_replace(t, "[ \t ]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"))


def normal_lines(text: Column) -> Column:
    """Line by line: blanks single, bullets alike, a line that repeats the one before dropped (a blank one between lets it
    stay), no more than one blank line in a row, none at the ends."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "[\u00ad\u200b]", "")
    t = F.regexp_replace(t, r"(?U)(?<=\w)-\n\s*(?=[a-z])", "")
    own = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), r"^[▪◦‣]\s*", "• "))
    kept = bound(own, lambda lines: F.filter(lines, lambda x, i: (i == 0) | (x == "") | (x != F.get(lines, i - 1))))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "^\n+|\n+$", ""), "\n{3,}", "\n\n")


def question_form(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def slug(text: Column, default: str = "item", longest: int = 80) -> Column:
    """Lower-case ASCII letters and digits with single hyphens between."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, longest), F.lit("")), F.lit(default))


def document_key(source: Column, url: Column, digits: int = 16) -> Column:
    """slug(source)-sha256(source NUL url)[:16]."""
    return F.concat(slug(source), F.lit("-"), F.substring(F.sha2(F.concat(source, F.lit("\0"), url), 256), 1, digits))


def record_key(prefix: str, *parts: Column, digits: int = 24) -> Column:
    """prefix + sha256 of the parts joined by U+001F, null as empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, digits))


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text between blanks or ends."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def letters(text: Column, pattern: str) -> Column:
    """How many characters of a class the text has."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def script(text: Column) -> Column:
    """bn if half of the letters are Bengali, mixed if fewer are, latin, or none."""
    bn, latin = letters(text, "[ঀ-৿]"), letters(text, "[A-Za-z]")
    return F.when(bn + latin == 0, "none").when(2 * bn >= bn + latin, "bn").when(bn > 0, "mixed").otherwise("latin")


def language_adherence(text: Column, asked: Column) -> Column:
    """How far an answer is in the language asked for, by script: full from half of the letters on; banglish is Latin only."""
    bn, latin = letters(text, "[ঀ-৿]"), letters(text, "[A-Za-z]")
    share = lambda n: F.least(F.lit(1.0), F.coalesce(F.try_divide(n.cast("double"), (bn + latin).cast("double")) / 0.5, F.lit(0.0)))
    return F.when(asked == "bn", share(bn)).when(asked == "banglish", ((bn == 0) & (latin > 0)).cast("double")).otherwise(share(latin))


def language(text: Column, romanised: tuple[str, ...] = ("ki", "koto", "kivabe", "ache", "lagbe")) -> Column:
    """bn by script, banglish by romanised words, else en."""
    hit = F.arrays_overlap(word_list(text), F.array(*map(F.lit, romanised)))
    return F.when(text.rlike("[ঀ-৿]"), "bn").when(hit, "banglish").otherwise("en")


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds any of the phrases."""
    low = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return F.coalesce(out, F.lit(False))


def first_match(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """The label of the first rule (pattern, label) whose pattern the text holds: classifiers of fixed precedence."""
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(default)


def stream_tokens(text: Column) -> Column:
    """Pieces that end behind white space or closing punctuation."""
    return F.regexp_extract_all(text, F.lit(r"[^\s.!?;:]*[\s.!?;:]|[^\s.!?;:]+$"), 0)


def shortened(text: Column, longest: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.rtrim(F.substring(text, 1, longest - 1)), F.lit("…"))).otherwise(text)


def removed_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round(F.greatest(F.lit(0), before - after) / before * 100, 2)).otherwise(F.lit(0.0))


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, default port and fragment dropped, tracking keys dropped, query pairs sorted, a path at least `/`."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING) & ~F.startswith(F.lower(p), F.lit("utm_")))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(head, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_allowed(url: Column, suffix: str) -> Column:
    """Whether the host is the suffix or below it."""
    return (url_host(url) == suffix) | F.endswith(url_host(url), F.lit(f".{suffix}"))


def safe_url(url: Column) -> Column:
    """http(s), a host, no credentials, no control characters."""
    return F.coalesce(url.rlike(r"^https?://[^/@?#\x00-\x20]+([/?#][^\x00-\x1f]*)?$"), F.lit(False))


def safe_relative_path(path: Column) -> Column:
    return ~F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|/)\.\.(/|$)")


def urls_in(text: Column) -> Column:
    """URLs of a text without closing punctuation."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"')\]]+"), 0), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def runs(words: Column, width: int | Column, most: int) -> Column:
    """Runs of `width` words (at most `most`) joined by blanks, one from each place; a shorter list is one run. Words are looked
    up by place, as slice() and array_join() of each run take several times as long."""
    word = lambda i, k: F.get(words, i + k) if isinstance(width, int) or k == 0 else F.when(width > k, F.get(words, i + k))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))), lambda i: F.concat_ws(" ", *(word(i, k) for k in range(most))))


def shingles(tokens: Column, width: int) -> Column:
    """Runs of `width` tokens joined by blanks; a shorter list is one run, an empty one has none."""
    return bound(tokens, lambda t: F.when(F.size(t) > 0, runs(t, width, width)).otherwise(F.array().cast("array<string>")))
