"""Names of programs: normal form, degree level, resolution of aliases, and matching of catalog rows. All stay in the JVM.

Aliases are a small table of the caller's (marker, canonical name, aliases, level); they go into the plan as literals.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.binding import bound

# Initialisms whose letters stand apart, and words that tell a degree's level.
JOINED = ((r"\bm\s+pharm\b", "mpharm"), (r"\bb\s+pharm\b", "bpharm"), (r"\bm\s+sc\b", "msc"), (r"\bb\s+sc\b", "bsc"), (r"\bm\s+a\b", "ma"), (r"\bb\s+a\b", "ba"), (r"\bll\s+m\b", "llm"), (r"\bll\s+b\b", "llb"), (r"\bb\s+arch\b", "barch"))
POSTGRADUATE = ("master", "msc", "ma", "mba", "llm", "mds", "mph", "mss", "mpharm", "postgraduate")
UNDERGRADUATE = ("bachelor", "bsc", "ba", "bba", "bss", "llb", "barch", "bph", "bpharm", "undergraduate")
FILLER = r"\b(?:what|which|tell|show|give|me|about|does|do|have|offer|offered|program|programme|course|degree|tuition|fees?|cost|total|payable|admission|local|student|information|details?|please)\b"
# Where this does not stand, none of JOINED can.
APART = r"\b(?:m|b|ll)\s"
IN_CAPITALS = ("ce", "te")


class Program(NamedTuple):
    marker: str
    canonical: str
    aliases: tuple[str, ...]
    level: str | None = None


def program_form(text: Column) -> Column:
    """Folded, "&" spelled out, punctuation as blanks, degree initialisms joined: the form in which names compare."""
    return bound(_folded(text), lambda own: F.when(own.rlike(APART), _joined(own)).otherwise(own))


def name_form(name: str) -> Column:
    """program_form() of a constant, which the optimiser evaluates; it leaves lambdas as they are."""
    return _joined(_folded(F.lit(name)))


def _folded(text: Column) -> Column:
    t = F.translate(F.lower(text), "’‘", "''")
    t = F.replace(F.regexp_replace(t, r"master(?:'s|s)?", "master"), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(t, r"(?U)[^\wঀ-৿]+", " "))


def _joined(form: Column) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), JOINED, form)


def holds(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text between blanks or ends; both in program_form(). No phrase stands nowhere."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def degree_level(text: Column) -> Column:
    """postgraduate, undergraduate or null."""
    return bound(program_form(text), form_level)


def form_level(form: Column) -> Column:
    """degree_level() of what is in program_form() already."""
    has = lambda some: F.arrays_overlap(F.split(form, " "), F.array(*map(F.lit, some)))
    return F.when(has(POSTGRADUATE) | F.contains(form, F.lit("post graduate")) | F.startswith(form, F.lit("pgd ")), "postgraduate").when(has(UNDERGRADUATE), "undergraduate")


def weight(phrase: Column) -> Column:
    """Longer names are more specific: by words, then by characters."""
    return F.struct(F.size(F.split(phrase, " ")).alias("words"), F.length(phrase).alias("chars"))


def named_programs(text: Column, programs: tuple[Program, ...]) -> Column:
    """Markers of the programs whose names in the text are the most specific, in the table's order."""

    def hits(form: Column) -> Column:
        found = []
        for p in programs:
            for name in dict.fromkeys((*p.aliases, p.canonical)):
                phrase = name_form(name)
                there = holds(form, phrase)
                if name.lower() in IN_CAPITALS:
                    there = there & text.rlike(rf"(?<![A-Za-z0-9]){name.upper()}(?![A-Za-z0-9])")
                found.append(F.when(there, F.struct(weight(phrase).alias("w"), F.lit(p.marker).alias("marker"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    of_weight = lambda found, best: F.array_distinct(F.transform(F.filter(found, lambda x: x["w"] == best), lambda x: x["marker"]))
    heaviest = lambda found: F.array_max(F.transform(found, lambda x: x["w"]))
    return bound(bound(program_form(text), hits), lambda found: bound(heaviest(found), lambda best: of_weight(found, best)))


def single(markers: Column) -> Column:
    """The only marker; null if there is none or a tie."""
    return bound(markers, lambda m: F.when(F.size(m) == 1, F.element_at(m, 1)))


def of_marker(marker: Column, values: dict[str, str | None]) -> Column:
    """A value by marker; null where there is none."""
    known = {k: v for k, v in values.items() if v is not None}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), marker) if known else F.lit(None).cast("string")


def canonical_name(marker: Column, programs: tuple[Program, ...]) -> Column:
    return of_marker(marker, {p.marker: p.canonical for p in programs})


def row_matches(program: Column, marker: Column, programs: tuple[Program, ...], narrow: tuple[str, ...] = ("bba", "mba")) -> Column:
    """Whether a catalog row is of the marked program. Narrow ones take only their bare name, none of the specialisations."""
    forms = [x for p in programs for x in (F.lit(p.marker), name_form(p.canonical))]  # constant, as the names are
    canonical = F.try_element_at(F.create_map(*forms), marker) if forms else F.lit(None).cast("string")
    bare = program_form(F.regexp_replace(program, r"\([^)]*\)", " "))
    of_bare = lambda form: (form == marker) | (form == canonical)
    return F.coalesce(F.when(marker.isin(*narrow), bound(bare, of_bare)).otherwise(holds(program_form(program), canonical)), F.lit(False))


def level_matches(text: Column, program: Column, marker: Column, programs: tuple[Program, ...]) -> Column:
    """Whether a row is of the degree level that the question asks for, or that its program has by default."""
    return bound(asked_level(text), lambda asked: matches_asked(asked, program, marker, programs))


def asked_level(text: Column) -> Column:
    """What level_matches() takes of a question, to be had once for all its rows: the level, and whether it names diplomas."""
    return bound(program_form(text), lambda form: F.struct(form_level(form).alias("level"), F.contains(form, F.lit("diploma")).alias("diploma")))


def matches_asked(asked: Column, program: Column, marker: Column, programs: tuple[Program, ...]) -> Column:
    """level_matches() by asked_level() of the question."""
    expected = F.coalesce(asked["level"], of_marker(marker, {p.marker: p.level for p in programs}))
    holder = lambda form: F.contains(form, F.lit("diploma holder")) & ~asked["diploma"]
    fits = lambda form: bound(expected, lambda e: e.isNull() | e.eqNullSafe(form_level(form)))
    return bound(program_form(program), lambda form: ~holder(form) & fits(form))


def search_phrase(text: Column, own: tuple[str, ...] = ()) -> Column:
    """What is left of a question without filler; null if shorter than three characters."""
    return form_phrase(program_form(text), own)


def form_phrase(form: Column, own: tuple[str, ...] = ()) -> Column:
    """search_phrase() of what is in program_form() already."""
    bare = F.regexp_replace(form, FILLER, " ")
    if own:
        bare = F.regexp_replace(bare, r"\b(?:" + "|".join(own) + r")\b", " ")
    return bound(F.trim(F.regexp_replace(bare, r"\s+", " ")), lambda left: F.when(F.length(left) >= 3, left))
