"""Skill extraction."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.functions import lexicons
from matchloom.functions.text import bind, lowered, or_empty, string_array


AUTOMATON_FROM = 256  # terms from which on a lexicon is an automaton, not an expression per term


def escape_term(term: str) -> str:
    """Quote what a regular expression would read as syntax (Java and RE2 alike)."""
    return re.sub(r"([.+*?^$()\[\]{}|\\])", r"\\\1", term)


def tag_pattern(terms: Sequence[str]) -> str:
    return r"\b(" + "|".join(escape_term(t) for t in terms) + r")\b"


def _guarded(terms: Sequence[str]) -> str:
    """The same pattern behind a look at the first letter, which fails fast."""
    return "(?=[" + "".join(escape_term(c) for c in sorted({t[0] for t in terms})) + "])" + tag_pattern(terms)


def _apart(terms: Sequence[str]) -> bool:
    """Whether no two of the terms can overlap in a text as whole words, so that one pass finds what each alone would.

    A term that begins inside another one begins at a later word of it; of two that begin at one place, one begins
    with the other.
    """
    words = {t: re.findall("[a-z0-9_]+", t) for t in terms}
    if not all(re.match("[a-z0-9_]", t) and t.isascii() and t == t.lower() and "\n" not in t for t in words):
        return False
    firsts = {w[0] for w in words.values()}
    return not any(firsts & set(w[1:]) for w in words.values()) and not any(
        a != b and words[a][0] == words[b][0] and a.startswith(b) for a in words for b in words)


def _by_letter(terms: Sequence[str]) -> str:
    """A pattern of all the terms whose alternatives part at the first letter."""
    letters = sorted({t[0] for t in terms})
    ends = {c: [escape_term(t[1:]) for t in dict.fromkeys(terms) if t[0] == c] for c in letters}
    return (rf"(?=[{''.join(letters)}])\b("
            + "|".join(f"{c}(?:{'|'.join(e)})" for c, e in ends.items()) + r")\b")


def skill_tags(text: Column, groups: Sequence[Sequence[str]] = lexicon.SKILL_TAG_GROUPS) -> Column:
    """Listed terms that stand as whole words in the text, each once. Large groups of terms take an automaton."""
    return tags_in(lowered(text), groups)


def tags_in(low: Column, groups: Sequence[Sequence[str]]) -> Column:
    """:func:`skill_tags` of a text that is lower-cased."""
    small = [g for g in groups if len(g) < AUTOMATON_FROM]
    every = [t for g in groups for t in g]
    if len(small) == len(groups) > 1 and _apart(every):  # one pass, then by group as the passes per group would
        found = F.array_distinct(F.regexp_extract_all(low, F.lit(_by_letter(every)), F.lit(1)))
        return bind(found, lambda tags: F.array_distinct(F.concat(
            *[F.array_intersect(tags, string_array(g)) for g in groups])))
    if len(small) == len(groups):
        return bind(low, lambda once: F.array_distinct(F.concat(
            *[F.regexp_extract_all(once, F.lit(_guarded(g)), F.lit(1)) for g in groups])))
    # A function of Python can't be inside a lambda.
    return F.array_distinct(F.concat(*[
        F.regexp_extract_all(low, F.lit(_guarded(g)), F.lit(1)) if len(g) < AUTOMATON_FROM
        else lexicons.whole_words(low, g) for g in groups]))


def skill_substrings(text: Column, terms: Sequence[str] = lexicon.SKILL_SUBSTRINGS) -> Column:
    """Listed terms that occur anywhere in the text, inside words too. A large list takes an automaton."""
    unique = list(dict.fromkeys(terms))
    if len(unique) >= AUTOMATON_FROM:
        return lexicons.substrings(F.lower(F.coalesce(text, F.lit(""))), unique)
    hits = bind(F.lower(F.coalesce(text, F.lit(""))), lambda lowered: F.array(
        *[F.when(F.contains(lowered, F.lit(t)), F.lit(t)) for t in unique]))
    return F.array_compact(hits)


def skill_phrases(
    text: Column,
    patterns: Sequence[str] = lexicon.SKILL_PHRASE_PATTERNS,
    length: tuple[int, int] = lexicon.SKILL_PHRASE_LENGTH,
) -> Column:
    """Capitalised phrases and acronyms of a plausible length, lower-cased, each once."""
    source = F.coalesce(text, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(source, F.lit(p), F.lit(1)) for p in patterns])
    low, high = length
    kept = F.filter(found, lambda p: (F.length(p) > low) & (F.length(p) < high))
    return F.array_distinct(F.transform(kept, lambda p: F.lower(p)))


def resume_skills(text: Column, terms: Sequence[str] = lexicon.SKILL_SUBSTRINGS) -> Column:
    """All skills of a profile text, sorted so that results repeat."""
    both = F.array_union(skill_substrings(text, terms), skill_phrases(text))
    return F.sort_array(both)


def lower_set(skills: Column) -> Column:
    return F.array_distinct(F.transform(or_empty(skills), lambda s: F.lower(s)))


def skill_coverage(resume_skills: Column, job_skills: Column) -> Column:
    """Share of the required skills that the resume has; 1 when none is required."""
    have, need = lower_set(resume_skills), lower_set(job_skills)
    return F.when(F.size(need) == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.size(F.array_intersect(have, need)).cast("double"), F.size(need))
    )


def matched_skills(resume_skills: Column, job_skills: Column) -> Column:
    """Skills listed on both sides as written (letter case counts), sorted."""
    return F.sort_array(F.array_intersect(or_empty(resume_skills), or_empty(job_skills)))


def all_skills(listed: Column, extracted: Column, *more: Column) -> Column:
    return F.array_distinct(F.concat(or_empty(listed), or_empty(extracted),
                                     *[or_empty(m) for m in more]))


__all__ = [
    "all_skills", "escape_term", "lower_set", "matched_skills", "resume_skills", "skill_coverage",
    "skill_phrases", "skill_substrings", "skill_tags", "string_array", "tag_pattern",
]
