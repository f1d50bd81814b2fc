"""Fields of a profile text: name, contacts, education, experience."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.functions.skills import escape_term
from matchloom.functions.text import bind, strip


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def person_name(text: Column) -> Column:
    """First of the top five lines that reads like a name of at most four words."""
    lines = F.transform(F.slice(F.split(strip(_text(text)), "\n"), 1, 5), strip)
    names = F.filter(lines, lambda x: (
        (F.length(x) >= 3)
        & ~x.rlike(r"[@#$%&*()0-9]")
        & x.rlike(r"(?U)^[A-Za-z\s\x1c-\x1f.]+$")
        & (F.size(F.split(x, r"(?U)[\s\x1c-\x1f]+")) <= 4)
    ))
    return F.coalesce(F.get(names, F.lit(0)), F.lit(lexicon.UNKNOWN))


def email(text: Column, pattern: str = lexicon.EMAIL_PATTERN) -> Column:
    return F.regexp_extract(_text(text), pattern, 0)


def phone(text: Column, patterns: Sequence[str] = lexicon.PHONE_PATTERNS) -> Column:
    """First hit of the first pattern that hits at all."""
    hits = [F.nullif(F.regexp_extract(_text(text), p, 0), F.lit("")) for p in patterns]
    return F.coalesce(*hits, F.lit(""))


def _link(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(_text(text), f"(?i){pattern}", 0)
    return F.when(found == "", "").otherwise(F.concat(F.lit("https://"), found))


def linkedin(text: Column, pattern: str = lexicon.LINKEDIN_PATTERN) -> Column:
    return _link(text, pattern)


def github(text: Column, pattern: str = lexicon.GITHUB_PATTERN) -> Column:
    return _link(text, pattern)


def education(text: Column, patterns: Sequence[str] = lexicon.DEGREE_PATTERNS) -> Column:
    """Each line that names a degree, with the line after it as details."""
    degree = "(?i)" + "|".join(f"(?:{p})" for p in patterns)

    def entries(lines: Column) -> Column:
        kept = F.filter(
            F.transform(lines, lambda x, i: F.when(x.rlike(degree), i)),
            lambda i: i.isNotNull(),
        )
        return F.transform(kept, lambda i: F.struct(
            strip(F.get(lines, i)).alias("degree"),
            strip(F.coalesce(F.get(lines, i + 1), F.lit(""))).alias("details"),
        ))

    return bind(F.split(_text(text), "\n"), entries)


def _any_term(terms: Sequence[str]) -> str:
    return "|".join(escape_term(t) for t in terms)


def experience(
    text: Column,
    starts: Sequence[str] = lexicon.EXPERIENCE_STARTS,
    stops: Sequence[str] = lexicon.EXPERIENCE_STOPS,
) -> Column:
    """Non-blank lines from the first header line up to the next closing line.

    The closing test covers the header line too, so a header that also holds a
    closing term gives an empty section.
    """
    start, stop = _any_term(starts), _any_term(stops)

    def section(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: F.lower(x).rlike(start)), True)
        return F.when(first > 0, bind(
            F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)),
            lambda rest: bind(
                F.array_position(F.transform(rest, lambda x: F.lower(x).rlike(stop)), True),
                lambda end: F.when(end > 0, F.slice(rest, F.lit(1), (end - 1).cast("int")))
                .otherwise(rest),
            ),
        )).otherwise(F.array().cast("array<string>"))

    body = bind(F.split(_text(text), "\n"), section)
    return F.filter(F.transform(body, strip), lambda x: x != "")
