"""URLs, and which parts of captured pages hold what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Percent codes on which the two encodings differ.
QUOTE_FIXES = (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A"))


def job_id_from_url(url: Column) -> Column:
    """Text after the last ``-``, cut at the first ``?`` that follows; '' without a URL."""
    tail = F.substring_index(F.coalesce(url, F.lit("")), "-", -1)
    return F.substring_index(tail, "?", 1)


def percent_encode(value: Column) -> Column:
    """Percent-encode all but letters, digits and ``_ . - ~ /``."""
    encoded = F.url_encode(value)
    for old, new in QUOTE_FIXES:
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded


def search_url(base_url: str, keywords: Column, location: Column, exp_min: Column,
               exp_max: Column) -> Column:
    """``base/jobs?k=..&l=..&experience=lo-hi``; empty parts are left out."""

    def part(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "",
                      F.concat(F.lit(f"{name}="), percent_encode(value)))

    experience = F.concat(F.lit("experience="), exp_min.cast("string"), F.lit("-"),
                          exp_max.cast("string"))
    query = F.concat_ws("&", part("k", keywords), part("l", location), experience)
    return F.concat(F.lit(f"{base_url.rstrip('/')}/jobs?"), query)


@dataclass(frozen=True)
class CardSelectors:
    """Selectors of a listing page; all but ``card`` apply below a card."""

    card: str = ".list article"
    title: str = ".title"
    link: str = ".title"
    company: str = ".comp-name"
    location: str = ".loc-wrap span"
    experience: str = ".exp-wrap span"
    salary: str = ".sal-wrap span"
    skill: str = ".tags-gt li"
    posted_date: str = ".job-post-day"


@dataclass(frozen=True)
class DetailSelectors:
    """Selectors of a detail page."""

    title: str = ".jd-header h1"
    company: str = ".jd-header .comp-name"
    description: str = ".job-desc"
    header_span: str = ".jd-header .exp-sal-loc span"
    skill: str = ".key-skill a"
    detail_span: str = ".detail span"
