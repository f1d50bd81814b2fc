"""Scores of a pair from the sums over the terms its two texts share.

With the model fitted on the two texts alone, the idf of a term is 1 when both
have it and ``k = 1 + ln 1.5`` otherwise. So, with sums over the shared terms,

    dot    = sum tf1 * tf2
    norm_i = k^2 * mass_i - (k^2 - 1) * sum tf_i^2

and no per-pair fitting is needed. Only when a pair has more distinct terms than
``max_terms`` do the terms have to be ranked (``operators.capped``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.config import MatchConfig

K2 = (1 + math.log(1.5)) ** 2
SLACK = 1e-9
SUMS = ("kw_shared", "shared", "dot", "s1", "s2")


def keyword_score(kw_shared: Column, n_kw1: Column, n_kw2: Column) -> Column:
    """Share of common keywords; 0 when the job has none."""
    union = n_kw1 + n_kw2 - kw_shared
    return F.when(n_kw2 == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(kw_shared.cast("double"), union), F.lit(0.0)))


def tfidf_score(dot: Column, s1: Column, s2: Column, mass1: Column, mass2: Column) -> Column:
    norm1 = F.lit(K2) * mass1 - F.lit(K2 - 1) * s1
    norm2 = F.lit(K2) * mass2 - F.lit(K2 - 1) * s2
    product = norm1 * norm2
    return F.when(product > 0, dot / F.sqrt(product)).otherwise(F.lit(0.0))


def share_needed(cosine: float) -> float:
    """Share of a text's mass that has to be in shared terms to reach a cosine.

    From Cauchy-Schwarz: cosine^2 <= S / (k^2 (mass - S) + S) for each side.
    """
    b2 = cosine * cosine
    return b2 * K2 / (1 - b2 + b2 * K2)


def capped_bound(s1: Column, s2: Column, shared: Column, max_terms: int) -> Column:
    """Upper bound of the capped score from sums over all shared terms.

    Of the kept terms at least ``max_terms - shared`` are unshared, each with a
    count of 1 or more on one side; all of them on one side bounds every split.
    """
    most = F.greatest(s1, s2).cast("double")
    unshared = F.greatest(F.lit(max_terms) - shared, F.lit(0))
    return F.coalesce(F.sqrt(F.try_divide(most, F.lit(K2) * unshared + most)), F.lit(0.0))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles; 0 when one is missing or zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")),
            F.lit(0.0), lambda acc, p: acc + p)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def total_score(keyword: Column, tfidf: Column, semantic: Column, skills: Column,
                config: MatchConfig) -> Column:
    """Weighted sum as a percentage, at most 100, with no lower limit."""
    parts = {"keyword": keyword, "tfidf": tfidf, "semantic": semantic, "skills": skills}
    total = F.lit(0.0)
    for name, value in parts.items():
        total = total + value * F.lit(config.weight(name))
    return F.least(total * 100, F.lit(100.0))
