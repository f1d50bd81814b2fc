"""Pairs that share terms, found and summed through the terms.

:func:`pruned_sums` finds
the pairs whose text score can reach a needed value without joining the terms
that most documents have, and is exact. It is prefix filtering as published for
set similarity joins, carried over to the two text scores used here:

* ``w_k * M1 + w_t * M2 >= need`` implies ``M1 >= x`` or ``M2 >= x`` for
  ``x = need / (w_k + w_t)``.
* ``M1 >= x`` needs shared keywords to be a share ``x`` of either side's keywords.
* ``M2 >= x`` needs the shared terms to hold a share ``g = share_needed(x)`` of
  either side's mass. Where the limit on terms may apply, it needs shared mass
  ``g * max_terms`` on at least one side.
* Terms are put in one global order, those with the most (resume, job) pairs
  last. A term of a document is *weak* when it and all later terms of that
  document together stay below what is needed, and *strong* otherwise. The first
  shared term of a pair that reaches the need is then strong on both sides (or on
  one side, where the limit applies).

So weak-weak combinations, which is where the frequent terms meet, are never
joined; they are added afterwards for the few pairs that are still in play.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.config import MatchConfig
from matchloom.operators.scoring import (
    K2, SLACK, SUMS, capped_bound, keyword_score, share_needed,
)
from matchloom.operators.shared import materialize
from matchloom.operators.sides import KEYWORD, TERM

ENTRY_KEY = ["kind", "term"]


def postings(side: DataFrame, *more: str) -> DataFrame:
    return side.select("key", *more, F.inline("entries"))


def _sums(pairs: DataFrame) -> DataFrame:
    """Sums per pair over rows ``(r, j, kind, tf1, tf2)``."""
    a, b = F.col("tf1").cast("long"), F.col("tf2").cast("long")
    is_term = F.col("kind") == TERM

    def over_terms(value: Column) -> Column:
        return F.sum(F.when(is_term, value).otherwise(F.lit(0)))

    return pairs.groupBy("r", "j").agg(
        F.sum(F.when(is_term, F.lit(0)).otherwise(F.lit(1))).alias("kw_shared"),
        over_terms(F.lit(1)).alias("shared"),
        over_terms(a * b).alias("dot"),
        over_terms(a * a).alias("s1"),
        over_terms(b * b).alias("s2"),
    )


def _requirements(side: DataFrame, need: float, config: MatchConfig) -> DataFrame:
    """Add what a document has to share, in keywords and in term mass."""
    w_k, w_t = config.weight("keyword"), config.weight("tfidf")
    x = need / (w_k + w_t)
    share = share_needed(x) if x < 1 else x
    mass = F.col("mass") if config.max_terms is None else F.least(
        F.col("mass"), F.lit(config.max_terms))
    never = F.lit(float("inf"))
    return side.withColumns({
        "req_kw": F.col("n_kw") * F.lit(x) if w_k > 0 else never,
        "req_mass": mass * F.lit(share) if w_t > 0 else never,
    })


def _flag(rows: DataFrame, name: str) -> DataFrame:
    """Mark the strong entries of each document."""
    to_last = (Window.partitionBy("key", "kind").orderBy(F.desc("heat"), F.desc("term"))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = F.sum(F.col("tf").cast("long") * F.col("tf")).over(to_last)
    required = F.when(F.col("kind") == KEYWORD, F.col("req_kw")).otherwise(F.col("req_mass"))
    return materialize(
        rows.withColumn("strong", rest >= required * (1 - SLACK))
        .select("key", "kind", "term", "tf", "strong"), name)


def _strong_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of shared entries that are strong on a side at least.

    The three combinations are three join keys, so that two weak entries never meet.
    """

    def classed(rows: DataFrame, strong: list[int], weak: list[int], key: str, tf: str):
        lists = [F.array(*[F.lit(c) for c in classes]) for classes in (strong, weak)]
        return rows.select(
            F.col("key").alias(key), "kind", "term", F.col("tf").alias(tf),
            F.explode(F.when(F.col("strong"), lists[0]).otherwise(lists[1])).alias("combination"))

    return classed(left, [0, 1], [2], "r", "tf1").join(
        classed(right, [0, 2], [1], "j", "tf2"), [*ENTRY_KEY, "combination"])


def _stats(side: DataFrame, key: str, n: int) -> DataFrame:
    return side.select(F.col("key").alias(key), *[
        F.col(c).alias(f"{c}{n}") for c in ("n_kw", "n_terms", "mass", "req_kw", "req_mass")])


def _within_reach(config: MatchConfig, need: float) -> Column:
    """Whether a pair can reach the need, its weak-weak entries still missing."""
    c = F.col
    kw = F.least(c("kw_shared") + F.least("req_kw1", "req_kw2"), c("n_kw1"), c("n_kw2"))
    m1 = keyword_score(kw, c("n_kw1"), c("n_kw2"))
    s1 = F.least(c("s1") + c("req_mass1"), c("mass1"))
    s2 = F.least(c("s2") + c("req_mass2"), c("mass2"))

    def share(s: Column, mass: Column) -> Column:
        return F.coalesce(F.try_divide(s, F.lit(K2) * (mass - s) + s), F.lit(0.0))

    m2 = F.sqrt(share(s1, c("mass1")) * share(s2, c("mass2")))
    if config.max_terms is not None:
        shared = c("shared") + F.least(s1 - c("s1"), s2 - c("s2"))
        over = c("n_terms1") + c("n_terms2") - c("shared") > config.max_terms
        m2 = F.when(over, F.greatest(m2, capped_bound(s1, s2, shared, config.max_terms))).otherwise(m2)
    total = (F.least(m1, F.lit(1.0)) * config.weight("keyword")
             + F.least(m2, F.lit(1.0)) * config.weight("tfidf"))
    return total >= need - SLACK


def pruned_sums(resumes: DataFrame, jobs: DataFrame, config: MatchConfig, need: float) -> DataFrame:
    """Sums of the pairs whose text part ``w_k M1 + w_t M2`` may reach ``need > 0``."""
    if config.weight("keyword") + config.weight("tfidf") == 0:  # the text part is 0
        return resumes.sparkSession.createDataFrame(
            [], "r string, j string, " + ", ".join(f"{c} long" for c in SUMS))
    resumes, jobs = (_requirements(s, need, config) for s in (resumes, jobs))
    left, right = (postings(s, "req_kw", "req_mass") for s in (resumes, jobs))
    # Only entries that occur on both sides can be shared. The counts are small
    # rows that aggregate before the shuffle; the optimizer broadcasts them where
    # their measured size allows.
    in_resumes = left.groupBy(*ENTRY_KEY).agg(F.count("*").alias("n_r"))
    right = right.join(in_resumes, ENTRY_KEY)
    heat = right.groupBy(*ENTRY_KEY).agg((F.count("*") * F.max("n_r")).alias("heat"))
    heat = materialize(heat, "heat")
    left = _flag(left.join(heat, ENTRY_KEY), "resume-postings")
    right = _flag(right.join(heat, ENTRY_KEY), "job-postings")

    in_reach = materialize(
        _sums(_strong_pairs(left, right))
        .join(_stats(resumes, "r", 1), "r").join(_stats(jobs, "j", 2), "j")
        .where(_within_reach(config, need))
        .select("r", "j", *SUMS), "pairs")

    weak_left = left.where(~F.col("strong")).select(
        F.col("key").alias("r"), "kind", "term", F.col("tf").alias("tf1"))
    weak_right = right.where(~F.col("strong")).select(
        F.col("key").alias("j"), "kind", "term", F.col("tf").alias("tf2"))
    missing = _sums(in_reach.select("r", "j").join(weak_left, "r").join(
        weak_right, ["j", *ENTRY_KEY]))
    return in_reach.unionByName(missing).groupBy("r", "j").agg(
        *[F.sum(c).alias(c) for c in SUMS])
