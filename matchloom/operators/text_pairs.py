"""Single scores over all pairs that reach a given value."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import MatchConfig
from matchloom.operators.blocks import block_sums
from matchloom.operators.scoring import (
    SLACK, capped_bound, keyword_score, tfidf_score, vector_cosine,
)
from matchloom.functions.skills import skill_coverage
from matchloom.functions.text import computed_once
from matchloom.operators.capped import capped_tfidf
from matchloom.operators.index import fits_index, index_sums
from matchloom.operators.shared import materialize
from matchloom.operators.sides import KEYWORD, TERM, counted
from matchloom.operators.term_join import pruned_sums


def _only(config: MatchConfig, part: str) -> MatchConfig:
    weights = dict.fromkeys(("keyword", "tfidf", "semantic", "skills"), 0.0)
    return replace(config, weights={**weights, part: 1.0}, semantic=part == "semantic")


def _of_kind(side: DataFrame, kind: int) -> DataFrame:
    return side.withColumn("entries", F.filter("entries", lambda e: e["kind"] == kind))


def _indexed(resumes: DataFrame, jobs: DataFrame, config: MatchConfig, part: str, least: float) -> DataFrame | None:
    """Sums of the pairs that may have ``least`` in one text score, if the resumes fit an index; jobs go nowhere then.

    The index has a pair per row, the terms one per key, so sides with repeated keys go by the terms. Rows without a
    key are in no pair.
    """
    if "words" not in jobs.columns or not fits_index(text_only(resumes), config) or _repeats(resumes) or _repeats(jobs):
        return None
    return index_sums(text_only(resumes), text_only(jobs).where(F.col("key").isNotNull()), _only(config, part), 100 * least)


def _repeats(side: DataFrame) -> bool:
    keys = side.where(F.col("key").isNotNull()).groupBy("key").count()
    return not keys.where(F.col("count") > 1).isEmpty()


def text_only(side: DataFrame) -> DataFrame:
    """A side of bare texts with the columns of a whole one."""
    none = {"skills": "array<string>", "listed": "array<string>", "vec": "array<float>"}
    return side.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})


def _stats(side: DataFrame, key: str, n: int, *columns: str) -> DataFrame:
    return side.select(F.col("key").alias(key), *[F.col(c).alias(f"{c}{n}") for c in columns])


def _minimum(value: float) -> float:
    if value <= 0:
        raise ValueError("the least score has to be above 0")
    return value


def keyword_pairs(resumes: DataFrame, jobs: DataFrame, config: MatchConfig,
                  least: float) -> DataFrame:
    """``(r, j, shared, score)`` of all pairs with a keyword score of ``least`` or more.

    Few resumes, as a stored side, take the index if the jobs still have their words.
    """
    score = keyword_score(F.col("kw_shared"), F.col("n_kw1"), F.col("n_kw2"))
    sums = _indexed(resumes, jobs, config, "keyword", _minimum(least))
    if sums is not None:
        return sums.select("r", "j", F.col("kw_shared").alias("shared"), score.alias("score")).where(
            F.col("score") >= least)
    resumes, jobs = _of_kind(resumes, KEYWORD), materialize(counted(_of_kind(jobs, KEYWORD)), "jobs")
    sums = pruned_sums(resumes, jobs, _only(config, "keyword"), least)
    return (
        sums.join(_stats(resumes, "r", 1, "n_kw"), "r").join(_stats(jobs, "j", 2, "n_kw"), "j")
        .select("r", "j", F.col("kw_shared").alias("shared"), score.alias("score"))
        .where(F.col("score") >= least)
    )


def tfidf_pairs(resumes: DataFrame, jobs: DataFrame, config: MatchConfig,
                least: float) -> DataFrame:
    """``(r, j, score)`` of all pairs with a TF-IDF score of ``least`` or more.

    Few resumes, as a stored side, take the index if the jobs still have their words.
    """
    c = F.col
    score = tfidf_score(c("dot"), c("s1"), c("s2"), c("mass1"), c("mass2"))
    sums = _indexed(resumes, jobs, config, "tfidf", _minimum(least))
    if sums is not None:
        return sums.select("r", "j", F.coalesce("capped", score).alias("score")).where(c("score") >= least)
    resumes, jobs = _of_kind(resumes, TERM), materialize(counted(_of_kind(jobs, TERM)), "jobs")
    sums = pruned_sums(resumes, jobs, _only(config, "tfidf"), least)
    pairs = (
        sums.join(_stats(resumes, "r", 1, "mass", "n_terms"), "r")
        .join(_stats(jobs, "j", 2, "mass", "n_terms"), "j")
        .select("r", "j", score.alias("score"), "s1", "s2", "shared",
                (c("n_terms1") + c("n_terms2") - c("shared")).alias("n_terms"))
    )
    if config.max_terms is None:
        return pairs.where(c("score") >= least).select("r", "j", "score")
    over = c("n_terms") > config.max_terms
    bound = capped_bound(c("s1"), c("s2"), c("shared"), config.max_terms)
    pairs = materialize(
        pairs.where(F.when(over, bound).otherwise(c("score")) >= least - SLACK)
        .select("r", "j", "score", "n_terms"), "tfidf")
    ranked = capped_tfidf(pairs.where(over), resumes, jobs, config.max_terms).withColumnRenamed(
        "capped", "score")
    columns = ["r", "j", "score"]
    return pairs.where(~over).select(*columns).unionByName(ranked.select(*columns)).where(
        c("score") >= least)


def vector_pairs(resumes: DataFrame, jobs: DataFrame, config: MatchConfig,
                 least: float) -> DataFrame:
    """``(r, j, score)`` of all pairs with a vector cosine of ``least`` or more."""
    sums = block_sums(resumes, jobs, _only(config, "semantic"), 100 * least)
    score = vector_cosine(F.col("vec1"), F.col("vec2"))
    return (
        sums.select("r", "j").join(_stats(resumes, "r", 1, "vec"), "r")
        .join(_stats(jobs, "j", 2, "vec"), "j")
        .select("r", "j", computed_once(score.alias("score"))).where(F.col("score") >= least)
    )


def skill_pairs(resumes: DataFrame, jobs: DataFrame, config: MatchConfig,
                least: float) -> DataFrame:
    """``(r, j, score)`` of all pairs with a skill coverage of ``least`` or more."""
    sums = block_sums(resumes, jobs, _only(config, "skills"), 100 * least)
    score = skill_coverage(F.col("skills1"), F.col("skills2"))
    return (
        sums.select("r", "j").join(_stats(resumes, "r", 1, "skills"), "r")
        .join(_stats(jobs, "j", 2, "skills"), "j")
        .select("r", "j", computed_once(score.alias("score"))).where(F.col("score") >= least)
    )


def bare_side(docs: DataFrame) -> DataFrame:
    """Side of ``(key, vec, skills)`` rows without text."""
    return docs.select(
        "key", "vec", "skills",
        F.array().cast("array<struct<kind:tinyint,term:string,tf:int>>").alias("entries"),
        *[F.lit(0).alias(c) for c in ("n_kw", "n_terms")], F.lit(0).cast("long").alias("mass"))
