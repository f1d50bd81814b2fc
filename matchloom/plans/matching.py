"""Match resumes with jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import MatchConfig
from matchloom.functions.skills import matched_skills, skill_coverage
from matchloom.functions.text import computed_once
from matchloom.operators.blocks import block_sums
from matchloom.operators.capped import capped_tfidf
from matchloom.operators.index import fits_index, index_sums
from matchloom.operators.keys import spread_lookup, top_per_key
from matchloom.operators.scoring import (
    SLACK, capped_bound, keyword_score, tfidf_score, total_score, vector_cosine,
)
from matchloom.operators.shared import materialize
from matchloom.operators.sides import Encoder, counted, job_side, resume_side
from matchloom.operators.term_join import pruned_sums

def by_score() -> list[Column]:
    """Best first; equal scores by job id."""
    return [F.desc("match_score"), F.asc("job_id")]


def text_need(config: MatchConfig, threshold: float) -> float:
    """What the text scores must add when the other parts are at their best."""
    return threshold / 100 - config.other_weight


def score_pairs(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame, config: MatchConfig,
                threshold: float) -> DataFrame:
    """Exact scores of pairs with their sums; drops totals below the threshold.

    The threshold is applied to the total as computed, rounding comes after.
    """
    joined = pairs
    if "n_kw1" not in pairs.columns:  # pairs from an index bring what is needed of both sides
        light = ["n_kw", "n_terms", "mass", "skills", "vec"]
        left, right = (
            side.select(F.col("key").alias(key), *[F.col(c).alias(f"{c}{n}") for c in light])
            for side, key, n in ((resumes, "r", 1), (jobs, "j", 2)))
        joined = pairs.join(left, "r").join(right, "j")
    listed = [c for c in ("listed1", "listed2") if c in pairs.columns]
    c = F.col
    semantic = vector_cosine(c("vec1"), c("vec2")) if config.semantic else F.lit(0.0)
    tfidf = tfidf_score(c("dot"), c("s1"), c("s2"), c("mass1"), c("mass2"))
    settled = "capped" in pairs.columns  # pairs over the limit on terms bring their score
    if settled:
        tfidf = F.coalesce("capped", tfidf)
    scored = joined.select(
        "r", "j", "s1", "s2", "shared", *listed,
        (c("n_terms1") + c("n_terms2") - c("shared")).alias("n_terms"),
        computed_once(
            keyword_score(c("kw_shared"), c("n_kw1"), c("n_kw2")).alias("keyword"),
            tfidf.alias("tfidf"),
            semantic.alias("semantic"),
            skill_coverage(c("skills1"), c("skills2")).alias("skills"),
        ),
    )
    total = total_score(c("keyword"), c("tfidf"), c("semantic"), c("skills"), config)
    parts = ["r", "j", "keyword", "tfidf", "semantic", "skills", *listed]
    if config.max_terms is None or settled:
        done = scored.select(*parts)
    else:
        over = c("n_terms") > config.max_terms
        bound = F.when(over, capped_bound(c("s1"), c("s2"), c("shared"), config.max_terms))
        best = scored.withColumn("tfidf", F.coalesce(bound, c("tfidf")))
        best = materialize(best.where(total >= threshold - SLACK).select(*parts, "n_terms"),
                           "scored")
        long = best.where(over)
        ranked = long.drop("tfidf").join(
            capped_tfidf(long, resumes, jobs, config.max_terms)
            .withColumnRenamed("capped", "tfidf"), ["r", "j"])
        done = best.where(~over).select(*parts).unionByName(ranked.select(*parts))
    return done.withColumn("total", total).where(c("total") >= threshold)


def prepare_resumes(
    resumes: DataFrame,
    config: MatchConfig,
    *,
    resume_vectors: DataFrame | None = None,
    resume_entities: DataFrame | None = None,
    encoder: Encoder | None = None,
) -> DataFrame:
    """The resume side of a match as a stored table."""
    return materialize(counted(
        resume_side(resumes, config, resume_vectors if config.semantic else None, resume_entities,
                    encoder if config.semantic else None)), "resume-side")


def score_matches(
    resumes: DataFrame,
    jobs: DataFrame,
    config: MatchConfig,
    *,
    threshold: float | None = None,
    top_n: int | None = None,
    resume_vectors: DataFrame | None = None,
    job_vectors: DataFrame | None = None,
    resume_entities: DataFrame | None = None,
    job_entities: DataFrame | None = None,
    encoder: Encoder | None = None,
    prepared_resumes: DataFrame | None = None,
) -> DataFrame:
    """``(job_id, resume_file, match_score, score_breakdown, matched_skills)``.

    ``resumes`` are parsed records, ``jobs`` have unique ids. Vectors come as tables
    ``(resume_file | job_id, embedding)`` or from ``encoder``, a function from a text
    column to an ``array<float>`` column (a pandas UDF, say). Runs that repeat with the
    same resumes pass them as ``prepared_resumes`` (see :func:`prepare_resumes`).
    """
    threshold = config.threshold if threshold is None else threshold
    left = prepared_resumes
    if left is None:
        left = prepare_resumes(resumes, config, resume_vectors=resume_vectors,
                               resume_entities=resume_entities, encoder=encoder)
    right = job_side(jobs, config, job_vectors if config.semantic else None, job_entities,
                     encoder if config.semantic else None)
    need = text_need(config, threshold)
    indexed = fits_index(left, config)
    if indexed:  # the jobs are read once and go nowhere
        pairs = index_sums(left, right, config, threshold, top_n)
    else:
        right = materialize(counted(right), "job-side")
        if need > 0:
            pairs = pruned_sums(left, right, config, need)
        else:
            pairs = block_sums(left, right, config, threshold, top_n)
    scored = score_pairs(pairs, left, right, config, threshold).select(
        F.when(F.col("j") != "", F.expr("substring(j, 2)")).alias("job_id"),
        F.col("r").alias("resume_file"), "r", "j",
        F.round("total", 2).alias("match_score"),
        F.struct("keyword", "tfidf", "semantic", "skills").alias("score_breakdown"),
        *(["listed1", "listed2"] if indexed else []),
    )
    if top_n is not None:
        scored = top_per_key(scored, ["resume_file"], by_score(), top_n)
    if not indexed:
        scored = scored.join(left.select(F.col("key").alias("r"), F.col("listed").alias("listed1")), "r").join(
            right.select(F.col("key").alias("j"), F.col("listed").alias("listed2")), "j")
    found = scored.select(
        "job_id", "resume_file", "match_score", "score_breakdown",
        matched_skills(F.col("listed1"), F.col("listed2")).alias("matched_skills"),
        *(["rank"] if top_n is not None else []))
    # As a table, matches have a known size: look-ups send few of them to the job rows, not those to them, and
    # count the keys that many of them share.
    return materialize(found, "matches")


def match_records(matches: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Matches, a stored table, with the fields of their job and resume."""
    job = jobs.select(
        "job_id", F.col("title").alias("job_title"), "company", "location",
        F.col("url").alias("job_url"), F.struct(*jobs.columns).alias("job_data"))
    resume = resumes.select(
        "resume_file",
        F.struct("name", "email", "phone", F.size("skills").alias("skills_count"))
        .alias("resume_data"))
    joined = spread_lookup(
        spread_lookup(matches, resume, ["resume_file"]), job, ["job_id"], counted=matches)
    return joined.select(
        "job_id", "job_title", "company", "location", "job_url", "match_score", "score_breakdown",
        "matched_skills", "job_data", "resume_data", "resume_file",
        *[c for c in ("rank",) if c in matches.columns])


def match(resumes: DataFrame, jobs: DataFrame, config: MatchConfig, **options) -> DataFrame:
    """Full match records of all pairs at or above the threshold, in no set order."""
    return match_records(score_matches(resumes, jobs, config, **options), resumes, jobs)


def best_matches(resumes: DataFrame, jobs: DataFrame, config: MatchConfig, n: int = 10,
                 **options) -> DataFrame:
    """The ``n`` best jobs of each resume, negative totals left out."""
    scored = score_matches(resumes, jobs, config, threshold=0.0, top_n=n, **options)
    return match_records(scored, resumes, jobs)


def sorted_matches(matches: DataFrame) -> DataFrame:
    """Matches per resume, best first; equal scores by job id."""
    return matches.orderBy(F.asc("resume_file"), *by_score())
