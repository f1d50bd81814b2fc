"""Whole runs over a store: ingest, match, both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import MatchConfig
from matchloom.operators.keys import null_safe_anti
from matchloom.operators.store import MATCH_KEY, Store
from matchloom.plans.matching import by_score, score_matches


def ingest(store: Store, incoming: DataFrame, batch: str, now: Column, order=None, again: bool = False) -> DataFrame:
    """Insert the unseen jobs; returns them, and with ``again`` those of a broken attempt at the batch too."""
    order = order or [F.asc(c) for c in ("batch_no", "page_id", "card_no", "seq")
                      if c in incoming.columns]
    if not order:
        raise ValueError("name the columns that order the incoming rows")
    return store.save_jobs(incoming, batch, order, now, again)


def match_new(
    store: Store,
    resumes: DataFrame,
    config: MatchConfig,
    batch: str,
    now: Column,
    jobs: DataFrame | None = None,
    mode: str = "job",
    **options,
) -> DataFrame:
    """Score jobs with all resumes and insert the new matches; returns those.

    Without ``jobs`` the stored jobs are taken: in mode ``job`` those without any
    match, so a job that one resume matched is not shown to a later resume; in mode
    ``pair`` all of them, and only pairs already stored are left out.
    """
    if mode not in ("job", "pair"):
        raise ValueError(f"unknown mode {mode!r}")
    if jobs is None:
        jobs = store.unmatched_jobs() if mode == "job" else store.jobs()
    if "job_vectors" not in options and "job_entities" not in options:
        # A store of small batches reads as few tasks, too few for the text work. (The
        # joins with vectors or entities bring their own partitioning.)
        partitions = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
        jobs = jobs.repartition(partitions, "job_id")
    found = score_matches(resumes, jobs, config, **options)
    if mode == "pair":
        found = null_safe_anti(found, store.matches(), MATCH_KEY)
    return store.save_matches(found, batch, by_score(), now)


def full_run(store: Store, incoming: DataFrame, resumes: DataFrame, config: MatchConfig,
             batch: str, now: Column, order=None, again: bool = False, **options) -> DataFrame:
    """Ingest, then match what was new; returns the new matches.

    ``again``: the batch may be a repeated one, of which jobs were stored but not matched yet.
    """
    fresh = ingest(store, incoming, batch, now, order, again)
    return match_new(store, resumes, config, batch, now, jobs=fresh, **options)
