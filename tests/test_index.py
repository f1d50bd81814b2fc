"""Jobs scored against an index of the resumes, next to the direct computation and the other routes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocks
from matchloom.operators.index import fits_index, index_sums
from matchloom.operators.sides import job_side, resume_side
from matchloom.plans import matching
from tests.test_matching import check, config_of, direct, frames, sample

ON = {"index_rows": 4096}


@pytest.mark.parametrize("seed, weights, threshold, cap, semantic", [
    (1, (0.5, 0.5, 0.0, 0.0), 12, 1000, False),
    (2, (0.5, 0.5, 0.0, 0.0), 20, 25, False),
    (3, (0.2, 0.25, 0.25, 0.3), 62, 40, True),
    (4, (0.0, 1.0, 0.0, 0.0), 25, 30, False),
    (6, (0.2, 0.25, 0.25, 0.3), 30, 40, True),
    (7, (0.1, 0.4, 0.4, 0.1), 0, 20, True),
    (8, (0.2, 0.25, 0.25, 0.3), 25, None, False),
])
def test_index_equals_direct_scores(spark, monkeypatch, seed, weights, threshold, cap, semantic):
    monkeypatch.setattr(blocks, "RESUMES_PER_CELL", 5)
    config = config_of(weights, max_terms=cap, semantic=semantic, threshold=threshold, **ON)
    resumes, jobs = sample(seed)
    r, j, options = frames(spark, resumes, jobs)
    want = direct(resumes, jobs, config, threshold)
    assert want
    check(matching.score_matches(r, j, config, **options), want)


@pytest.mark.parametrize("seed, cap, n", [(11, 1000, 3), (12, 25, 5), (13, 25, 100), (14, None, 1)])
def test_best_of_many_batches(spark, seed, cap, n):
    """Small batches, so that a task carries its best totals over many of them; jobs repeat, so that ties occur."""
    config = config_of((0.2, 0.3, 0.3, 0.2), max_terms=cap, **ON)
    resumes, jobs = sample(seed)
    jobs = jobs + [(f"c{x[0]}", *x[1:]) for x in jobs]
    r, j, options = frames(spark, resumes, jobs)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        found = matching.score_matches(r, j.coalesce(1), config, threshold=0.0, top_n=n, **options).collect()
    finally:
        spark.conf.set(size, before)
    want = direct(resumes, jobs, config, 0.0)
    for file in {f for f, _ in want}:
        order = sorted(((-round(t, 2), job is not None, job or ""), job)
                       for (f, job), (t, _) in want.items() if f == file)[:n]
        got = sorted((m["rank"], m["job_id"]) for m in found if m["resume_file"] == file)
        assert [job for _, job in got] == [job for _, job in order]


def test_jobs_are_not_shuffled(spark):
    """Without vectors and entities there is no exchange between the jobs and their scores."""
    config = config_of((0.2, 0.3, 0.3, 0.2), semantic=False, **ON)
    resumes, jobs = sample(3)
    r, j, _ = frames(spark, resumes, jobs)
    left = matching.prepare_resumes(r, config)
    pairs = index_sums(left, job_side(j, config), config, 10.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_what_is_below_the_best_stays_in_the_task(spark):
    config = config_of((0.2, 0.3, 0.3, 0.2), **ON)
    resumes, jobs = sample(5, 8, 60)
    r, j, options = frames(spark, resumes, [*jobs] + [(f"{k}-{x[0]}", *x[1:]) for k in range(20) for x in jobs])
    left = matching.prepare_resumes(r, config, resume_vectors=options["resume_vectors"])
    right = spark.createDataFrame(job_side(j, config, options["job_vectors"]).toPandas(),
                                  job_side(j, config, options["job_vectors"]).schema).coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "20")
    try:
        n = index_sums(left, right, config, 0.0, 3).count()
    finally:
        spark.conf.set(size, before)
    assert 8 * 3 <= n < 8 * 3 * 63 / 2  # 63 batches


def test_only_small_sides_are_sent(spark):
    resumes, jobs = sample(6)
    r, j, options = frames(spark, resumes, jobs)
    side = matching.prepare_resumes(r, config_of((0.2, 0.3, 0.3, 0.2)), resume_vectors=options["resume_vectors"])
    held = side.select(F.sum(F.size("entries") + F.size("skills") + F.size("listed") + F.size("vec"))).first()[0]

    def fits(rows, entries):
        return fits_index(side, config_of((0.2, 0.3, 0.3, 0.2), index_rows=rows, index_entries=entries))

    assert fits(12, held) and not fits(11, held) and not fits(12, held - 1) and not fits(0, held)


def test_empty_sides_and_odd_rows(spark):
    """No resumes, no jobs, NULL file names, NULL skills inside a list, texts without words."""
    config = config_of((0.2, 0.25, 0.25, 0.3), threshold=0.0, **ON)
    resumes = [("a", "", [None, "java"], None), (None, "java", [], [1.0]), ("b", "java rest", ["java"], [])]
    jobs = [(None, None, None, None, None), ("1", "java", "", ["Java", None], [1.0]), ("2", "", "rest", [], [0.0])]
    r, j, options = frames(spark, resumes, jobs)
    found = {(x["resume_file"], x["job_id"]): x for x in matching.score_matches(r, j, config, **options).collect()}
    assert set(found) == {(f, i) for f in "ab" for i in (None, "1", "2")}
    assert found["b", None]["match_score"] == 30.0 and found["b", "1"]["matched_skills"] == []
    none = r.where(F.lit(False)), j.where(F.lit(False))
    assert matching.score_matches(none[0], j, config, **options).count() == 0
    assert matching.score_matches(r, none[1], config, **options).count() == 0


def test_encoded_terms():
    import pyarrow as pa

    one = blocks.Encoded(np.array([0, 0, 1]), pa.array(["x", "y", "x"]), np.array([1.0, 2.0, 3.0]))
    two = blocks.Encoded(np.array([0, 1, 1]), pa.array(["x", "z", "y"]), np.array([5.0, 1.0, 7.0]))
    count, dot, s1, s2 = blocks._shared(one, two, (2, 2))
    assert count.tolist() == [[1, 1], [1, 0]] and dot.tolist() == [[5, 14], [15, 0]]
    assert s1.tolist() == [[1, 4], [9, 0]] and s2.tolist() == [[25, 49], [25, 0]]
    assert pd.Series(one.terms).tolist() == ["x", "y"]
