"""What is kept up batch by batch: vectors by text, best rows per key, statistics."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.operators.best import BestTable
from matchloom.operators.vectors import VectorTable
from matchloom.plans import matching, reporting
from matchloom.plans.running import RunningStatistics
from tests.test_matching import config_of, frames, sample


def counting(seen):
    """An encoder that notes each text it gets as a file, since workers are other processes."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        for t in texts:
            (seen / uuid.uuid4().hex).write_text(t)
        return texts.map(lambda t: [float(len(t)), 1.0])

    return encode


def test_each_text_is_encoded_once_over_two_runs(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    table = VectorTable(spark, str(tmp_path / "vectors"), counting(seen))
    first = ["a", "b", "a", None, "", "long " * 1000] + ["hot"] * 300
    second = [*first, "c", "c"]
    for texts in (first, second):
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, text_hash string")
        got = {r["id"]: r for r in table.attach(df.repartition(3), "text").collect()}
        assert {i: (r["text"], list(r["vec"])) for i, r in got.items()} == {
            i: (t, [float(len(t or "")), 1.0]) for i, t in enumerate(texts)}
    assert sorted(f.read_text() for f in seen.iterdir()) == sorted({t or "" for t in second})


def test_a_match_with_stored_vectors(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    encode = counting(seen)
    resumes, jobs = sample(21, 3, 8)
    jobs = jobs + [(f"c{x[0]}", *x[1:]) for x in jobs]
    r, j, _ = frames(spark, resumes, jobs)
    config = config_of((0.2, 0.25, 0.25, 0.3), threshold=0.0, index_rows=4096)

    def scores(encoder):
        rows = matching.score_matches(r, j, config, encoder=encoder).collect()
        return sorted((x["resume_file"], x["job_id"] or "", x["match_score"]) for x in rows)

    plain = scores(encode)
    for f in seen.iterdir():
        f.unlink()
    table = VectorTable(spark, str(tmp_path / "vectors"), encode)
    assert scores(table) == plain and scores(table) == plain
    texts = [f.read_text() for f in seen.iterdir()]
    assert len(texts) == len(set(texts)) <= 11


def by_score():
    return [F.desc("match_score"), F.asc_nulls_first("job_id")]


def some_matches(spark, seed, n=400):
    """One resume has a third of all rows; scores tie; pairs repeat with other scores; ids may be NULL."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, *map(str, range(120))]), "hot" if i % 3 == 0 else rng.choice([None, *"abcdefg"]),
             float(rng.randint(0, 30))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "job_id string, resume_file string, match_score double")


@pytest.mark.parametrize("seed, cuts", [(1, [0, 400]), (2, [0, 1, 150, 150, 400]), (3, [0, 100, 200, 300, 400])])
def test_best_rows_of_any_split(spark, tmp_path, seed, cuts):
    rows, every = some_matches(spark, seed)
    table = BestTable(spark, str(tmp_path / "best"), ["resume_file"], ["job_id"], by_score, 4)
    assert table.read() is None
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(rows[a:b], every.schema)
        table.merge(part, k)
        once = sorted(map(str, table.read().collect()))
        table.merge(part, k)  # a replay
        assert sorted(map(str, table.read().collect())) == once
    table.merge(every, 0)  # a late replay of a batch that was replaced, unless it is the only one
    want = {}
    for job, resume, score in sorted(set(rows), key=lambda x: (-x[2], x[0] is not None, x[0] or "")):
        mine = want.setdefault(resume, [])
        if len(mine) < 4 and job not in [j for j, _ in mine]:
            mine.append((job, score))
    got = {}
    for r in sorted(table.read().collect(), key=lambda r: r["rank"]):
        got.setdefault(r["resume_file"], []).append((r["job_id"], r["match_score"]))
    assert got == want and len(table.versions()) <= 2


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    rows, every = some_matches(spark, 4)
    table = BestTable(spark, str(tmp_path / "best"), ["resume_file"], ["job_id"], by_score, 4)
    table.merge(every, 0)
    before = sorted(map(str, table.read().collect()))
    broken = tmp_path / "best" / "version=000000000001"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert sorted(map(str, table.read().collect())) == before
    table.merge(every, 1)
    assert sorted(map(str, table.read().collect())) == before


@pytest.mark.parametrize("cuts", [[0, 400], [0, 1, 150, 400]])
def test_statistics_by_batch(spark, tmp_path, cuts):
    rows, matches = some_matches(spark, 5)
    rows = [(j, r, s + 0.07) for j, r, s in rows]
    matches = spark.createDataFrame(rows, matches.schema)
    jobs = spark.createDataFrame([(None, "none")] + [(str(i), None if i % 5 == 0 else f"co{i % 7}") for i in range(100)],
                                 "job_id string, company string")
    running = RunningStatistics(spark, str(tmp_path / "sums"))
    assert running.statistics().first().asDict() == {"total_jobs": 0, "total_matches": 0, "avg_match_score": 0.0, "top_companies": []}
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        new = jobs if k == 0 else jobs.limit(0)
        for _ in range(2):  # a replay replaces its own sums
            running.add(new, spark.createDataFrame(rows[a:b], matches.schema), jobs, f"b{k}")
    got, want = running.statistics().first(), reporting.statistics(jobs, matches).first()
    assert got["avg_match_score"] == pytest.approx(want["avg_match_score"])
    assert [got[c] for c in ("total_jobs", "total_matches", "top_companies")] == [
        want[c] for c in ("total_jobs", "total_matches", "top_companies")]
    plan = running.statistics()._jdf.queryExecution().analyzed().toString()
    assert "job_id" not in plan  # sums only, no rows of jobs or matches
