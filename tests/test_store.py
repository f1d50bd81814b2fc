"""Insert-only tables, reports and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.config import MatchConfig
from matchloom.operators.keys import rank_all, top_per_key
from matchloom.operators.store import Store, latest_status
from matchloom.plans import reporting, runs
from matchloom.sources.resumes import parse_resumes, read_resumes
from matchloom.sources.tables import read_table
from matchloom.streaming import incremental

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@pytest.fixture
def jobs(spark):
    rows = [(1, "a", "First", None), (2, "a", "Second", ["x"]), (3, None, "Null", None),
            (4, None, "Null again", None), (5, "", "Empty", None), (6, "b", "B", None)]
    return spark.createDataFrame(rows, "seq int, job_id string, title string, skills array<string>")


def order():
    return [F.asc("seq")]


def test_first_wins_and_null_ids_are_one(spark, jobs, tmp_path):
    store = Store(spark, str(tmp_path))
    got = store.save_jobs(jobs, "0", order(), now())
    assert {(r["job_id"], r["title"]) for r in got.collect()} == {
        ("a", "First"), (None, "Null"), ("", "Empty"), ("b", "B")}
    row = got.where("job_id = 'a'").first()
    assert (row["skills"], row["description"]) == ([], "")
    assert row["scraped_at"] == dt.datetime(2024, 2, 1)


def test_second_insert_adds_nothing_and_a_retry_changes_nothing(spark, jobs, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save_jobs(jobs, "0", order(), now())
    assert store.save_jobs(jobs, "1", order(), now()).count() == 0
    assert store.save_jobs(jobs, "0", order(), now()).count() == 0
    assert store.save_jobs(jobs, "0", order(), now(), again=True).count() == 4
    assert store.jobs().count() == 4


def test_only_inserted_rows_come_back(spark, jobs, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save_jobs(jobs.where("job_id = 'a'"), "0", order(), now())
    got = store.save_jobs(jobs, "0", order(), now())
    assert {r["job_id"] for r in got.collect()} == {None, "", "b"}
    both = store.save_jobs(jobs, "0", order(), now(), again=True)
    assert {r["job_id"] for r in both.collect()} == {"a", None, "", "b"}


def test_a_look_up_reads_the_buckets_of_its_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=32)
    many = spark.range(5000).selectExpr("cast(id as int) seq", "concat('k', id) job_id", "'t' title")
    assert store.save_jobs(many, "0", order(), now()).count() == 5000
    ten = spark.range(4995, 5005).selectExpr("cast(id as int) seq", "concat('k', id) job_id", "'t' title")
    stored, buckets = store.among("jobs", ten)
    files = stored.inputFiles()
    assert len(buckets) <= 10 and {f.split("bucket=")[1].split("/")[0] for f in files} <= {str(b) for b in buckets}
    plan = stored.select("job_id")._jdf.queryExecution().executedPlan().toString()
    assert "In(job_id" in plan and "ReadSchema: struct<job_id:string>" in plan
    assert stored.count() == 5
    assert {r["job_id"] for r in store.save_jobs(ten, "1", order(), now()).collect()} == {f"k{i}" for i in range(5000, 5005)}
    assert Store(spark, str(tmp_path), buckets=7).buckets == 32  # what it was made with
    more = spark.range(4000, 7000).selectExpr("cast(id as int) seq", "concat('k', id) job_id", "'t' title")
    assert store.save_jobs(more, "2", order(), now()).count() == 1995


def test_compaction_keeps_every_row(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), buckets=4)
    rows = lambda a, b: spark.range(a, b).selectExpr(
        "cast(id as int) seq", "if(id = 3, null, concat('k', id)) job_id", "'t' title")
    for n in range(6):
        store.save_jobs(rows(n * 20, n * 20 + 25), str(n), order(), now())
    before = sorted(map(str, store.jobs().collect()))
    files = lambda: len(list(tmp_path.glob("jobs/bucket=*/write=*/part-*")))
    many = files()
    assert store.compact("jobs", files=100) == 0 and store.compact("jobs", files=3) == 4
    assert files() == 4 < many and sorted(map(str, store.jobs().collect())) == before
    assert store.save_jobs(rows(0, 126), "6", order(), now()).count() == 1
    # A failure in the middle of the exchange, and one before it.
    store.save_jobs(rows(200, 260), "7", order(), now())
    before = sorted(map(str, store.jobs().collect()))
    import matchloom.operators.store as module
    real, left = module.remove, [2]

    def broken(spark, path):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("lost")
        real(spark, path)

    monkeypatch.setattr(module, "remove", broken)
    with pytest.raises(OSError):
        store.compact("jobs", files=1)
    monkeypatch.setattr(module, "remove", real)
    (tmp_path / "jobs" / "_new-stale").mkdir()
    again = Store(spark, str(tmp_path))
    assert again.save_jobs(rows(0, 10), "8", order(), now()).count() == 0
    assert sorted(map(str, again.jobs().collect())) == before
    assert not list(tmp_path.glob("jobs/_*-*"))


def test_a_broken_batch_is_matched_when_it_is_repeated(spark, tmp_path, monkeypatch):
    config = MatchConfig(weights={"keyword": 1.0, "tfidf": 0.0, "semantic": 0.0, "skills": 0.0}, threshold=30.0, semantic=False)
    source, schema = str(tmp_path / "in"), "seq int, job_id string, title string"
    spark.createDataFrame([(1, "1", "alpha beta")], schema).coalesce(1).write.parquet(source)
    resumes = spark.createDataFrame([("a", "alpha beta")], "resume_file string, text string").withColumn(
        "skills", F.array().cast("array<string>"))
    store = Store(spark, str(tmp_path / "store"))

    def run():
        stream = incremental.read_files(spark, source, spark.createDataFrame([], schema).schema)
        incremental.match_stream(stream, store, resumes, config, now(), order(), str(tmp_path / "check")).awaitTermination()

    with monkeypatch.context() as patch:
        patch.setattr(runs, "match_new", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception):
            run()
    assert store.jobs().count() == 1 and store.matches().count() == 0
    run()
    assert [r["job_id"] for r in store.matches().collect()] == ["1"]


def test_matches_never_refresh_and_flags_follow(spark, jobs, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save_jobs(jobs, "0", order(), now())
    rows = [(1, "a", "r", 50.0), (2, "a", "r", 90.0), (3, None, "r", 10.0), (4, "zz", "r", 5.0)]
    found = spark.createDataFrame(rows, "seq int, job_id string, resume_file string, match_score double")
    store.save_matches(found, "0", order(), now())
    store.save_matches(found.withColumn("match_score", F.lit(1.0)), "1", order(), now())
    assert {(r["job_id"], r["match_score"]) for r in store.matches().collect()} == {
        ("a", 50.0), (None, 10.0), ("zz", 5.0)}
    assert {r["job_id"] for r in store.unmatched_jobs().collect()} == {"", "b"}
    pairs = spark.createDataFrame([("a", "r"), ("a", "other")], "job_id string, resume_file string")
    assert store.mark_applied(pairs, "0", now()).count() == 1
    assert {(r["job_id"], r["applied"]) for r in store.matches_with_status().collect()} == {
        ("a", 1), (None, 0), ("zz", 0)}


def test_modes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    jobs = spark.createDataFrame([(1, "1", "alpha beta"), (2, "2", "gamma delta")],
                                 "seq int, job_id string, title string")
    config = MatchConfig(weights={"keyword": 1.0, "tfidf": 0.0, "semantic": 0.0, "skills": 0.0},
                         threshold=30.0, semantic=False)
    empty = F.array().cast("array<string>")

    def resumes(*rows):
        return spark.createDataFrame(rows, "resume_file string, text string").withColumn("skills", empty)

    first = runs.full_run(store, jobs, resumes(("a", "alpha beta")), config, "0", now(), order())
    assert [(r["job_id"], r["resume_file"]) for r in first.collect()] == [("1", "a")]
    both = resumes(("a", "alpha beta"), ("b", "alpha gamma delta"))
    later = runs.match_new(store, both, config, "1", now())
    assert [(r["job_id"], r["resume_file"]) for r in later.collect()] == [("2", "b")]
    more = resumes(("a", "alpha beta"), ("c", "alpha beta gamma"))
    third = runs.match_new(store, more, config, "2", now(), mode="pair")
    assert {(r["job_id"], r["resume_file"]) for r in third.collect()} == {("1", "c")}


def test_reading_what_was_never_written(spark, tmp_path):
    assert read_table(spark, str(tmp_path / "none"), schemas.JOBS).count() == 0
    assert Store(spark, str(tmp_path / "new")).unmatched_jobs().count() == 0


def test_statistics_of_empty_tables(spark):
    empty_jobs = spark.createDataFrame([], schemas.JOBS)
    empty_matches = spark.createDataFrame([], schemas.MATCHES)
    row = reporting.statistics(empty_jobs, empty_matches).first()
    assert tuple(row) == (0, 0, 0.0, [])


def test_null_keys_in_reports(spark):
    jobs = spark.createDataFrame([("1", None), (None, "x")], "job_id string, company string").selectExpr(
        "*", "'t' title", "'l' location", "'u' url")
    matches = spark.createDataFrame(
        [("1", None, 1.0, "2024-01-02"), (None, "r", 2.0, "2024-01-01"), ("9", "r", 3.0, "2024-01-03")],
        "job_id string, resume_file string, match_score double, d string"
    ).withColumn("created_at", F.to_timestamp("d"))
    assert [tuple(r) for r in reporting.company_counts(jobs, matches).collect()] == [(None, 1)]
    recent = reporting.recent_matches(matches, jobs, F.lit("2024-01-01").cast("timestamp"))
    assert {r["job_id"] for r in recent.collect()} == {"1", None}
    later = reporting.recent_matches(matches, jobs, F.lit("2024-01-01 00:00:01").cast("timestamp"))
    assert {r["job_id"] for r in later.collect()} == {"1"}
    assert {r["resume_file"] for r in reporting.matches_per_resume(matches).collect()} == {"Unknown", "r"}


def test_ranks_of_a_large_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("key"),
        (F.col("id") * 7919 % 13).alias("score"), "id")
    keys = [F.desc("score"), F.asc("id")]
    got = {(r["key"], r["id"]): r["rank"] for r in rank_all(df, "key", keys).collect()}
    want = {(r["key"], r["id"]): r["rank"] for r in top_per_key(df, ["key"], keys, 10**6).collect()}
    assert got == want


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 k", "id v")
    plan = top_per_key(df, ["k"], [F.desc("v")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_resume_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Ann Lee\nAWS\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.pdf").write_text("no")
    rows = parse_resumes(read_resumes(spark, str(tmp_path))).collect()
    assert [(r["resume_file"], r["name"], r["text"]) for r in rows] == [("a.txt", "Ann Lee", "Ann Lee\nAWS\n")]


def test_report_text(spark):
    df = spark.sql("""SELECT 'r' resume_file, 1 rank, 'Dev' job_title, 'Acme' company, 70.5D match_score,
      'Pune' location, 'http://x' job_url, array('a', 'b') matched_skills,
      named_struct('keyword', 0.5D, 'tfidf', 0.25D, 'semantic', 0D, 'skills', 1D) score_breakdown""")
    assert reporting.report_lines(df).first()["entry"].split("\n") == [
        "1. Dev at Acme", "   Match Score: 70.5%", "   Location: Pune", "   URL: http://x",
        "   Matched Skills: a, b", "   Score Breakdown:", "     - Keyword: 50.0%",
        "     - Tfidf: 25.0%", "     - Semantic: 0.0%", "     - Skills: 100.0%"]


def test_digest_escapes_and_limits(spark, tmp_path):
    df = spark.range(12).selectExpr(
        "'r' resume_file", "cast(id as string) job_id", "'A & <b>' job_title", "'c' company",
        "'l' location", "cast(id as double) match_score", "'u' job_url",
        "transform(sequence(1, 12), x -> concat('s', x)) matched_skills",
        "named_struct('keyword', 0D, 'tfidf', 0D, 'semantic', 0D, 'skills', 1D) score_breakdown")
    row = reporting.digest(df).first()
    assert row["n_matches"] == 12 and row["html"].count("<h3>A &amp; &lt;b&gt;</h3>") == 10
    assert row["html"].count("<li>") == 100
    reporting.write_digest(df, str(tmp_path / "digest"))
    assert spark.read.json(str(tmp_path / "digest")).count() == 1
    assert reporting.digest_subject(df).first()["subject"] == "12 new job matches found"


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    schema = "seq int, job_id string, title string"
    rows = [(i, str(i % 7), f"t{i}") for i in range(30)]
    source = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame(rows[n * 10:n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(source)
    store = Store(spark, str(tmp_path / "store"))

    def run():
        stream = incremental.read_files(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
        incremental.ingest_stream(stream, store, now(), order(), str(tmp_path / "check")).awaitTermination()
        return {r["job_id"] for r in store.jobs().collect()}, store.jobs().count()

    assert run() == ({str(i) for i in range(7)}, 7)
    spark.createDataFrame([(99, "new", "t"), (100, "1", "t")], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == ({*map(str, range(7)), "new"}, 8)


def test_streams_and_manual_batches_keep_every_row(spark, tmp_path):
    schema = "seq int, job_id string, title string"
    store = Store(spark, str(tmp_path / "store"))
    store.save_jobs(spark.createDataFrame([(1, "old", "t")], schema), "0", order(), now())
    for n in range(2):
        source = str(tmp_path / f"in{n}")
        spark.createDataFrame([(1, f"s{n}", "t"), (2, "both", "t")], schema).coalesce(1).write.parquet(source)
        for check in (f"check{n}", f"fresh{n}", f"check{n}"):
            stream = incremental.read_files(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
            incremental.ingest_stream(stream, store, now(), order(), str(tmp_path / check)).awaitTermination()
    store.save_jobs(spark.createDataFrame([(9, "other", "t")], schema), "0", order(), now())
    assert sorted(r["job_id"] for r in store.jobs().collect()) == ["both", "old", "other", "s0", "s1"]


def test_late_rows_are_dropped_and_other_windows_stay(spark, tmp_path):
    source, path, schema = str(tmp_path / "in"), str(tmp_path / "counts"), "job_id string, resume_file string, match_score double, created_at timestamp"
    days = [["2024-03-01", "2024-03-02"], ["2024-03-20"], ["2024-01-03", "2024-03-21"], ["2024-03-22"]]
    for n, batch in enumerate(days):
        rows = spark.createDataFrame([(str(n), "r", 10.0 * n, dt.datetime.fromisoformat(d)) for d in batch], schema)
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = incremental.read_files(spark, source, rows.schema, files_per_batch=1)
        incremental.window_count_stream(stream, path, str(tmp_path / "check")).awaitTermination()
    got = {str(r["window_start"].date()): (r["n_matches"], r["avg_match_score"]) for r in spark.read.parquet(path).collect()}
    assert "2024-01-03" not in got and sum(n for n, _ in got.values()) == 5
    assert sorted(n for n, _ in got.values()) == [1, 2, 2]


def test_status_ties_are_fixed(spark):
    log = spark.sql("SELECT 'a' job_id, 'r' resume_file, s status, timestamp '2024-01-01' ts FROM VALUES ('x'), ('applied') t(s)")
    assert latest_status(log).first()["status"] == "x"
