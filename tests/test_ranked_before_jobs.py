"""Reports rank matches before the wide rows of the jobs come."""

from matchloom.plans import reporting


def test_best_with_jobs_ranks_before_the_jobs_come(spark):
    """Matches without a job take no place, a null resume is the unknown one, jobs of one id each give a row."""
    rows = [(f"j{k}", f, float(k)) for k in range(40) for f in ("a", "b", None)] + [(None, "a", 99.0), ("gone", "a", 98.0)]
    found = spark.createDataFrame(rows, "job_id string, resume_file string, match_score double")
    jobs = spark.createDataFrame([(f"j{k % 30}", f"t{k}", "long text") for k in range(35)] + [(None, "t", "x")],
                                 "job_id string, title string, description string")
    best = reporting.best_with_jobs(found, jobs, 3)
    want = {(f, f"j{k}", f"t{k}") for f in ("a", "b", "Unknown") for k in (29, 28, 27)}
    assert {(x["resume_file"], x["job_id"], x["title"]) for x in best.collect()} == want and best.count() == 9
    twice = reporting.best_with_jobs(found.where("match_score < 5"), jobs, 2)
    assert sorted(x["title"] for x in twice.where("resume_file = 'a'").collect()) == ["t3", "t33", "t34", "t4"]
    assert len(best.inputFiles()) > 0  # ranked rows are a table before the join
