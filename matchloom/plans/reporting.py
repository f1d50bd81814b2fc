"""Statistics, recent matches, digests and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.config import SCORE_PARTS
from matchloom.functions.formats import clock_text, joined, labelled_percent
from matchloom.functions.text import or_empty
from matchloom.operators.keys import rank_all, spread_lookup, top_per_key
from matchloom.operators.shared import materialize
from matchloom.plans.matching import by_score


def recent_matches(matches: DataFrame, jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Matches created at or after ``cutoff`` with their job; matches without a job drop."""
    job = jobs.select("job_id", F.col("title").alias("job_title"), "company", "location",
                      F.col("url").alias("job_url"))
    return spread_lookup(matches.where(F.col("created_at") >= cutoff), job, ["job_id"])


def company_counts(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches per company. NULL job ids do not join; a NULL company is a group.

    Matches are counted per job before the join, so a job with very many matches
    is one row there.
    """
    per_job = matches.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(
        F.count("*").alias("n"))
    return (
        jobs.select("job_id", "company").join(per_job, "job_id")
        .groupBy("company").agg(F.sum("n").alias("match_count"))
    )


def first_companies(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest of ``counts(company, match_count)``; ties by name, NULL first."""
    return counts.orderBy(F.desc("match_count"), F.asc_nulls_first("company")).limit(n)


def top_companies(jobs: DataFrame, matches: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` companies with the most matches; ties by name, NULL first."""
    return first_companies(company_counts(jobs, matches), n)


def match_totals(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Row counts and mean score (0 without matches), one row.

    Both tables feed one aggregate, so nothing has to be joined.
    """
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    rows = jobs.select(one.alias("is_job"), zero.alias("is_match"),
                       F.lit(None).cast("double").alias("score")).unionByName(
        matches.select(zero.alias("is_job"), one.alias("is_match"),
                       F.col("match_score").cast("double").alias("score")))
    return rows.agg(
        F.coalesce(F.sum("is_job"), zero).alias("total_jobs"),
        F.coalesce(F.sum("is_match"), zero).alias("total_matches"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_match_score"),
    )


def with_companies(totals: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """One row of totals with the top companies ``array<struct<name, count>>``."""
    companies = first_companies(counts, n).agg(
        F.sort_array(F.collect_list(F.struct(
            (-F.col("match_count")).alias("order"), F.col("company").alias("name")))).alias("c")
    ).select(F.lit(1).alias("_one"), F.transform(
        "c", lambda x: F.struct(x["name"].alias("name"), (-x["order"]).alias("count")))
        .alias("top_companies"))
    return totals.withColumn("_one", F.lit(1)).join(companies, "_one").drop("_one")


def statistics(jobs: DataFrame, matches: DataFrame, n: int = 5) -> DataFrame:
    """Totals and the top companies ``array<struct<name, count>>`` in one row."""
    return with_companies(match_totals(jobs, matches), company_counts(jobs, matches), n)


def statistics_text(stats: DataFrame, now: Column, title: str = "MATCH REPORT") -> DataFrame:
    """The statistics row as printable text."""
    rule = F.lit("=" * 50)
    lines = F.transform("top_companies", lambda x: F.concat(
        F.lit("  - "), F.coalesce(x["name"], F.lit("None")), F.lit(": "),
        x["count"].cast("string"), F.lit(" matches")))
    head = F.array(
        rule, F.lit(title), rule,
        F.concat(F.lit("Generated at: "), clock_text(now)),
        F.concat(F.lit("Total jobs: "), F.col("total_jobs").cast("string")),
        F.concat(F.lit("Total matches: "), F.col("total_matches").cast("string")),
        F.concat(F.lit("Average match score: "), F.format_string("%.1f%%", "avg_match_score")),
        F.lit("Top companies:"),
    )
    return stats.select(F.array_join(F.concat(head, lines, F.array(rule)), "\n").alias("report"))


def _resume_key() -> Column:
    return F.coalesce(F.col("resume_file"), F.lit(lexicon.UNKNOWN))


def matches_per_resume(matches: DataFrame) -> DataFrame:
    return matches.groupBy(_resume_key().alias("resume_file")).agg(F.count("*").alias("n_matches"))


def top_matches(matches: DataFrame, n: int = 10, order=None) -> DataFrame:
    """The ``n`` best matches of each resume with their rank."""
    return top_per_key(matches.withColumn("resume_file", _resume_key()), ["resume_file"],
                       order or by_score(), n)


def best_with_jobs(matches: DataFrame, jobs: DataFrame, n: int = 10, order=None) -> DataFrame:
    """The ``n`` best matches of each resume among those with a job, with the columns of the job.

    Matches are ranked before they meet the jobs, so long texts of a job are not copied per match. They are the
    first ``n`` of all matches with their jobs; where several jobs share an id a resume may have more rows. The best
    are stored, so their size is known when they are joined; ``order`` may name columns of the matches only.
    """
    ids = jobs.select("job_id").distinct()
    best = materialize(top_matches(matches.join(ids, "job_id", "left_semi"), n, order).drop("rank"), "best")
    return best.join(jobs, "job_id")


def resume_groups(matches: DataFrame, n: int = 10, order=None) -> DataFrame:
    """Per resume the number of matches and the ``n`` best in order, as an array.

    The count covers the whole group; the array is bounded, so no group is ever
    gathered into one row.
    """
    best = top_matches(matches, n, order)
    fields = [c for c in best.columns if c not in ("resume_file", "rank")]
    arrays = best.groupBy("resume_file").agg(
        F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("matches"))
    return matches_per_resume(matches).join(arrays, "resume_file")


def ranked_matches(matches: DataFrame, order=None) -> DataFrame:
    """Every match with its rank within the resume, groups of any size."""
    return rank_all(matches.withColumn("resume_file", _resume_key()), "resume_file",
                    order or by_score())


def _or_missing(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def report_lines(ranked: DataFrame) -> DataFrame:
    """One text block per ranked match: title, score, location, URL, skills, breakdown."""
    skills = F.when(F.size(or_empty(F.col("matched_skills"))) > 0,
                    F.concat(F.lit("   Matched Skills: "), joined(F.col("matched_skills"))))
    parts = [F.concat(F.lit("     - "), labelled_percent(p, F.col(f"score_breakdown.{p}")))
             for p in SCORE_PARTS]
    block = F.concat_ws(
        "\n",
        F.concat(F.col("rank").cast("string"), F.lit(". "), _or_missing("job_title"), F.lit(" at "),
                 _or_missing("company")),
        F.concat(F.lit("   Match Score: "), F.col("match_score").cast("string"), F.lit("%")),
        F.concat(F.lit("   Location: "), _or_missing("location")),
        F.concat(F.lit("   URL: "), _or_missing("job_url")),
        skills,
        F.lit("   Score Breakdown:"),
        *parts,
    )
    return ranked.select("resume_file", "rank", block.alias("entry"))


def _escaped(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def _shown(name: str, missing: str = "N/A") -> Column:
    return _escaped(F.coalesce(F.col(name).cast("string"), F.lit(missing)))


def digest_cards(matches: DataFrame, n: int = 10, n_skills: int = 10) -> DataFrame:
    """The ``n`` best matches of each resume, each as an HTML card."""
    best = top_matches(matches, n)
    scores = [labelled_percent(p, F.col(f"score_breakdown.{p}")) for p in SCORE_PARTS]
    skills = F.slice(F.sort_array(or_empty(F.col("matched_skills"))), 1, n_skills)
    tags = F.array_join(
        F.transform(skills, lambda s: F.concat(F.lit("<li>"), _escaped(s), F.lit("</li>"))), "")
    card = F.concat(
        F.lit("<section class='match'><h3>"), _shown("job_title"), F.lit("</h3><p>"),
        _shown("company"), F.lit(", "), _shown("location"), F.lit("</p><p>Match score: "),
        F.coalesce(F.col("match_score"), F.lit(0.0)).cast("string"), F.lit("%</p><p>"),
        F.concat_ws("<br>", *scores), F.lit("</p>"),
        F.when(F.size(skills) > 0, F.concat(F.lit("<ul>"), tags, F.lit("</ul>"))).otherwise(""),
        F.lit("<a href=\""), _shown("job_url", "#"), F.lit("\">View job</a></section>"),
    )
    return best.select("resume_file", "rank", card.alias("card"))


def digest(matches: DataFrame, n: int = 10) -> DataFrame:
    """One HTML section per resume: its number of matches and its best cards."""
    cards = digest_cards(matches, n).groupBy("resume_file").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "card"))), lambda x: x["card"]), "")
        .alias("cards"))
    return matches_per_resume(matches).join(cards, "resume_file").select(
        "resume_file", "n_matches",
        F.concat(F.lit("<section><h2>Resume: "), _escaped(F.col("resume_file")),
                 F.lit("</h2><p>Found "), F.col("n_matches").cast("string"),
                 F.lit(" matching positions</p>"), F.col("cards"), F.lit("</section>"))
        .alias("html"))


def digest_header(matches: DataFrame, now: Column) -> DataFrame:
    """One row for the run: its matches, the resumes that have any, and its time."""
    return matches.agg(
        F.count("*").alias("n_matches"), F.count_distinct("resume_file").alias("n_resumes"), F.first(now).alias("created_at"))


def digest_subject(matches: DataFrame) -> DataFrame:
    return matches.agg(F.concat(
        F.count("*").cast("string"), F.lit(" new job matches found")).alias("subject"))


def write_digest(matches: DataFrame, path: str, n: int = 10) -> None:
    """Digest sections as JSON lines, one per resume."""
    digest(matches, n).write.mode("overwrite").json(path)
