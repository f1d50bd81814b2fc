"""One callable ``(spark, sf_dir) -> DataFrame`` per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.config import MatchConfig
from matchloom.functions import profile, skills as sk
from matchloom.functions.text import keyword_set, normalize_text
from matchloom.functions.web import job_id_from_url
from matchloom.operators import text_pairs
from matchloom.operators.best import BestTable
from matchloom.operators.shared import materialize, new_folder
from matchloom.operators.keys import rank_all as ranked
from matchloom.operators.sides import KEYWORD, TERM, counted, entity_skills, job_key, text_side
from matchloom.operators.store import Store, latest_status, matched_jobs, unmatched_jobs, with_applied
from matchloom.plans import matching, reporting, runs
from matchloom.plans.running import RunningStatistics
from matchloom.sources.pages import job_cards, job_details, union_batches
from matchloom.sources.resumes import parse_resumes, read_resumes
from matchloom.sources.searches import with_search_url
from matchloom.sources.tables import job_records, match_records
from matchloom.streaming import incremental
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The invented texts hold few of the listed skills; these terms occur often.
EXTRA_TERMS = ("license", "mit", "apache", "token", "with", "the")
SECTION_STARTS, SECTION_STOPS = ("license",), ("the",)
LEAST = {"keyword": 0.1, "tfidf": 0.1, "semantic": 0.3, "skills": 0.5}
TAGS = (*sk.lexicon.SKILL_TAG_GROUPS, EXTRA_TERMS)

APPLIED = 60.0  # pairs of this score on are applied for
FLAGSHIP = MatchConfig(threshold=35.0, max_terms=1000)
TEXT_ONLY = MatchConfig(weights={"keyword": 0.5, "tfidf": 0.5, "semantic": 0.0, "skills": 0.0},
                        threshold=10.0, semantic=False, max_terms=1000)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def score(value: Column | str) -> Column:
    """Six places, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def listed(values: Column | str) -> Column:
    return F.array_join(F.sort_array(values), "|")


def clock(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def now() -> Column:
    return F.lit(views.NOW).cast("timestamp")


# Stored tables and reports -------------------------------------------------------------


@query
def top_companies(spark, sf):
    return reporting.top_companies(views.plain_jobs(spark, sf), views.matches(spark, sf))


@query
def company_counts(spark, sf):
    return reporting.company_counts(views.plain_jobs(spark, sf), views.matches(spark, sf))


@query
def match_statistics(spark, sf):
    totals = reporting.match_totals(views.plain_jobs(spark, sf), views.matches(spark, sf))
    return totals.withColumn("avg_match_score", score("avg_match_score"))


@query
def statistics_record(spark, sf):
    stats = reporting.statistics(views.plain_jobs(spark, sf), views.matches(spark, sf))
    names = F.transform("top_companies", lambda x: F.concat(
        x["name"], F.lit(":"), x["count"].cast("string")))
    return stats.select("total_jobs", "total_matches", score("avg_match_score").alias("avg_match_score"),
                        F.array_join(names, ",").alias("top_companies"))


@query
def recent_matches(spark, sf):
    found = reporting.recent_matches(views.matches(spark, sf), views.plain_jobs(spark, sf),
                                     F.lit(views.CUTOFF).cast("timestamp"))
    return found.select("seq", "job_id", "resume_file", "match_score",
                        clock("created_at").alias("created_at"), "job_title", "company",
                        "location", "job_url")


@query
def stored_job_records(spark, sf):
    return job_records(views.jobs(spark, sf)).select(
        "job_id", "title", "company", "location", "experience", "salary", "url",
        F.size("skills").cast("long").alias("n_skills"), "description", "posted_date",
        "scraped_at")


@query
def stored_match_records(spark, sf):
    stored = views.matches(spark, sf).withColumns({
        "score_breakdown": F.lit(None).cast(schemas.BREAKDOWN),
        "matched_skills": F.lit(None).cast("array<string>")})
    return match_records(stored).select(
        "job_id", "resume_file", "match_score", F.col("score_breakdown.keyword").alias("keyword"),
        F.size("matched_skills").cast("long").alias("n_skills"), "created_at",
        F.col("applied").cast("long").alias("applied"))


def order() -> list[Column]:
    return [F.desc("match_score"), F.asc("job_id"), F.asc("seq")]


@query
def top10_per_resume(spark, sf):
    return reporting.top_matches(views.matches(spark, sf), 10, order()).select(
        "resume_file", "job_id", "match_score", "seq", F.col("rank").cast("long").alias("rank"))


@query
def ranked_matches(spark, sf):
    return reporting.ranked_matches(views.matches(spark, sf), order()).select(
        "resume_file", "job_id", "match_score", "seq", F.col("rank").cast("long").alias("rank"))


@query
def resume_groups(spark, sf):
    groups = reporting.resume_groups(views.matches(spark, sf), 10, order())
    ids = F.array_join(F.transform("matches", lambda m: m["job_id"]), ",")
    return groups.select("resume_file", "n_matches", ids.alias("best_jobs"))


@query
def unmatched(spark, sf):
    return unmatched_jobs(views.plain_jobs(spark, sf), views.matches(spark, sf)).select("job_id", "title")


@query
def matched(spark, sf):
    return matched_jobs(views.plain_jobs(spark, sf), views.matches(spark, sf)).select("job_id", "title")


def status_log(spark, sf):
    """Every event as a change of state; clicks stand for an application."""
    return views.matches(spark, sf).select(
        "job_id", "resume_file", F.col("created_at").alias("ts"),
        F.when(F.col("match_score") >= 50, "applied").otherwise("withdrawn").alias("status"))


@query
def match_status_latest(spark, sf):
    return latest_status(status_log(spark, sf))


@query
def applied_matches(spark, sf):
    return with_applied(views.matches(spark, sf), status_log(spark, sf)).select(
        "seq", "job_id", "resume_file", F.col("applied").cast("long").alias("applied"))


# Ingest --------------------------------------------------------------------------------

def card_order() -> list[Column]:
    return [F.asc("page_id"), F.asc("card_no")]


@query
def new_jobs_insert(spark, sf):
    """The first card of each page is stored, then all cards come in."""
    store = Store(spark)
    cards = materialize(views.page_cards(spark, sf), "cards")
    store.save_jobs(cards.where(F.col("card_no") == 0), "0", card_order(), now())
    fresh = store.save_jobs(cards, "1", card_order(), now())
    return fresh.select("job_id", "title", "url", "company", "salary", "description",
                        clock("scraped_at").alias("scraped_at"))


@query
def new_matches_insert(spark, sf):
    """Matches of the first two days are stored, then all come in."""
    store = Store(spark)
    found = views.matches(spark, sf)
    early = found.where(F.col("created_at") < F.lit(views.EARLY).cast("timestamp"))
    store.save_matches(early, "0", [F.asc("seq")], now())
    return store.save_matches(found, "1", [F.asc("seq")], now()).select(
        "job_id", "resume_file", "match_score", clock("created_at").alias("created_at"))


@query
def search_results_union(spark, sf):
    """Cards of several searches one after the other, duplicates kept."""
    pages = views.texts(spark, sf, "pages")
    cards = views.cards_of(pages)
    articles = job_cards(pages, now(), views.ARTICLES, keep=("page_id",))
    both = union_batches([cards, articles])
    return both.select("batch_no", "page_id", F.col("card_no").cast("long").alias("card_no"),
                       "title", "job_id")


@query
def job_cards_nav(spark, sf):
    return views.page_cards(spark, sf).select(
        "page_id", F.col("card_no").cast("long").alias("card_no"), "title", "url", "company",
        "location", "experience", "salary", listed("skills").alias("skills"), "posted_date",
        "job_id")


@query
def job_cards_article(spark, sf):
    cards = job_cards(views.texts(spark, sf, "pages"), now(), views.ARTICLES, keep=("page_id",))
    return cards.select("page_id", "title", "url", "company", "salary", "job_id",
                        listed("skills").alias("skills"))


@query
def job_detail_pages(spark, sf):
    found = job_details(views.texts(spark, sf, "pages"), views.DETAILS, keep=("page_id",))
    return found.select("page_id", "title", "company", "experience", "salary", "location",
                        "description", F.array_join("skills", "|").alias("skills"))


@query
def job_detail_keys(spark, sf):
    found = job_details(views.texts(spark, sf, "pages"), views.DETAILS, keep=("page_id",))
    return found.select("page_id", F.explode("details").alias("name", "value"))


@query
def job_cards_classes(spark, sf):
    """The default selectors on listing markup: scopes, nesting, quote styles, references."""
    pages = views.table(spark, sf, "pages").select("page_id", views.listing().alias("html"))
    cards = job_cards(pages, now(), keep=("page_id",))
    return cards.select("page_id", F.col("card_no").cast("long").alias("card_no"), "title", "url", "company", "location",
                        "experience", "salary", listed("skills").alias("skills"), "posted_date", "job_id")


@query
def job_details_nested(spark, sf):
    """The default selectors on detail markup: nested blocks and several of them."""
    pages = views.table(spark, sf, "pages").select("page_id", views.detail().alias("html"))
    found = job_details(pages, keep=("page_id",))
    return found.select("page_id", "title", "company", "experience", "salary", "location", "description",
                        F.array_join("skills", "|").alias("skills"),
                        F.array_join(F.sort_array(F.transform(F.map_entries("details"), lambda e: F.concat_ws(
                            "=", e["key"], e["value"]))), "|").alias("details"))


@query
def page_job_ids(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", job_id_from_url(F.col("url")).alias("job_id"))


def title_searches(spark, sf):
    """A search per document: its first line in its source, with years from its length."""
    return views.table(spark, sf, "documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("keywords"),
        F.when(F.col("lang") == "en", "").otherwise(F.concat("source", F.lit("/~*+ "), "lang"))
        .alias("location"),
        F.when(F.col("n_chars") > 1000, (F.col("n_chars") % 7).cast("int")).alias("exp_min"),
        F.when(F.col("n_chars") > 1000, (F.col("n_chars") % 7 + 3).cast("int")).alias("exp_max"))


@query
def search_urls(spark, sf):
    return with_search_url(title_searches(spark, sf), "https://jobs.example.org").select(
        "doc_id", "search_url")


# Extraction ----------------------------------------------------------------------------


def extracted(name: str, value: Callable[[], Column]) -> None:
    def run(spark, sf):
        return views.document_texts(spark, sf).select("doc_id", value().alias("value"))

    QUERIES[name] = run


def body() -> Column:
    return F.col("text")


extracted("resume_email", lambda: profile.email(body()))
extracted("resume_phone", lambda: profile.phone(body()))
extracted("resume_name", lambda: profile.person_name(body()))
extracted("skill_tags", lambda: listed(sk.skill_tags(body(), TAGS)))
extracted("skill_lexicon", lambda: listed(sk.skill_substrings(body(), (*sk.lexicon.SKILL_SUBSTRINGS, *EXTRA_TERMS))))
extracted("skill_phrases", lambda: listed(sk.skill_phrases(body())))
extracted("resume_skills", lambda: listed(sk.resume_skills(body())))
extracted("normalized_text", lambda: normalize_text(body()))
extracted("keyword_sets", lambda: listed(keyword_set(body(), FLAGSHIP.stop_words)))


@query
def resume_links(spark, sf):
    """Links of profile texts; the texts hold none, so the source and language give some."""
    texts = views.texts(spark, sf, "documents")
    text = F.concat(body(), F.when(F.col("lang") == "en", F.concat(
        F.lit(" LinkedIn.com/in/User-"), F.col("source"), F.lit("-é.x"))).otherwise(F.concat(
            F.lit(" see GitHub.com/dev_"), F.col("source"), F.lit("/x"))))
    return texts.select("doc_id", profile.linkedin(text).alias("linkedin"),
                        profile.github(text).alias("github"))


@query
def resume_education(spark, sf):
    entries = views.document_texts(spark, sf).select("doc_id", F.inline(profile.education(body())))
    return entries.select("doc_id", "degree", "details")


@query
def resume_experience(spark, sf):
    section = profile.experience(body(), SECTION_STARTS, SECTION_STOPS)
    return views.document_texts(spark, sf).select("doc_id", F.posexplode(section).alias("n", "line")).select(
        "doc_id", F.col("n").cast("long").alias("n"), "line")


@query
def resume_records(spark, sf):
    found = parse_resumes(views.resume_texts(spark, sf), starts=SECTION_STARTS, stops=SECTION_STOPS)
    return found.select(
        "resume_file", "name", "email", "phone", listed("skills").alias("skills"), "linkedin",
        "github", F.size("education").cast("long").alias("n_education"),
        F.size("experience").cast("long").alias("n_experience"))


@query
def entity_skill_sets(spark, sf):
    return entity_skills(views.entities(spark, sf)).select("doc_id", listed("skills").alias("skills"))


# Similarity ----------------------------------------------------------------------------


def sides(spark, sf, kind, config=FLAGSHIP):
    items, documents = (
        text_side(views.texts(spark, sf, name), key, "text", config, [kind])
        for name, key in (("benchmark", "item_id"), ("documents", "doc_id")))
    return [materialize(counted(items), "benchmark"), documents]


def numbered(pairs: DataFrame, *columns: Column) -> DataFrame:
    return pairs.select(F.col("r").cast("long").alias("item_id"),
                        F.col("j").cast("long").alias("doc_id"), *columns)


@query
def keyword_jaccard(spark, sf):
    pairs = text_pairs.keyword_pairs(*sides(spark, sf, KEYWORD), FLAGSHIP, LEAST["keyword"])
    return numbered(pairs, "shared", score("score").alias("score"))


@query
def tfidf_pairs(spark, sf):
    config = MatchConfig(max_terms=None)
    pairs = text_pairs.tfidf_pairs(*sides(spark, sf, TERM, config), config, LEAST["tfidf"])
    return numbered(pairs, score("score").alias("score"))


@query
def tfidf_pairs_capped(spark, sf):
    pairs = text_pairs.tfidf_pairs(*sides(spark, sf, TERM), FLAGSHIP, LEAST["tfidf"])
    return numbered(pairs, score("score").alias("score"))


def named(pairs: DataFrame, *columns: Column) -> DataFrame:
    return pairs.select(F.col("r").alias("resume_file"), F.expr("substring(j, 2)").alias("job_id"), *columns)


@query
def semantic_pairs(spark, sf):
    none = F.array().cast("array<string>").alias("skills")
    of_resumes, of_jobs = views.vectors(spark, sf)
    pairs = text_pairs.vector_pairs(
        text_pairs.bare_side(of_resumes.select(F.col("resume_file").alias("key"), F.col("embedding").alias("vec"), none)),
        text_pairs.bare_side(of_jobs.select(job_key(F.col("job_id")).alias("key"), F.col("embedding").alias("vec"), none)),
        FLAGSHIP, LEAST["semantic"])
    return named(pairs, score("score").alias("score"))


@query
def skills_match(spark, sf):
    """Coverage of the skills that jobs ask for; it is whole where a job asks for none."""
    no_vector = F.lit(None).cast("array<float>").alias("vec")
    tags = sk.skill_tags(body(), TAGS).alias("skills")
    left = views.texts(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("key"), no_vector, tags)
    right = views.texts(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("key"), no_vector, tags)
    left, right = (materialize(text_pairs.bare_side(s), "skills") for s in (left, right))
    pairs = text_pairs.skill_pairs(left, right, FLAGSHIP, LEAST["skills"])
    return numbered(pairs, score("score").alias("score"))


def flagship_inputs(spark, sf):
    resumes = parse_resumes(views.resume_texts(spark, sf))
    of_resumes, of_jobs = views.vectors(spark, sf)
    return resumes, views.job_texts(spark, sf), {"resume_vectors": of_resumes, "job_vectors": of_jobs}


def parts(breakdown: str = "score_breakdown") -> list[Column]:
    return [score(F.col(f"{breakdown}.{p}")).alias(p) for p in ("keyword", "tfidf", "semantic", "skills")]


@query
def match_scores(spark, sf):
    resumes, jobs, options = flagship_inputs(spark, sf)
    found = matching.score_matches(resumes, jobs, FLAGSHIP, **options)
    return found.select("job_id", "resume_file", "match_score", *parts())


@query
def match_scores_some_vectors(spark, sf):
    """Jobs whose vector begins below zero count as not encoded yet; their semantic part is 0."""
    resumes, jobs, options = flagship_inputs(spark, sf)
    options["job_vectors"] = options["job_vectors"].where(F.col("embedding")[0] >= 0)
    found = matching.score_matches(resumes, jobs, FLAGSHIP, **options)
    return found.select("job_id", "resume_file", "match_score", *parts())


@query
def stored_applied(spark, sf):
    """Pairs marked as applied in a store; pairs that are no stored match are not logged."""
    store = Store(spark)
    found = materialize(views.matches(spark, sf), "matches")
    early = found.where(F.col("created_at") < F.lit(views.MIDDLE).cast("timestamp"))
    store.save_matches(early, "0", [F.asc("seq")], now())
    for batch in ("0", "1"):
        store.mark_applied(found.where(F.col("match_score") >= APPLIED), batch, now())
    return store.matches_with_status().select(
        "job_id", "resume_file", "match_score", F.col("applied").cast("long").alias("applied"))


@query
def matches_in_order(spark, sf):
    """Matches per resume, best first, with their place in that order."""
    ordered = matching.sorted_matches(views.matches(spark, sf).dropDuplicates(["job_id", "resume_file", "match_score"]))
    return ranked(ordered, "resume_file", [F.desc("match_score"), F.asc("job_id")]).select(
        "resume_file", "job_id", "match_score", F.col("rank").cast("long").alias("rank"))


@query
def match_full_records(spark, sf):
    resumes, jobs, options = flagship_inputs(spark, sf)
    found = matching.match(resumes, jobs, FLAGSHIP, **options)
    return found.select(
        "job_id", "resume_file", "job_title", "company", "location", "job_url", "match_score",
        listed("matched_skills").alias("matched_skills"),
        F.length("job_data.description").cast("long").alias("description_length"),
        F.col("resume_data.name").alias("name"),
        F.col("resume_data.skills_count").cast("long").alias("skills_count"))


@query
def best_matches(spark, sf):
    resumes, jobs, options = flagship_inputs(spark, sf)
    found = matching.best_matches(resumes, jobs, FLAGSHIP, 10, **options)
    return found.select("job_id", "resume_file", "match_score", F.col("rank").cast("long").alias("rank"))


@query
def match_scores_text_only(spark, sf):
    """Text scores alone: jobs without enough shared terms are never paired."""
    resumes = parse_resumes(views.resume_texts(spark, sf))
    found = matching.score_matches(resumes, views.job_texts(spark, sf), TEXT_ONLY)
    return found.select("job_id", "resume_file", "match_score", *parts())


@query
def match_run_second(spark, sf):
    """A second run over a store: jobs matched by the first are not shown again."""
    store = Store(spark)
    jobs = views.job_texts(spark, sf)
    store.save_jobs(jobs, "0", (F.asc("job_id"),), now())
    resumes = parse_resumes(views.resume_texts(spark, sf))
    runs.match_new(store, resumes, TEXT_ONLY, "0", now(), threshold=20.0)
    found = runs.match_new(store, resumes, TEXT_ONLY, "1", now())
    return found.select("job_id", "resume_file", "match_score", clock("created_at").alias("created_at"))


# Text output ---------------------------------------------------------------------------


@query
def digest_cards(spark, sf):
    best = reporting.top_matches(views.scored_matches(spark, sf), 10, order())
    return best.select("resume_file", F.col("rank").cast("long").alias("rank"), "job_title",
                       "company", "location", "match_score", "job_url")


@query
def digest(spark, sf):
    return reporting.digest(views.scored_matches(spark, sf))


def words_listed(text: Column | str) -> Column:
    """The words of a text, as a list of skills that is longer than any shown one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)))


@query
def digest_many_skills(spark, sf):
    """Cards of matches with the words of the job text as skills: ten at most are shown."""
    jobs = views.card_jobs(spark, sf, "description")
    best = views.with_scores(reporting.best_with_jobs(views.matches(spark, sf), jobs))
    cards = reporting.digest_cards(best.withColumn("matched_skills", words_listed("description")))
    return cards.select("resume_file", F.col("rank").cast("long").alias("rank"), "card")


@query
def matched_skill_lists(spark, sf):
    """Skills that a document and the one after it list, letter case as written."""
    left = views.table(spark, sf, "documents").select("doc_id", words_listed("text").alias("a"))
    right = views.table(spark, sf, "documents").select(
        (F.col("doc_id") - 1).alias("doc_id"), words_listed("text").alias("b"))
    both = sk.matched_skills(F.col("a"), F.col("b"))
    return left.join(right, "doc_id").select(
        "doc_id", F.array_join(both, "|").alias("skills"), F.size(both).cast("long").alias("n"))


@query
def resume_groups_unnamed(spark, sf):
    """Matches of one event type have no resume; they form the group of unknown ones."""
    found = views.matches(spark, sf).withColumn("resume_file", F.expr("nullif(resume_file, 'click')"))
    return reporting.resume_groups(found, 10, order()).select(
        "resume_file", "n_matches",
        F.array_join(F.transform("matches", lambda m: m["job_id"]), ",").alias("best_jobs"))


@query
def resume_folder(spark, sf):
    """The profile texts as files of their own, read back as a folder of resumes."""
    folder = new_folder(spark, "resume-files")
    texts = views.table(spark, sf, "benchmark").where(F.length("text") > 0)
    texts.select("item_id", "text").write.partitionBy("item_id").option("compression", "none").text(folder)
    found = read_resumes(spark, f"{folder}/*")
    return found.select(F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
                        F.length("text").cast("long").alias("n_chars"),
                        F.endswith("resume_file", F.lit(".txt")).alias("named"))


@query
def match_scores_entities(spark, sf):
    """Skills coverage with labelled phrases of the documents as further skills the jobs ask for."""
    resumes, jobs, options = flagship_inputs(spark, sf)
    found = matching.score_matches(
        resumes, jobs, FLAGSHIP, **options,
        job_entities=views.entities(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string")),
        resume_entities=views.entities_of(views.resume_texts(spark, sf).withColumnRenamed("resume_file", "doc_id")))
    return found.select("job_id", "resume_file", "match_score", *parts())


@query
def digest_header(spark, sf):
    header = reporting.digest_header(views.scored_matches(spark, sf), now())
    return header.select("n_matches", "n_resumes", clock("created_at").alias("created_at"))


@query
def match_report(spark, sf):
    ranked = reporting.ranked_matches(views.scored_matches(spark, sf), order())
    return reporting.report_lines(ranked)


@query
def statistics_report(spark, sf):
    stats = reporting.statistics(views.plain_jobs(spark, sf), views.matches(spark, sf))
    return reporting.statistics_text(stats, now())


# Streams -------------------------------------------------------------------------------


def stream_of(spark, sf, name):
    schema = views.table(spark, sf, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf))


@query
def stream_ingest(spark, sf):
    store = Store(spark)
    incremental.ingest_stream(
        stream_of(spark, sf, "pages"), store, now(), card_order(), new_folder(spark, "stream"),
        to_jobs=views.cards_of).awaitTermination()
    return store.jobs().select("job_id", "title", "url", "company", "salary", "description",
                               clock("scraped_at").alias("scraped_at"))


@query
def stream_match(spark, sf):
    store = Store(spark)
    resumes = parse_resumes(views.resume_texts(spark, sf))
    cores = spark.sparkContext.defaultParallelism
    incremental.match_stream(
        stream_of(spark, sf, "documents"), store, resumes, TEXT_ONLY, now(), (F.asc("job_id"),),
        new_folder(spark, "stream"),
        to_jobs=lambda d: views.as_jobs(d.repartition(cores * 2))).awaitTermination()
    return store.matches().select("job_id", "resume_file", "match_score")


@query
def stream_window_counts(spark, sf):
    path = new_folder(spark, "window-counts")
    incremental.window_count_stream(
        views.as_matches(stream_of(spark, sf, "events")), path,
        new_folder(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).select(
        clock("window_start").alias("window_start"), clock("window_end").alias("window_end"),
        "n_matches", score("avg_match_score").alias("avg_match_score"))


@query
def stream_best(spark, sf):
    """The best ten per resume, kept up by a stream of matches."""
    table = BestTable(spark, new_folder(spark, "best"), ["resume_file"], ["seq"], order, 10)
    incremental.best_stream(views.as_matches(stream_of(spark, sf, "events")), table,
                            new_folder(spark, "stream")).awaitTermination()
    return table.read().select("resume_file", "job_id", "match_score", "seq", F.col("rank").cast("long").alias("rank"))


# Kept up by batch ----------------------------------------------------------------------


def by_time(found: DataFrame) -> list[DataFrame]:
    """Matches as three batches by their time."""
    at = F.col("created_at")
    early, middle = (F.lit(t).cast("timestamp") for t in (views.EARLY, views.MIDDLE))
    return [found.where(at < early), found.where((at >= early) & (at < middle)), found.where((at >= middle) | at.isNull())]


@query
def best_by_batch(spark, sf):
    table = BestTable(spark, new_folder(spark, "best"), ["resume_file"], ["seq"], order, 10)
    for number, rows in enumerate(by_time(views.matches(spark, sf))):
        table.merge(rows, number)
    return table.read().select("resume_file", "job_id", "match_score", "seq", F.col("rank").cast("long").alias("rank"))


@query
def statistics_by_batch(spark, sf):
    """The statistics record from the sums of three batches; all jobs come with the first."""
    jobs = views.plain_jobs(spark, sf)
    sums = RunningStatistics(spark, new_folder(spark, "sums"))
    for number, rows in enumerate(by_time(views.matches(spark, sf))):
        sums.add(jobs if number == 0 else jobs.limit(0), rows, jobs, str(number))
    names = F.transform("top_companies", lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string")))
    return sums.statistics().select("total_jobs", "total_matches", score("avg_match_score").alias("avg_match_score"),
                                    F.array_join(names, ",").alias("top_companies"))


@query
def skill_lexicon_large(spark, sf):
    """The listed skills among 100,000 terms that an automaton finds; the other terms occur in no text."""
    terms = (*sk.lexicon.SKILL_SUBSTRINGS, *EXTRA_TERMS, *(f"zq{i}\u2603x" for i in range(100_000)))
    return views.document_texts(spark, sf).select("doc_id", listed(sk.skill_substrings(body(), terms)).alias("value"))
