"""The supplied tables in the shapes the library works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.web import CardSelectors, DetailSelectors
from matchloom.sources.pages import job_cards
from matchloom.sources.tables import read_text_table

CUTOFF = "2024-01-24 00:00:00"
EARLY = "2024-01-03 00:00:00"
MIDDLE = "2024-01-15 00:00:00"
NOW = "2024-02-01 00:00:00"

# The pages have no class names: navigation items serve as cards, and their
# links as spans, skills and open keys.
CARDS = CardSelectors(card="li", title="a", link="a", skill="b")
ARTICLES = CardSelectors(card="article", title="h1", link="a", skill="h1")
DETAILS = DetailSelectors(title="h1", description="article", header_span="a", skill="a", detail_span="a")


# Markup with the classes of the default selectors around values of a page. Card 0 is whole, card 1 has
# no more than a title, cards 3 and 4 lack end tags; the advert is outside the list.
def listing() -> Column:
    return F.concat(
        F.lit("<article><a class='title' href='/advert'>Advert</a></article><div class='list wide'>"
              "<article class=\"tuple\"><div><a class='title cut' href='https://j.example.org/dev-x-"), "page_id",
        F.lit("?src=a&amp;k=1'>Dev &amp; <b>Ops</b> "), "page_id",
        F.lit("</a></div><div class=\"row\"><div class=comp-name>A&#8377;B <div>Ltd</div></div></div>"
              "<div class=\"loc-wrap\"><i class='icon'></i><span title='>'>Pune"), (F.col("page_id") % 7).cast("string"),
        F.lit("<span> East</span></span></div><span class='exp-wrap'><span>1-2 Yrs</span></span>"
              "<!-- <span class='sal-wrap'><span>no</span></span> --><ul class='tags-gt'><li>Go<ul><li>SQL</li></ul></li>"
              "</ul><span class='job-post-day'>&#x32; days</span></article>"
              "<article><span class=\"title\">Bare</span></article><article><p>none</p></article>"
              "<article><a class=title href=late-t title=it's>Don't"), "page_id",
        F.lit("</a><ul class=tags-gt><li>java<li>sql<li>go</ul><p class=comp-name>One<p>Two"
              "<article><b class='title'>Last</b><p>5 > 4 & it's</div>"), "html")


def detail() -> Column:
    return F.concat(
        F.lit("<h1>Site</h1><section class='jd-header'><div><h1>Dev <i>"), "page_id",
        F.lit("</i></h1></div><div class=\"comp-name\">Acme</div><div class='exp-sal-loc'><div><span>1-2 Yrs</span></div>"
              "<div><span>&#8377; 5</span></div><div><span>Pune</span></div></div></section><div class='job-desc'>"
              "<div>First.. </div><div>Second with python "), "page_id",
        F.lit("</div></div><div class='key-skill'><div><a>Go</a></div><div><a>SQL</a></div><ul><li><a title=it's>C</a><li><a>D<a>E</ul></div>"
              "<table class='detail'><tr><td><span>Team</span><td><span>Core</table><div class='detail'><span>Role:</span><span>Lead</span></div>"
              "<div class=\"detail\"><span>Open To</span><span>n"), "page_id", F.lit("</span><span>odd</span></div>"), "html")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The supplied tables are files of one row group each.
    return read_text_table(spark, f"{sf_dir}/{name}.parquet", 2 * spark.sparkContext.defaultParallelism)


def as_jobs(documents: DataFrame) -> DataFrame:
    """Documents as jobs, without the time they were seen."""
    doc_id = F.col("doc_id").cast("string")
    missing = F.lit(None).cast("string")
    return documents.select(
        doc_id.alias("job_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        missing.alias("experience"), missing.alias("salary"),
        F.concat(F.lit("https://example.org/job-listings-x-"), doc_id, F.lit("?src=a")).alias("url"),
        F.lit(None).cast("array<string>").alias("skills"),
        F.col("text").alias("description"),
        missing.alias("posted_date"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored jobs; the event of the same number gives the time."""
    seen = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("scraped_at"))
    return as_jobs(table(spark, sf_dir, "documents")).join(seen, "job_id", "left")


def plain_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without the time, for queries that do not read it."""
    return as_jobs(table(spark, sf_dir, "documents"))


def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_jobs(texts(spark, sf_dir, "documents"))


def resume_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("r"), F.col("item_id").cast("string"), F.lit(".txt")).alias("resume_file"),
        "text")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as profile texts, for extraction."""
    return texts(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("resume_file"), "text", "doc_id")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_matches(table(spark, sf_dir, "events"))


def as_matches(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_type").alias("resume_file"),
        F.col("value").alias("match_score"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def card_jobs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """What the text reports show of a job."""
    return plain_jobs(spark, sf_dir).select("job_id", F.col("title").alias("job_title"), "company",
                                            "location", F.col("url").alias("job_url"), *more)


def with_scores(found: DataFrame) -> DataFrame:
    """Matches with their job, and a breakdown and skills made of both."""
    share = F.col("match_score") / 100
    return found.withColumns({
        "score_breakdown": F.struct(
            share.alias("keyword"), (share / 2).alias("tfidf"), (share / 4).alias("semantic"),
            F.lit(1.0).alias("skills")),
        "matched_skills": F.array("location", "company"),
    })


def scored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their job, a breakdown and skills, for the text reports."""
    return with_scores(matches(spark, sf_dir).join(card_jobs(spark, sf_dir), "job_id"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of the resumes and of the jobs.

    Resumes take the first vectors, by number; jobs share the remaining ones in turn.
    """
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    documents = table(spark, sf_dir, "documents").select("doc_id")
    n_items, n_vectors = items.count(), embeddings.count()
    of_resumes = items.join(embeddings, F.col("item_id") == F.col("vec_id")).select(
        F.concat(F.lit("r"), F.col("item_id").cast("string"), F.lit(".txt")).alias("resume_file"),
        "embedding")
    of_jobs = documents.join(
        embeddings, n_items + F.col("doc_id") % (n_vectors - n_items) == F.col("vec_id")
    ).select(F.col("doc_id").cast("string").alias("job_id"), "embedding")
    return of_resumes, of_jobs


def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards_of(texts(spark, sf_dir, "pages"))


def cards_of(pages: DataFrame) -> DataFrame:
    return job_cards(pages, F.lit(NOW).cast("timestamp"), CARDS, keep=("page_id",))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised phrases of the documents, labelled by their length."""
    return entities_of(document_texts(spark, sf_dir))


def entities_of(texts: DataFrame) -> DataFrame:
    found = texts.select(
        "doc_id", F.explode(F.regexp_extract_all(
            "text", F.lit(r"[A-Z][a-z]+|[0-9]{3,}"), F.lit(0))).alias("text"))
    n = F.length("text") % 4
    return found.withColumn("label", F.when(n == 0, "ORG").when(n == 1, "PRODUCT")
                            .when(n == 2, "WORK_OF_ART").otherwise("PERSON"))
