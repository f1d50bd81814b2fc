"""The two sides of the similarity join, prepared once per document.

A side has one row per resume or job:

===========  ==========================================================
key          join key; jobs prefix theirs so that a NULL job id has one too
entries      ``array<struct<kind, term, tf>>``: kind 0 are keywords (tf 1),
             kind 1 are one- and two-word TF-IDF terms with their counts
n_kw         number of keywords
n_terms      number of distinct TF-IDF terms
mass         sum of tf^2 over the TF-IDF terms
skills       all skills, lower-cased and distinct (coverage)
listed       skills as listed (shown as matched skills)
vec          sentence vector or NULL
kw, words    keywords, and the words that make the terms, in order; for
             readers that count terms themselves, others leave them out
low          lower-cased text, for readers that cut it themselves
===========  ==========================================================
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.config import MatchConfig
from matchloom.functions import skills as sk
from matchloom.functions.text import (
    join_text, keyword_set, lowered, or_empty, string_array, term_counts, tokens, unigrams_and_bigrams,
)
from matchloom.operators.vectors import VectorTable

KEYWORD, TERM = 0, 1
Encoder = Callable[[Column], Column] | VectorTable


def job_key(job_id: Column | str) -> Column:
    """Key without NULL that sorts as the job id does, NULL first."""
    column = F.col(job_id) if isinstance(job_id, str) else job_id
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))


def _with_words(docs: DataFrame, text: str, config: MatchConfig,
                kinds: Collection[int] = (KEYWORD, TERM)) -> DataFrame:
    """Replace the text by its keywords, words and counted terms."""
    return docs.withColumns({
        "kw": (keyword_set(F.col(text), config.stop_words) if KEYWORD in kinds
               else string_array([])),
        "words": tokens(F.col(text), config.tfidf_stop_words) if TERM in kinds else string_array([]),
    }).drop(text).withColumn("terms", term_counts(unigrams_and_bigrams(F.col("words"))))


def _with_entries(docs: DataFrame) -> DataFrame:
    """Keywords and terms in one list, with their sizes."""

    def entry(kind: int, term: Column, tf: Column) -> Column:
        return F.struct(F.lit(kind).cast("tinyint").alias("kind"), term.alias("term"),
                        tf.alias("tf"))

    return docs.withColumns({
        "entries": F.concat(
            F.transform("kw", lambda w: entry(KEYWORD, w, F.lit(1))),
            F.transform("terms", lambda t: entry(TERM, t["term"], t["tf"]))),
        "n_kw": F.size("kw"),
        "n_terms": F.size("terms"),
        "mass": F.aggregate("terms", F.lit(0).cast("long"),
                            lambda a, t: a + t["tf"].cast("long") * t["tf"]),
    }).drop("terms")


def counted(side: DataFrame) -> DataFrame:
    """A side as it is stored, without the words its terms were counted from."""
    return side.drop("kw", "words", "low")


def entity_skills(entities: DataFrame, labels=lexicon.ENTITY_LABELS) -> DataFrame:
    """``entities(doc_id, text, label)`` to one skill list per document."""
    name = F.lower(F.col("text"))
    return (
        entities.where(F.col("label").isin(list(labels)))
        .where((F.length(name) > 2) & ~name.rlike(r"^\p{Nd}+$"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_set(name)).alias("skills"))
    )


def _attach(docs: DataFrame, key: Callable[[str], Column], id_column: str,
            vectors: DataFrame | None, entities: DataFrame | None,
            encoder: Encoder | None) -> DataFrame:
    """Add ``key``, ``vec`` and ``found`` (entity skills) to documents with a ``match_text``."""
    docs = docs.withColumn("key", key(id_column))
    if vectors is not None or entities is not None:
        # The expensive columns come after these joins. A set number of partitions
        # keeps them parallel; adaptive execution would size the tasks by their
        # bytes, which are few.
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.repartition(partitions, "key")
    if vectors is not None:
        # One vector per document; of several the smallest.
        docs = docs.join(
            vectors.groupBy(key(id_column).alias("key")).agg(F.min("embedding").alias("vec")), "key", "left")
    elif isinstance(encoder, VectorTable):
        docs = encoder.attach(docs, "match_text")
    elif encoder is not None:
        docs = docs.withColumn("vec", encoder(F.col("match_text")))
    else:
        docs = docs.withColumn("vec", F.lit(None).cast("array<float>"))
    if entities is None:
        return docs.withColumn("found", F.array().cast("array<string>"))
    named = entity_skills(entities).select(
        key("doc_id").alias("key"), F.col("skills").alias("found"))
    return docs.join(named, "key", "left")


def resume_side(resumes: DataFrame, config: MatchConfig, vectors: DataFrame | None = None,
                entities: DataFrame | None = None, encoder: Encoder | None = None) -> DataFrame:
    """Side of parsed resumes ``(resume_file, text, skills)``."""
    docs = resumes.select(
        "resume_file", or_empty(F.col("skills")).alias("listed"),
        join_text(F.col("text"), F.concat_ws(" ", F.col("skills"))).alias("match_text"),
    )
    return _side(_attach(docs, F.col, "resume_file", vectors, entities, encoder), config)


def job_side(jobs: DataFrame, config: MatchConfig, vectors: DataFrame | None = None,
             entities: DataFrame | None = None, encoder: Encoder | None = None) -> DataFrame:
    """Side of jobs ``(job_id, title, description, skills)``; ``job_id`` is unique."""
    docs = jobs.select(
        "job_id", or_empty(F.col("skills")).alias("listed"),
        join_text(F.col("title"), F.col("description"), F.concat_ws(" ", F.col("skills")))
        .alias("match_text"),
    )
    return _side(_attach(docs, job_key, "job_id", vectors, entities, encoder), config)


def _side(docs: DataFrame, config: MatchConfig) -> DataFrame:
    docs = docs.withColumn("low", lowered(F.col("match_text")))  # once for all that reads it
    tags = sk.tags_in(F.col("low"), config.skill_tag_groups)
    docs = docs.select(
        "key", "listed", "vec", "match_text", "low",
        sk.lower_set(sk.all_skills(F.col("listed"), tags, F.col("found"))).alias("skills"))
    return _with_entries(_with_words(docs, "match_text", config))


def text_side(docs: DataFrame, key: str, text: str, config: MatchConfig,
              kinds: Collection[int] = (KEYWORD, TERM)) -> DataFrame:
    """Side of bare texts, for the text scores alone or one of them."""
    docs = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return _with_entries(_with_words(docs, "text", config, kinds))
