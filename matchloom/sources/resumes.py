"""Profile texts and the records parsed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.functions import profile
from matchloom.functions.skills import resume_skills


def read_resumes(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """One row per text file of a folder (one level): its base name and whole text."""
    return (
        spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern)
        .load(folder)
        .select(F.col("_metadata.file_name").alias("resume_file"), F.col("value").alias("text"))
    )


def parse_resumes(
    texts: DataFrame,
    *,
    skill_terms: Sequence[str] = lexicon.SKILL_SUBSTRINGS,
    starts: Sequence[str] = lexicon.EXPERIENCE_STARTS,
    stops: Sequence[str] = lexicon.EXPERIENCE_STOPS,
) -> DataFrame:
    """``(resume_file, text)`` to records; rows without text are dropped.

    Narrow: every field is a column expression over the row's own text, and a
    consumer that reads two fields computes two fields.
    """
    text = F.col("text")
    return texts.where(F.length(text) > 0).select(
        "resume_file", "text",
        profile.person_name(text).alias("name"),
        profile.email(text).alias("email"),
        profile.phone(text).alias("phone"),
        resume_skills(text, skill_terms).alias("skills"),
        profile.education(text).alias("education"),
        profile.experience(text, starts, stops).alias("experience"),
        profile.linkedin(text).alias("linkedin"),
        profile.github(text).alias("github"),
        *[c for c in texts.columns if c not in ("resume_file", "text")],
    )
