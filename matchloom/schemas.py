"""Table and record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

SEARCHES = T.StructType([
    T.StructField("keywords", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("exp_min", T.IntegerType()),
    T.StructField("exp_max", T.IntegerType()),
])

JOBS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("experience", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("skills", STRINGS),
    T.StructField("description", T.StringType()),
    T.StructField("posted_date", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
])

BREAKDOWN = T.StructType([
    T.StructField("keyword", T.DoubleType()),
    T.StructField("tfidf", T.DoubleType()),
    T.StructField("semantic", T.DoubleType()),
    T.StructField("skills", T.DoubleType()),
])

MATCHES = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("resume_file", T.StringType()),
    T.StructField("match_score", T.DoubleType()),
    T.StructField("score_breakdown", BREAKDOWN),
    T.StructField("matched_skills", STRINGS),
    T.StructField("created_at", T.TimestampType()),
])

MATCH_STATUS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("resume_file", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])
