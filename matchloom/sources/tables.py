"""Stored tables: readers that know their schema, and record projections."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchloom import schemas
from matchloom.functions.formats import iso_text
from matchloom.functions.text import or_empty


def read_table(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """A parquet table, or an empty one when nothing was written yet."""
    try:
        return spark.read.options(**options).schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_text_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A parquet table whose rows cost much CPU each.

    A scan has no more tasks than row groups. Whoever knows that a table has too few of them names the number of
    partitions to deal its rows out to, which shuffles them; without it the scan is left alone.
    """
    rows = spark.read.parquet(path)
    return rows if partitions is None else rows.repartition(partitions)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of an outside database, read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", partitions))
    return reader.options(**(properties or {})).load()


def job_records(jobs: DataFrame) -> DataFrame:
    """Stored jobs as outward records: ISO time text, a skill list that is never NULL."""
    return jobs.select(
        "job_id", "title", "company", "location", "experience", "salary", "url",
        or_empty(F.col("skills")).alias("skills"),
        "description", "posted_date",
        iso_text(F.col("scraped_at")).alias("scraped_at"),
    )


def match_records(matches: DataFrame) -> DataFrame:
    """Stored matches as outward records. ``applied`` is 0 unless the input has it."""
    applied = F.col("applied") if "applied" in matches.columns else F.lit(0)
    empty = F.from_json(F.lit("{}"), schemas.BREAKDOWN)
    return matches.select(
        "job_id", "resume_file", "match_score",
        F.coalesce(F.col("score_breakdown"), empty).alias("score_breakdown"),
        or_empty(F.col("matched_skills")).alias("matched_skills"),
        iso_text(F.col("created_at")).alias("created_at"),
        F.coalesce(applied, F.lit(0)).alias("applied"),
    )
