"""Statistics that are kept up by batch: a batch adds its own sums, and nothing is read again.

Sums are exact decimals, so that the order and the split of batches do not show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.keys import null_safe_lookup
from matchloom.operators.shared import matching
from matchloom.plans.reporting import with_companies

SCHEMA = "company string, jobs long, matches long, joined long, score decimal(38,6), scored long"


class RunningStatistics:
    """Partial sums per company, one folder per batch; a repeated batch replaces its own.

    The jobs of a batch's matches must be stored with it or before it, as match runs do: ``jobs`` of
    :meth:`add` are the batch's new jobs, ``known`` any table that has the jobs of its matches (a bucket
    look-up of a store). Matches without a job count in the totals and in no company.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, jobs: DataFrame, matches: DataFrame, known: DataFrame, batch: str) -> None:
        """Add the sums of a batch's new jobs and new matches."""
        zero = F.lit(0).cast("long")
        of_jobs = jobs.groupBy("company").agg(F.count("*").alias("jobs"))
        # Per job first: a job with very many matches is one row in the join.
        per_job = matches.groupBy("job_id").agg(
            F.count("*").alias("matches"), F.sum(F.col("match_score").cast("decimal(20,6)")).alias("score"),
            F.count("match_score").alias("scored"))
        named = known.select("job_id", "company").where(F.col("job_id").isNotNull()).withColumn("found", F.lit(1))
        of_matches = null_safe_lookup(per_job, named, ["job_id"], "left").groupBy("company").agg(
            F.sum("matches").alias("matches"), F.sum(F.col("matches") * F.col("found")).alias("joined"),
            F.sum("score").alias("score"), F.sum("scored").alias("scored"))
        none = F.lit(0).cast("decimal(38,6)")
        rows = of_jobs.select("company", "jobs", zero.alias("matches"), zero.alias("joined"), none.alias("score"),
                              zero.alias("scored")).unionByName(of_matches.select(
                                  "company", zero.alias("jobs"), "matches", F.coalesce("joined", zero).alias("joined"),
                                  F.coalesce(F.col("score").cast("decimal(38,6)"), none).alias("score"), "scored"))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _sums(self) -> DataFrame:
        if not matching(self.spark, f"{self.path}/batch=*/_SUCCESS"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(f"{self.path}/batch=*")

    def statistics(self, n: int = 5) -> DataFrame:
        """What ``reporting.statistics`` gives for all batches: totals and the ``n`` companies with most matches."""
        sums = self._sums()
        zero = F.lit(0).cast("long")
        totals = sums.agg(
            F.coalesce(F.sum("jobs"), zero).alias("total_jobs"), F.coalesce(F.sum("matches"), zero).alias("total_matches"),
            F.coalesce(F.try_divide(F.sum("score").cast("double"), F.sum("scored")), F.lit(0.0)).alias("avg_match_score"))
        counts = sums.groupBy("company").agg(F.sum("joined").alias("match_count")).where("match_count > 0")
        return with_companies(totals, counts, n)
