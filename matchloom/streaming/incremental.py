"""Incremental forms of ingest and matching."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from matchloom.config import MatchConfig
from matchloom.operators.best import BestTable
from matchloom.operators.shared import temporary
from matchloom.operators.store import Store
from matchloom.plans import runs
from matchloom.plans.matching import prepare_resumes


def read_files(spark: SparkSession, path: str, schema: StructType, *, file_format: str = "parquet",
               files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _start(rows: DataFrame, handle: Callable[[DataFrame, int], None],
           checkpoint: str) -> StreamingQuery:
    return (rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _writer(spark: SparkSession, checkpoint: str) -> str:
    """A name for this stream's batches that lives and dies with its checkpoint.

    Batch numbers start again under a new checkpoint, so they alone name nothing.
    """
    path = f"{checkpoint.rstrip('/')}/writer"
    spark.createDataFrame([(uuid.uuid4().hex,)], "name string").coalesce(1).write.mode("ignore").json(path)
    return spark.read.schema("name string").json(path).first()["name"]


def ingest_stream(rows: DataFrame, store: Store, now: Column, order: Sequence[Column],
                  checkpoint: str, to_jobs: Callable[[DataFrame], DataFrame] | None = None,
                  ) -> StreamingQuery:
    """Insert unseen jobs from a stream, batch by batch.

    Seen ids live in the store, not in operator state that grows without bound. A
    batch that is repeated after a failure adds nothing.
    """
    writer = _writer(store.spark, checkpoint)

    def handle(batch: DataFrame, number: int) -> None:
        jobs = to_jobs(batch) if to_jobs else batch
        store.save_jobs(jobs, f"{writer}-{number}", order, now)

    return _start(rows, handle, checkpoint)


def match_stream(rows: DataFrame, store: Store, resumes: DataFrame, config: MatchConfig,
                 now: Column, order: Sequence[Column], checkpoint: str,
                 to_jobs: Callable[[DataFrame], DataFrame] | None = None, **options,
                 ) -> StreamingQuery:
    """Ingest each batch and match what was new with a static table of resumes.

    The resumes are prepared once, not once per batch.
    """
    mine = {k: options.pop(k) for k in ("resume_vectors", "resume_entities") if k in options}
    prepared = prepare_resumes(resumes, config, encoder=options.get("encoder"), **mine)

    writer = _writer(store.spark, checkpoint)

    def handle(batch: DataFrame, number: int) -> None:
        jobs = to_jobs(batch) if to_jobs else batch
        with temporary(store.spark):
            runs.full_run(store, jobs, resumes, config, f"{writer}-{number}", now, order, again=True,
                          prepared_resumes=prepared, **options)

    return _start(rows, handle, checkpoint)


def best_stream(rows: DataFrame, table: BestTable, checkpoint: str,
                shaped: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keep the best rows per key of a stream, a version per batch.

    The state is the table, of ``n`` rows a key; a batch that is repeated after a failure replaces its own version.
    Batches are numbered by the checkpoint, so a table and a checkpoint belong together.
    """

    def handle(batch: DataFrame, number: int) -> None:
        with temporary(table.spark):
            table.merge(shaped(batch) if shaped else batch, number)

    return _start(rows, handle, checkpoint)


def window_counts(matches: DataFrame, length: str = "7 days", late: str = "1 day") -> DataFrame:
    """Matches and mean score per tumbling window of ``created_at``.

    On a stream, rows later than ``late`` behind the newest are dropped; on a table
    the watermark has no effect.
    """
    return (
        matches.withWatermark("created_at", late)
        .groupBy(F.window("created_at", length).alias("w"))
        .agg(F.count("*").alias("n_matches"), F.avg("match_score").alias("avg_match_score"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "n_matches", "avg_match_score")
    )


def window_count_stream(matches: DataFrame, path: str, checkpoint: str, length: str = "7 days",
                        late: str = "1 day") -> StreamingQuery:
    """Keep a table of the window counts, one partition per window.

    A batch brings the windows that it changed and replaces those partitions only, so readers
    see each window before or after a batch, and a repeated batch writes the same. Rows later than
    ``late`` behind the newest of the batches before are dropped, and their windows' state is freed.
    """

    def handle(counts: DataFrame, number: int) -> None:
        (counts.withColumn("window_key", F.date_format("window_start", "yyyyMMddHHmmss"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("window_key").parquet(path))

    return (window_counts(matches, length, late).writeStream.outputMode("update")
            .foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
