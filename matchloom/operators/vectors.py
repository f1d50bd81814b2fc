"""Vectors stored by text, so that equal texts and later runs are encoded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.shared import materialize, temporary
from matchloom.sources.tables import read_table

SCHEMA = "text_hash string, vec array<float>"


def text_hash(text: Column) -> Column:
    """256 bits that stand for a text; NULL counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class VectorTable:
    """A table of vectors by the hash of their text, one writer at a time.

    ``encoder`` is a function from a text column to an ``array<float>`` column; a table belongs to one
    encoder. Texts that the table lacks are reduced to one row each before they are encoded, however often they
    occur, and their vectors are written before they are used: a run that fails afterwards, and any later run,
    finds them. Where two broken runs stored a text twice, the smaller vector counts. Pass one as the
    ``encoder`` of a match.
    """

    def __init__(self, spark: SparkSession, path: str, encoder: Callable[[Column], Column]):
        self.spark, self.path, self.encoder = spark, path.rstrip("/"), encoder

    def vectors(self) -> DataFrame:
        return read_table(self.spark, self.path, SCHEMA).groupBy("text_hash").agg(F.min("vec").alias("vec"))

    def learn(self, docs: DataFrame, text: str) -> None:
        """Encode the texts that have no vector yet."""
        hashed = docs.select(text_hash(F.col(text)).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))
        known = read_table(self.spark, self.path, SCHEMA).select("text_hash")
        with temporary(self.spark):
            # Written first, so that no plan runs the encoder on both sides of a shuffle or twice.
            fresh = materialize(hashed.join(known, "text_hash", "left_anti").dropDuplicates(["text_hash"]), "new-texts")
            if fresh.take(1):
                # Encoding is long work on few bytes: the tasks are not to be merged by their size.
                parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
                fresh.repartition(parts, "text_hash").select(
                    "text_hash", self.encoder(F.col("text")).alias("vec")).write.mode("append").parquet(self.path)

    def attach(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with ``vec``; new texts are encoded and stored first."""
        self.learn(docs, text)
        return (docs.withColumn("_hash", text_hash(F.col(text)))
                .join(self.vectors().withColumnRenamed("text_hash", "_hash"), "_hash", "left").drop("_hash"))
