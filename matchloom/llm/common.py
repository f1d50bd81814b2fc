"""What the corpus operators share: inputs, stored intermediates, row iteration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.shared import materialize

__all__ = ["materialize", "packed", "read", "slices", "text_or_empty"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def packed(docs: DataFrame, *without: str) -> Column:
    """All columns but those named in one struct, so that working columns can't clash with them."""
    gone = {w.lower() for w in without}
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone]).alias("_row")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           budget: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``budget`` bytes of text.

    One row is never cut: a text larger than the budget is a slice of its own.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)))
        start = held = 0
        for i, size in enumerate(sizes.to_pylist()):
            if i > start and held + (size or 0) > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if batch.num_rows > start:
            yield batch.slice(start)
        del batch, sizes
        pa.default_memory_pool().release_unused()
