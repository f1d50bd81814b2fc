"""Search specifications."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.config import DEFAULT_EXPERIENCE
from matchloom.functions.web import search_url


def searches(spark: SparkSession, specs: Iterable[Mapping]) -> DataFrame:
    """Configured searches as rows; ``experience`` defaults to [0, 20]."""
    rows = []
    for spec in specs:
        low, high = spec.get("experience", DEFAULT_EXPERIENCE)
        rows.append((spec["keywords"], spec.get("location", ""), int(low), int(high)))
    return spark.createDataFrame(rows, schemas.SEARCHES)


def with_search_url(specs: DataFrame, base_url: str) -> DataFrame:
    low = F.coalesce(F.col("exp_min"), F.lit(DEFAULT_EXPERIENCE[0]))
    high = F.coalesce(F.col("exp_max"), F.lit(DEFAULT_EXPERIENCE[1]))
    return specs.withColumn(
        "search_url", search_url(base_url, F.col("keywords"), F.col("location"), low, high))
