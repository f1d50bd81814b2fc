"""First row, top N and rank per key, and null-safe lookups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.shared import materialize


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their 1-based position.

    Spark turns the rank filter into a group limit that runs before the shuffle,
    so a hot key sends at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def null_safe_anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; NULL keys equal each other."""
    right = right.select(*keys)
    return left.join(right, _same(left, right, keys), "left_anti")


def null_safe_semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.select(*keys)
    return left.join(right, _same(left, right, keys), "left_semi")


def null_safe_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     how: str = "inner") -> DataFrame:
    """``left`` with the non-key columns of ``right``, NULL keys equal each other."""
    renamed = right.select(*[
        F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def hot_keys(rows: DataFrame, keys: Sequence[str], parts: int = 8) -> DataFrame | None:
    """``(_hash, _parts)``: hashes of the keys that hold more than half a partition's share of the rows.

    A mergeable sketch of frequent items reads the keys once. At most two keys per shuffle partition can be
    that frequent, so the result has a bounded size. A key gets as many parts as make each about one in ``parts``
    of a partition's share. None if there is no such key.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, top = rows.select(F.xxhash64(*keys).alias("_hash")).agg(
        F.count("*"), F.expr(f"approx_top_k(_hash, {2 * partitions}, {16 * partitions})")).first()
    found = [(t["item"], math.ceil(parts * t["count"] * partitions / n))
             for t in top or () if 2 * t["count"] * partitions > n]
    return spark.createDataFrame(found, "_hash long, _parts int") if found else None


def spread_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                  counted: DataFrame | None = None) -> DataFrame:
    """:func:`null_safe_lookup` for keys that many rows of ``left`` share, empty and NULL ones too.

    Rows of a hot key are dealt into parts by all their columns, and the rows of ``right`` with that key are
    copied once per part; other keys are joined as they are. The copies number at most a few per partition and
    row of such a key, however large ``left`` is. Every row of ``left`` meets each of its partners once, so the
    sketch decides about speed only. The keys are read once before, from ``counted`` if ``left`` is no table.
    """
    hot = hot_keys(left if counted is None else counted, keys)
    if hot is None:
        return null_safe_lookup(left, right, keys, how)
    hot = F.broadcast(hot)

    def marked(side: DataFrame) -> DataFrame:
        return side.withColumn("_hash", F.xxhash64(*keys)).join(hot, "_hash", "left").drop("_hash")

    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns], F.lit("part")), F.coalesce("_parts", F.lit(1)))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return null_safe_lookup(
        marked(left).withColumn("_part", part.cast("int")).drop("_parts"),
        marked(right).withColumn("_part", copies).drop("_parts"), [*keys, "_part"], how).drop("_part")


def rank_all(df: DataFrame, key: str, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Every row with its 1-based position in its group, groups of any size.

    A plain window would sort one group in one task. Here the rows are range
    partitioned by (key, order), so a large group spans many partitions; each
    partition ranks its own slice and adds the row counts of the slices before it.
    ``order`` has to be total within a key.
    """
    sliced = materialize(
        df.repartitionByRange(F.col(key).asc_nulls_first(), *order)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    sizes = sliced.groupBy(key, "_slice").count()
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        key, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_slice", key).orderBy(*order))
    return (
        null_safe_lookup(sliced.withColumn("_local", local), offsets, [key, "_slice"])
        .withColumn(rank, F.col("_offset") + F.col("_local"))
        .drop("_slice", "_offset", "_local")
    )
