"""Shards in random order by a two-pass external shuffle.

The first pass scatters rows uniformly into buckets by a seeded hash of the row's number, so that
neither equal texts nor equal ids meet; the exchange that does so is the external storage. A bucket
holds about ``bucket_bytes`` and is one task of the second pass, which shuffles it in memory
(``shuffle`` of an array is a seeded Fisher-Yates) and writes it. Buckets follow each
other in one order of all rows, and the shards are equal parts of that order, so their numbers of
rows differ by one at most.

DataFrame functions only. A bucket's place in the order comes from its size, counted beforehand from
row numbers alone, without reading a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, packed

LAW = "rows"
GROUP = 1024  # buckets whose sizes are summed in one task
ROW_BYTES = 64  # what a row weighs in memory besides its text


def _buckets(docs: DataFrame, bucket_bytes: int) -> tuple[int, int]:
    """Number of rows, and of buckets: at least as many as tasks of an exchange."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    got = docs.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return got["n"], max(least, -(-(got["bytes"] or 0) // bucket_bytes))


def _starts(buckets: DataFrame) -> DataFrame:
    """``(_bucket, _before)``: rows in earlier buckets, summed in two levels."""
    sizes = materialize(buckets.groupBy("_bucket").agg(F.count("*").alias("_n")), "bucket-sizes").withColumn(
        "_group", F.floor(F.col("_bucket") / GROUP))

    def before(n: str, window: Window) -> F.Column:
        return F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_m")).select(
        "_group", before("_m", Window.orderBy("_group")).alias("_start"))
    inside = sizes.withColumn("_inside", before("_n", Window.partitionBy("_group").orderBy("_bucket")))
    return inside.join(groups, "_group").select("_bucket", (F.col("_start") + F.col("_inside")).alias("_before"))


def write(docs: DataFrame, folder: str, shards: int = 8, seed: int = 0, bucket_bytes: int = 32 << 20) -> None:
    """Write the rows of ``docs`` (one column is ``text``) to ``folder/shard=K``, in random order.

    All columns are kept, and ``slot`` is added: a row's place in its shard, from 0 without gaps
    (existing columns ``shard`` and ``slot`` go). A row with a null or empty text is a row like
    any other; repeated rows stay, each on its own place; null ids do no harm, since no column decides where
    a row goes. With fewer rows than shards, the last shards are empty; an empty table writes
    no files. One row is never cut: a text larger than a bucket makes its task that large.
    The same rows in the same files under the same seed and settings give the same shards.

    ``docs`` is read three times and its rows have to come in the same order each time, as
    those of a stored table do. If they did not, the result is checked and this raises.
    """
    n, buckets = _buckets(docs, bucket_bytes)
    number = F.monotonically_increasing_id()
    bucket = F.pmod(F.xxhash64(F.lit(seed), number), F.lit(buckets)).cast("int").alias("_bucket")
    starts = _starts(docs.select(bucket))
    row = F.struct(F.xxhash64(F.lit(seed + 1), "_number").alias("h"), "_number", "_row")
    rows = docs.select(packed(docs, "shard", "slot"), number.alias("_number"), bucket).select(
        "_bucket", row.alias("_r"), F.lit(None).cast("long").alias("_before"))
    # A bucket's start travels with its rows, which saves a join of the texts.
    none = F.lit(None).cast(rows.schema["_r"].dataType)
    marked = rows.unionByName(starts.select("_bucket", none.alias("_r"), "_before"))
    gathered = marked.repartitionById(buckets, "_bucket").groupBy("_bucket").agg(
        F.max("_before").alias("_before"), F.collect_list("_r").alias("_rs")).sortWithinPartitions("_bucket")
    # The order in which rows arrive is not the same on every run: known order first, then Fisher-Yates.
    handles = F.array_sort(F.transform("_rs", lambda r, i: F.struct(r["h"], r["_number"], i.alias("i"))))
    shuffled = F.transform(F.shuffle("_hs", seed), lambda h: F.get("_rs", h["i"])["_row"])
    # Place p is in shard p * shards div n, which begins at the least such p.
    shard = F.expr(f"cast(_place * {shards} div {max(1, n)} as int)")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    out = (gathered.select("_before", "_rs", handles.alias("_hs")).select("_before", shuffled.alias("_rows"))
           .select("_before", F.posexplode("_rows").alias("pos", "_row"))
           .select("_row", (F.col("_before") + F.col("pos")).alias("_place")).select("_row", "_place", shard.alias("shard"))
           .select("_row.*", (F.col("_place") - first).alias("slot"), "shard"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    _check(read(docs.sparkSession, folder, docs), n, shards)


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Rows of all shards; ``like`` has the columns that were written."""
    schema = like.select(packed(like, "shard", "slot")).select("_row.*").schema
    return spark.read.schema(schema.add("slot", "long").add("shard", "integer")).parquet(folder)


def _check(written: DataFrame, n: int, shards: int) -> None:
    got = {r["shard"]: r for r in written.groupBy("shard").agg(
        F.count("*").alias("n"), F.max("slot").alias("last"), F.sum("slot").alias("total")).collect()}
    for k in range(shards):
        want = -(-(k + 1) * n // shards) - -(-k * n // shards)
        row = got.get(k)
        if (want and not row) or (row and (row["n"], row["last"], row["total"]) != (want, want - 1, want * (want - 1) // 2)):
            raise RuntimeError("rows came in another order when read again: write them to a table first")
