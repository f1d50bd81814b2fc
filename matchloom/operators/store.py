"""Insert-only tables, derived flags and the status log."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchloom import schemas
from matchloom.functions.text import or_empty
from matchloom.operators.keys import (
    first_per_key, null_safe_anti, null_safe_lookup, null_safe_semi,
)
from matchloom.operators.shared import make_folder, matching, materialize, new_folder, remove, rename, temporary
from matchloom.sources.tables import read_table

JOB_KEY = ["job_id"]
MATCH_KEY = ["job_id", "resume_file"]


def job_defaults(jobs: DataFrame, now: Column) -> DataFrame:
    """Incoming jobs in table shape; missing columns and values get their defaults."""
    columns = set(jobs.columns)

    def column(name: str, kind) -> Column:
        return (F.col(name) if name in columns else F.lit(None)).cast(kind)

    defaults = {"skills": or_empty, "description": lambda c: F.coalesce(c, F.lit("")),
                "scraped_at": lambda c: F.coalesce(c, now)}
    return jobs.select(*[
        defaults.get(f.name, lambda c: c)(column(f.name, f.dataType)).alias(f.name)
        for f in schemas.JOBS
    ])


def match_defaults(matches: DataFrame, now: Column) -> DataFrame:
    columns = set(matches.columns)
    out = []
    for f in schemas.MATCHES:
        value = (F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType)
        if f.name == "matched_skills":
            value = or_empty(value)
        if f.name == "created_at":
            value = F.coalesce(value, now)
        out.append(value.alias(f.name))
    return matches.select(*out)


def unseen(incoming: DataFrame, existing: DataFrame, keys: Sequence[str],
           order: Sequence[Column]) -> DataFrame:
    """First incoming row per key, for keys that ``existing`` does not hold yet.

    Known keys go first, so that only rows that may be inserted are ranked.
    """
    return first_per_key(null_safe_anti(incoming, existing, keys), keys, order)


def new_jobs(incoming: DataFrame, existing: DataFrame, order: Sequence[Column],
             now: Column) -> DataFrame:
    return job_defaults(unseen(incoming, existing, JOB_KEY, order), now)


def new_matches(incoming: DataFrame, existing: DataFrame, order: Sequence[Column],
                now: Column) -> DataFrame:
    return match_defaults(unseen(incoming, existing, MATCH_KEY, order), now)


def unmatched_jobs(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    return null_safe_anti(jobs, matches.select(*JOB_KEY).distinct(), JOB_KEY)


def matched_jobs(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Jobs with a match: the ``matched`` flag, derived instead of updated.

    Ids are made distinct where the matches are read, so that a job with very many matches is sent once per task.
    """
    return null_safe_semi(jobs, matches.select(*JOB_KEY).distinct(), JOB_KEY)


def latest_status(log: DataFrame) -> DataFrame:
    """The latest state per key; of states at one time the last in the alphabet."""
    return log.groupBy(*MATCH_KEY).agg(F.max_by("status", F.struct("ts", "status")).alias("status"))


def with_applied(matches: DataFrame, log: DataFrame) -> DataFrame:
    """Matches with ``applied`` 0/1 from the latest state of the log."""
    joined = null_safe_lookup(matches, latest_status(log), MATCH_KEY, "left")
    return joined.withColumn("applied", F.when(F.col("status") == "applied", 1).otherwise(0)).drop(
        "status")


LOOKUP = 1000  # so many keys at most are looked up by value; more of them by a join
#: What each table's rows are found by.
TABLES = {"jobs": (schemas.JOBS, JOB_KEY), "matches": (schemas.MATCHES, MATCH_KEY),
          "match_status": (schemas.MATCH_STATUS, MATCH_KEY)}


class Store:
    """Jobs, matches and the status log as parquet folders with one writer.

    A table is cut into buckets by a hash of its key, each a folder, and its files have Bloom filters
    of the key: an insert reads the keys of the buckets that its rows fall into, and nothing else. Only unseen
    keys are added and no row is ever touched, so a repeated write (a streaming batch after a
    failure) adds nothing. ``compact`` merges the small files that many inserts leave.

    ``buckets`` counts when the store is new; later it is what the store was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark = spark
        self.path = (path or new_folder(spark, "store")).rstrip("/")
        self._buckets, self._wanted = None, buckets

    @property
    def buckets(self) -> int:
        if self._buckets is None:
            made = matching(self.spark, f"{self.path}/_buckets=*")
            if not made:
                made = [f"{self.path}/_buckets={self._wanted}"]
                make_folder(self.spark, made[0])
            self._buckets = int(made[0].rsplit("=", 1)[1])
        return self._buckets

    def _bucket(self, keys: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _stored(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """Rows with their bucket, batch and write; of some buckets only, if they are given."""
        path = f"{self.path}/{table}"
        schema = StructType(list(TABLES[table][0])).add("batch", "string").add("bucket", "integer").add("write", "string")
        if buckets is None or len(buckets) == self.buckets:
            return read_table(self.spark, path, schema)
        some = ",".join(map(str, sorted(buckets))) or "none"
        return read_table(self.spark, f"{path}/bucket={{{some}}}", schema, basePath=path)

    def _read(self, table: str) -> DataFrame:
        return self._stored(table).select(*TABLES[table][0].names)

    def jobs(self) -> DataFrame:
        return self._read("jobs")

    def matches(self) -> DataFrame:
        return self._read("matches")

    def status_log(self) -> DataFrame:
        return self._read("match_status")

    def among(self, table: str, rows: DataFrame) -> tuple[DataFrame, set[int]]:
        """Stored rows that may have a key of ``rows``, and the buckets that ``rows`` fall into.

        Few keys are looked up by value, which file statistics and Bloom filters answer for most files.
        """
        _, keys = TABLES[table]
        asked = rows.select(self._bucket(keys).alias("bucket"), *keys).distinct()
        few = asked.limit(LOOKUP + 1).collect()
        if len(few) > LOOKUP:
            buckets = {r["bucket"] for r in asked.select("bucket").distinct().collect()}  # no more than the store has
            return self._stored(table, buckets), buckets
        buckets = {r["bucket"] for r in few}
        stored = self._stored(table, buckets)
        for k in keys:
            values = {r[k] for r in few}
            some = F.col(k).isin(sorted(values - {None}))
            stored = stored.where(some | F.col(k).isNull() if None in values else some)
        return stored, buckets

    def _append(self, table: str, rows: DataFrame, batch: str) -> str:
        """Add rows in table shape; returns the name of the write."""
        keys, write = TABLES[table][1], uuid.uuid4().hex
        out = rows.withColumns({"batch": F.lit(batch), "bucket": self._bucket(keys), "write": F.lit(write)})
        self._put(out, table, f"{self.path}/{table}", ["bucket", "write"])
        return write

    def _put(self, rows: DataFrame, table: str, path: str, parts: list[str]) -> None:
        keys = TABLES[table][1]
        writer = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *keys).write.mode("append")
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy(*parts).parquet(path)

    def _save(self, table: str, incoming: DataFrame, batch: str, order: Sequence[Column],
              shaped: Callable[[DataFrame], DataFrame], again: bool) -> DataFrame:
        schema, keys = TABLES[table]
        self.recover(table)
        with temporary(self.spark):
            # Written first: it is read for its buckets and for its rows, which have to agree.
            held = materialize(incoming.select(*[
                F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`")
                for c, kind in incoming.dtypes]), "incoming")
            stored, buckets = self.among(table, held)
            write = self._append(table, shaped(unseen(held, stored, keys, order)), batch)
        own = F.col("batch") == batch if again else F.col("write") == write
        return self._stored(table, buckets).where(own).select(*schema.names)

    def save_jobs(self, incoming: DataFrame, batch: str, order: Sequence[Column],
                  now: Column, again: bool = False) -> DataFrame:
        """Insert jobs with unseen ``job_id``; returns the inserted rows.

        ``again``: returns what an earlier, broken attempt at the same batch inserted as well.
        """
        return self._save("jobs", incoming, batch, order, lambda rows: job_defaults(rows, now), again)

    def save_matches(self, incoming: DataFrame, batch: str, order: Sequence[Column],
                     now: Column, again: bool = False) -> DataFrame:
        """Insert matches with an unseen (job, resume) pair; scores are never refreshed. Returns as ``save_jobs`` does."""
        return self._save("matches", incoming, batch, order, lambda rows: match_defaults(rows, now), again)

    def unmatched_jobs(self) -> DataFrame:
        return unmatched_jobs(self.jobs(), self.matches())

    def mark_applied(self, pairs: DataFrame, batch: str, ts: Column) -> DataFrame:
        """Log ``applied`` for the pairs that are stored matches; returns the rows added to the log."""
        self.recover("match_status")
        with temporary(self.spark):
            asked = materialize(pairs.select(*MATCH_KEY).distinct(), "pairs")
            matches, buckets = self.among("matches", asked)
            known = null_safe_semi(asked, matches, MATCH_KEY)
            rows = known.select(*MATCH_KEY, F.lit("applied").alias("status"),
                                ts.cast("timestamp").alias("ts"))
            log = self._stored("match_status", buckets)
            write = self._append("match_status", null_safe_anti(rows, log, [*MATCH_KEY, "status", "ts"]), batch)
        return self._stored("match_status", buckets).where(F.col("write") == write).select(*schemas.MATCH_STATUS.names)

    def matches_with_status(self) -> DataFrame:
        return with_applied(self.matches(), self.status_log())

    def compact(self, table: str, files: int = 8) -> int:
        """Rewrite the buckets that hold more than ``files`` files; returns how many.

        The rows are written aside first, then a note of the folders that they replace; only then are folders
        exchanged. After a failure the next insert ends the exchange (``recover``), so no row is lost or
        doubled. Nobody else may read or write meanwhile.
        """
        self.recover(table)
        path = f"{self.path}/{table}"
        held = Counter(p.rsplit("/", 2)[0] for p in matching(self.spark, f"{path}/bucket=*/write=*/part-*"))
        full = {int(p.rsplit("=", 1)[1]) for p, n in held.items() if n > files}
        if not full:
            return 0
        old = [p for k in sorted(full) for p in matching(self.spark, f"{path}/bucket={k}/write=*")]
        name = uuid.uuid4().hex
        self._put(self._stored(table, full).drop("write"), table, f"{path}/_new-{name}", ["bucket"])
        note = self.spark.createDataFrame([(p,) for p in old], "path string").coalesce(1)
        note.write.json(f"{path}/_swap-{name}")
        self.recover(table)
        return len(full)

    def recover(self, table: str) -> None:
        """End exchanges of folders that a broken ``compact`` left; drop rows written aside without a note."""
        path = f"{self.path}/{table}"
        for note in matching(self.spark, f"{path}/_swap-*"):
            name = note.rsplit("_swap-", 1)[1]
            if matching(self.spark, f"{note}/_SUCCESS"):
                # Old folders go first: what is left of a broken exchange is then never counted twice.
                for row in self.spark.read.schema("path string").json(note).collect():  # a folder per small write
                    remove(self.spark, row["path"])
                for bucket in matching(self.spark, f"{path}/_new-{name}/bucket=*"):
                    rename(self.spark, bucket, f"{path}/{bucket.rsplit('/', 1)[1]}/write={name}")
            remove(self.spark, f"{path}/_new-{name}")
            remove(self.spark, note)
        for aside in matching(self.spark, f"{path}/_new-*"):
            remove(self.spark, aside)
