"""The best rows per key of everything seen so far, kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.keys import first_per_key, top_per_key
from matchloom.operators.shared import matching, remove

DIGITS = 12  # of a version's name, so that names sort as numbers


class BestTable:
    """The first ``n`` rows per key of all batches, as versions that replace each other.

    The best rows of a union are among the best of its parts, so a batch is reduced to ``n`` rows a key and
    merged with the version before it: no earlier batch is read again, and the table grows with the
    keys only. A version is a folder named by its batch. It counts once it is complete, and a batch that is
    repeated starts from the version before its own, so a replay changes nothing. The version that the last one
    came from stays for readers; older ones go.

    ``same`` are the columns that make a row the same one: of several such rows the first in ``order`` counts.
    ``order`` must be total within a key, but for rows that are the same.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], same: Sequence[str],
                 order: Callable[[], Sequence[Column]], n: int = 10):
        self.spark, self.path, self.n = spark, path.rstrip("/"), n
        self.keys, self.same, self.order = list(keys), list(same), order

    def versions(self) -> list[int]:
        done = matching(self.spark, f"{self.path}/version=*/_SUCCESS")
        return sorted(int(p.rsplit("/", 2)[1].split("=")[1]) for p in done)

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version:0{DIGITS}d}"

    def read(self) -> DataFrame | None:
        """The rows with their ``rank``; None before the first batch."""
        known = self.versions()
        return self.spark.read.parquet(self._folder(known[-1])) if known else None

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Bring in a batch; numbers rise, and an already replaced number is left alone."""
        known = self.versions()
        if known and known[-1] > batch:
            return
        earlier = [v for v in known if v < batch]
        # Reduced before the union, so a hot key sends n rows a task.
        every = self._best(rows)
        if earlier:
            stored = self.spark.read.schema(every.schema).parquet(self._folder(earlier[-1]))
            every = self._best(stored.drop("rank").unionByName(every.drop("rank")))
        every.write.mode("overwrite").parquet(self._folder(batch))
        for old in earlier[:-1]:
            remove(self.spark, self._folder(old))

    def _best(self, rows: DataFrame) -> DataFrame:
        once = first_per_key(rows.drop("rank"), list(dict.fromkeys([*self.keys, *self.same])), self.order())
        return top_per_key(once, self.keys, self.order(), self.n)
