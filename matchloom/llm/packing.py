"""Best-fit decreasing packing of tokenized documents into sequences.

Pieces of equal length are interchangeable, so the packing is planned on the counts per
length: at most ``size`` numbers, whatever the corpus. The plan walks the lengths
downward and keeps open bins by their remaining capacity in a segment tree, which finds
the tightest bin that fits in logarithmic time; runs of bins with the same history are
one entry, so a whole run is filled in one step. The result is exactly best-fit
decreasing for all pieces. Spark tokenizes, ranks the pieces of each length by prefix
sums over tasks, and looks every piece up in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.llm.common import materialize, slices, text_or_empty
from matchloom.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long"
PLACES = "sequence_id long, offset long"


class Capacities:
    """A segment tree over remaining capacities that counts the open bins of each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        node = self.leaves + capacity
        while node:
            self.total[node] += bins
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        node = self.leaves + least
        if self.total[node]:
            return least
        while node > 1:
            if not node & 1 and self.total[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.total[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts per length.

    Rows ``(length, first rank, pieces, first sequence, offset)``: the pieces of this
    length with ranks from the first on go, one each, into sequences from the first on.
    """
    tree, open_bins = Capacities(size), [deque() for _ in range(size + 1)]
    rows, used = [], 0

    def keep(first: int, bins: int, room: int, front: bool = False) -> None:
        if bins and room:
            (open_bins[room].appendleft if front else open_bins[room].append)((first, bins))
            tree.add(room, bins)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = size, used
                bins = -(-left // (size // length))
                used += bins
            else:
                first, bins = open_bins[room].popleft()
                tree.add(room, -bins)
            each = room // length  # the bin stays the tightest while it fits
            full = min(bins, left // each)
            some = left - full * each if bins > full else 0  # one more bin takes these
            for run, start, taken in ((full, first, each), (1, first + full, some)):
                for k in range(taken if run else 0):
                    rows.append((length, rank, run, start, size - room + k * length))
                    rank += run
            left -= full * each + some
            keep(first, full, room - each * length)
            keep(first + full, int(some > 0), room - some * length)
            full += some > 0
            keep(first + full, bins - full, room, front=True)
    return rows


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Every document cut into pieces of ``size`` ids, the shorter one first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary).encode, TaskContext.get().partitionId()
        met: Counter[int] = Counter()
        for part in slices(batches):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                edge = 0
                for number in range(-(-len(ids) // size)):
                    upto = edge + ((len(ids) - 1) % size + 1 if number == 0 else size)
                    length = upto - edge
                    rows.append((doc, number, edge, length, zlib.crc32(ids[edge:upto].tobytes()),
                                 task, met[length]))
                    met[length] += 1
                    edge = upto
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``size`` ids.

    A document is the ids of its text, then ``end_id``. One row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset. Null and empty texts are the one id
    ``end_id``; a null ``doc_id`` is carried along; repeated rows are packed each; an
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, size, end_id), "pieces")
    groups = cut.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    groups = materialize(groups.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))),
                         "piece-counts")
    # One number per length: bounded by the size of a sequence, not by the corpus.
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = sorted(plan(counts, size))
    span = 1 << 48
    keys = [length * span + rank for length, rank, *_ in rows]
    table = spark.sparkContext.broadcast((
        np.array(keys, np.int64), np.array([r[3] for r in rows], np.int64),
        np.array([r[4] for r in rows], np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, offsets = table.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                            for c in ("length", "_rank"))
            key = length * span + rank
            row = np.searchsorted(keys, key, side="right") - 1
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(first[row] + key - keys[row]), pa.array(offsets[row])]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(groups, ["_task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_nth")).alias("_rank"))
    return ranked.mapInArrow(place, PIECES.split(", _task")[0] + ", " + PLACES)
