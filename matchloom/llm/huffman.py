"""Token ids in a file format of canonical, length-limited Huffman codes.

A folder holds two tables. ``codes`` has one row per id with its code length; canonical
codes follow from the lengths alone. ``blocks`` has one file per range of documents in
ascending ``doc_id`` order; a row is a block that decodes on its own: the documents with
their numbers of ids, the bits, and the bit offset of every ``STEP``-th id. Decoding walks
all checkpoints of a block at once and looks up every code in a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.llm.common import materialize, slices, text_or_empty
from matchloom.llm.tokens import encoder

STEP = 64            # ids between two checkpoints
BLOCK_IDS = 1 << 18  # a block ends with the document that reaches this many ids
LIMIT = 20           # longest code in bits, or more if there are more ids than codes of that length
BLOCKS = ("part long, block int, doc_ids array<long>, counts array<long>, first long, "
          "n_ids long, checkpoints array<long>, bits binary")


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; more than ``2 ** limit`` ids get
    the least limit that all of them fit."""
    if len(counts) < 2:
        return {i: 1 for i in counts}
    limit = max(limit, (len(counts) - 1).bit_length())
    order = sorted(counts, key=lambda i: (counts[i], i))
    weight = np.array([counts[i] for i in order], np.float64)
    n = len(order)
    # Each level keeps which of its sorted entries are single ids; packages are pairs of the level before.
    levels, entries = [], weight
    single = np.ones(n, bool)
    levels.append(single)
    for _ in range(limit - 1):
        pairs = entries[: len(entries) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, pairs])
        rank = np.argsort(merged, kind="stable")
        entries, single = merged[rank], rank < n
        levels.append(single)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        ids = int(single[:take].sum())
        lengths[:ids] += 1
        take = 2 * (take - ids)
    return {i: int(b) for i, b in zip(order, lengths)}


class Codes:
    """Canonical codes: ordered by length, then id."""

    def __init__(self, lengths: dict[int, int]):
        ids, bits = np.fromiter(lengths, np.int64), np.fromiter(lengths.values(), np.int64)
        order = np.lexsort((ids, bits))
        ids, bits = ids[order], bits[order]
        size = int(ids.max()) + 1 if len(ids) else 1
        self.width = int(bits.max()) if len(ids) else 1
        self.bits, self.code = np.zeros(size, np.int64), np.zeros(size, np.int64)
        step = 1 << (self.width - bits)
        start = np.cumsum(step) - step
        self.bits[ids], self.code[ids] = bits, start >> (self.width - bits)
        self.table_id = np.zeros(1 << self.width, np.uint32)
        self.table_bits = np.ones(1 << self.width, np.uint8)
        filled = int(step.sum())
        self.table_id[:filled] = np.repeat(ids, step)
        self.table_bits[:filled] = np.repeat(bits, step)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids and the offset of every ``STEP``-th."""
        bits, code = self.bits[ids], self.code[ids]
        start = np.cumsum(bits) - bits
        total = int(start[-1] + bits[-1]) if len(ids) else 0
        word, used = start >> 5, (start & 31) + bits
        room = 64 - used  # codes go into pairs of 32-bit words
        both = code << np.maximum(room, 0)
        size = (total + 31) // 32 + 2
        # Codes never overlap, so sums per word are exact and equal to a bitwise or.
        words = np.bincount(word, weights=((both >> 32) & 0xFFFFFFFF).astype(np.float64), minlength=size)
        words[1:] += np.bincount(word, weights=(both & 0xFFFFFFFF).astype(np.float64), minlength=size)[:-1]
        return words.astype(">u4").tobytes(), start[::STEP]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n_ids: int) -> np.ndarray:
        words = np.frombuffer(bits, ">u4").astype(np.int64)
        pairs = (words[:-1] << 32) | words[1:]  # the sign bit is cut off below
        at, out = checkpoints.astype(np.int64), np.zeros((STEP, len(checkpoints)), np.uint32)
        mask, last = (1 << self.width) - 1, len(pairs) - 1
        for k in range(STEP):
            here = np.minimum(at, last << 5)
            entry = (pairs[here >> 5] >> (64 - self.width - (here & 31))) & mask
            out[k] = self.table_id[entry]
            at = at + self.table_bits[entry]
        return out.T.reshape(-1)[:n_ids]


def token_ids(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Ids of whole texts as little-endian 32-bit integers, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for part in slices(batches):
            ids = [np.append(i, np.uint32(end_id)).astype("<u4") for i in encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([i.astype("<u2").tobytes() if i.max() < 65536 else b"" for i in ids], pa.binary()),
                 pa.array([b"" if i.max() < 65536 else i.tobytes() for i in ids], pa.binary())],
                ["doc_id", "n", "short", "long"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n long, short binary, long binary")


def _ids(short: bytes, long: bytes) -> np.ndarray:
    return np.frombuffer(short, "<u2") if short else np.frombuffer(long, "<u4")


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1) -> None:
    """Write the ids of ``docs(doc_id, text)`` in ascending ``doc_id`` order.

    Null texts are empty. Null ``doc_id`` come first; rows that share a ``doc_id`` are
    ordered by their ids. Other columns are not read. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    ids = materialize(token_ids(docs, vocabulary, end_id), "token-ids")

    def added(total: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        found = np.bincount(np.concatenate(held), minlength=len(total))
        found[: len(total)] += total
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            held, size = [], 0
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(_ids(*pair))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    total, held, size = added(total, held), [], 0
            if held:
                total = added(total, held)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())],
                                         ["id", "n"])

    # One row per id of the vocabulary: bounded, however large the corpus is.
    counts = {r["id"]: r["n"] for r in ids.select("short", "long").mapInArrow(count, "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).collect()}
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), b) for i, b in lengths.items()], "id long, bits int").coalesce(1) \
        .write.parquet(f"{folder}/codes")
    shared = spark.sparkContext.broadcast(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = Codes(shared.value), TaskContext.get().partitionId()
        held, names, first, number = [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal first, number
            flat = np.concatenate(held)
            bits, checkpoints = codes.encode(flat)
            row = [part, number, list(names), [len(h) for h in held], first, len(flat), checkpoints, bits]
            first, number = first + len(flat), number + 1
            held.clear(), names.clear()
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(),
                     pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              [c.split()[0] for c in BLOCKS.split(", ")])

        size = 0
        for batch in batches:
            for doc, short, long in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(_ids(short, long).astype(np.int64))
                names.append(doc)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    size = 0
        if held:
            yield block()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (ids.repartitionByRange(parts, "doc_id", F.xxhash64("short", "long"))
        .sortWithinPartitions("doc_id", "short", "long").select("doc_id", "short", "long")
        .mapInArrow(blocks, BLOCKS).write.parquet(f"{folder}/blocks"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files: one row per document with doc_id, start, n_tokens, ids, ids_crc32.

    ``start`` counts the ids of all documents before it.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    lengths = {r["id"]: r["bits"] for r in
               spark.read.schema("id long, bits int").parquet(f"{folder}/codes").collect()}
    shared = spark.sparkContext.broadcast(lengths)
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = codes.decode(row["bits"], np.asarray(row["checkpoints"]), row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                raw = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts + row["first"] + row["_before"], pa.int64()),
                     pa.array(row["counts"], pa.int64()), pa.array(raw, pa.binary()),
                     pa.array([zlib.crc32(r) for r in raw], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return blocks.join(F.broadcast(offsets), "part").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
