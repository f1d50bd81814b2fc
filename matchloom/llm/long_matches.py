"""Long repeated byte strings, marked with run-length indexes.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else. To compare
all such windows of a corpus without sorting the corpus, each window is owned by its anchor: the
leftmost of the smallest hashes of the strings of half that length inside it. Equal windows have
equal anchors, neighbouring windows mostly share one, so the windows of a text fall into
segments; only segments whose anchor occurs twice can hold a repeat. Those are brought together
by anchor, equal ones folded into one, and groups of them indexed: the suffix array gives the
run-compressed Burrows-Wheeler transform, common prefixes are computed at run ends only, and a
pass in text order streams the matching statistics of every position from them.

A group with many distinct segments is cut into shorter segments under finer keys (the
bytes that all windows of a piece share), and at last into single windows, which are counted by
Spark. No window is left out at any level, and every match is decided on bytes or on 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, slices, text_or_empty

LENGTH = 400
GROUP = 256        # distinct segments up to which a group is indexed whole
PIECE = 24         # windows of a piece in the second level
BUCKET = 1 << 19   # bytes of segments indexed at once
CHUNK = 1 << 18    # bytes hashed at once
PLACE = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, from hashes of powers of two."""
    out, done = None, 0
    level, width = data.astype(np.uint64) + np.uint64(1), 1
    n = len(data) - size + 1
    while True:
        if size & width:
            part = level[done:done + n]
            out = part.copy() if out is None else _mixed(out * np.uint64(0xD6E8FEB86659FD93) + part)
            done += width
        if done == size:
            return _mixed(out)
        level = level[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + level[width:]
        width *= 2
        if width >= 8:
            level ^= level >> np.uint64(31)


def segments(data: np.ndarray, edges: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments ``(first window, windows, shift, anchor hash)`` of texts side by side in ``data``.

    ``shift`` is the distance of the anchor from the first window.

    ``edges`` are the places where texts begin, with the end of the last.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    size = length // 2
    n = len(data) - length + 1  # windows
    if n <= 0:
        return none
    hashes = gram_hashes(data, size)
    best = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    reach, span = 1, length - size + 1
    while 2 * reach <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    best = np.minimum(best[:n], best[span - reach:span - reach + n])
    anchor = (best & PLACE).astype(np.int64)
    counts = np.diff(edges)
    text = np.repeat(np.arange(len(counts)), counts)
    valid = text[:n] == text[length - 1:length - 1 + n]
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (text[1:n] != text[:n - 1])
    starts = np.flatnonzero(change)
    runs = np.diff(np.append(starts, n))
    keep = valid[starts]
    starts, runs = starts[keep], runs[keep]
    return starts, runs, anchor[starts] - starts, hashes[anchor[starts]]


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``text`` and the ranks by prefixes of 7, 14, 28 ... symbols.

    Symbols are bytes plus one; a zero ends a segment, and zeros differ from each other.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i:i + n]
    stops = np.flatnonzero(text == 0)
    following = np.searchsorted(stops, np.arange(n))
    near = np.where(stops[np.minimum(following, len(stops) - 1)] < np.arange(n) + 7, following + 1, 0)
    order = np.lexsort((near, key))
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (near[order[1:]] != near[order[:-1]])
    levels, width = [], 7
    while True:
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.cumsum(fresh)
        rank[n] = 0
        levels.append(rank)
        if fresh.all():
            return order, levels
        second = rank[np.minimum(np.arange(n) + width, n)]
        both = (rank[:n] << 32) | second
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        width *= 2


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes."""
    n = len(text)
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, rank = 7 << k, levels[k]
        same = rank[np.minimum(a, n)] == rank[np.minimum(b, n)]
        a, b, out = a + same * width, b + same * width, out + same * width
    for _ in range(7):
        x, y = text[np.minimum(a, n - 1)], text[np.minimum(b, n - 1)]
        same = (x == y) & (x > 0) & (a < n) & (b < n)
        a, b, out = a + same, b + same, out + same
    return out


def matching_statistics(text: np.ndarray) -> np.ndarray:
    """For each position, the longest string from there that also starts elsewhere."""
    n = len(text)
    order, levels = suffix_order(text)
    # The transform with its runs; a zero before a suffix always starts a run of its own.
    before = text[order - 1]
    before[order == 0] = 0
    split = (before[1:] != before[:-1]) | (before[1:] == 0)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(split)
    length = common_prefix(order[at], order[at + 1], levels, text)
    for who in (order[at + 1], order[at]):  # run starts look up, run ends look down
        furthest = np.zeros(n, np.int64)
        furthest[who] = length + who
        # Within runs the match goes on: one position later, one byte shorter.
        furthest = np.maximum.accumulate(furthest)
        out = np.maximum(out, furthest - np.arange(n))
    return out


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows of ``length`` bytes start elsewhere too."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]), np.int16)
    flat = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text[:] = flat.astype(np.int16) + 1
    text[ends - 1] = 0
    stats = matching_statistics(text)
    return [stats[e - 1 - s:e - length] >= length for s, e in zip(sizes, ends)]


def covered(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of bytes under runs of flagged windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) + length - 1) for a, b in zip(edge[::2], edge[1::2])]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _name(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    values = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, columns)],
                                      [c for c, _ in columns])


SEGMENTS = "_i long, _h long, start long, windows int, shift int, anchor long, digest long"
PARTS = "anchor long, digest long, shift int, bytes binary"
PIECES = "anchor long, digest long, at long, key long, name long, bytes binary"
WINDOWS = "key long, name long, at long, a long, b long"
FOUND = "key long, name long, from long, to long"


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """All segments of the documents, without their bytes: ``SEGMENTS``."""
    cut = 8 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK):
            rows, pieces = [], []
            for i, h, text in zip(*(c.to_pylist() for c in part.columns)):
                raw = text.encode()  # a text beyond the cut goes in overlapping pieces; no window is cut
                pieces += [(i, h, a, raw[a:a + cut + length - 1])
                           for a in range(0, max(0, len(raw) - length + 1), cut)]
            groups = [pieces] if sum(len(p[3]) for p in pieces) <= cut else [[p] for p in pieces]
            for group in filter(None, groups):
                edges = np.concatenate([[0], np.cumsum([len(p[3]) for p in group])])
                flat = b"".join(p[3] for p in group)
                starts, runs, shifts, anchors = segments(np.frombuffer(flat, np.uint8), edges, length)
                own = np.searchsorted(edges, starts, "right") - 1
                for g, s, n, shift, anchor in zip(own.tolist(), starts.tolist(), runs.tolist(),
                                                  shifts.tolist(), anchors.view(np.int64).tolist()):
                    i, h, a, _ = group[g]
                    rows.append((i, h, s - int(edges[g]) + a, n, shift, anchor, _name(flat[s:s + n + length - 1])))
            yield _table(rows, SEGMENTS)

    return docs.select("_i", "_h", "text").mapInArrow(run, SEGMENTS)


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments: ``PARTS``."""
    lists = wanted.groupBy("_i", "_h").agg(
        F.collect_list(F.struct("start", "windows", "shift", "anchor", "digest")).alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for text, found in zip(*(c.to_pylist() for c in part.columns)):
                raw = text.encode()
                for a in range(0, len(found), 4096):
                    yield _table([(s["anchor"], s["digest"], s["shift"],
                                   raw[s["start"]:s["start"] + s["windows"] + length - 1])
                                  for s in found[a:a + 4096]], PARTS)

    return docs.dropDuplicates(["_i", "_h"]).join(lists, ["_i", "_h"]).select("text", "_s").mapInArrow(run, PARTS)


def _index(groups: DataFrame, length: int) -> DataFrame:
    """Repeated stretches of distinct segments ``(key, name, bytes)``, by key: ``FOUND``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            flags = repeated_windows([part for _, _, part in held], length)
            rows = [(key, name, a, b) for (key, name, _), f in zip(held, flags) for a, b in covered(f, length)]
            held.clear()
            return _table(rows, FOUND)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size > BUCKET and row[0] != held[-1][0]:  # groups stay whole
                    yield done()
                    size = 0
                held.append(row)
                size += len(row[2])
        if held:
            yield done()

    return (groups.select("key", "name", "bytes").repartition("key").sortWithinPartitions("key", "name")
            .mapInArrow(run, FOUND))


def _pieces(parts: DataFrame, windows: int, length: int) -> DataFrame:
    """Segments cut into pieces of at most ``windows`` windows, keyed by what their windows share.

    Cuts lie at fixed distances from the anchor, so equal windows are in pieces of one key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "bytes", 500_000):
            rows = []
            for anchor, digest, shift, raw in zip(*(c.to_pylist() for c in part.columns)):
                first, n = 0, len(raw) - length + 1
                while first < n:
                    block = (first - shift) // windows
                    begin = block * windows + shift
                    core = raw[begin + windows - 1:begin + length]
                    upto = min(n, begin + windows)
                    piece = raw[first:upto + length - 1]
                    rows.append((anchor, digest, first, _name(block.to_bytes(8, "little", signed=True) + core),
                                 _name(piece), piece))
                    first = upto
            yield _table(rows, PIECES)

    return parts.select("anchor", "digest", "shift", "bytes").mapInArrow(run, PIECES)


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """Every window of ``(key, name, bytes)`` with 128 bits of hash: ``WINDOWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "bytes", 100_000):
            rows = []
            for key, name, raw in zip(*(c.to_pylist() for c in part.columns)):
                for at in range(len(raw) - length + 1):
                    both = hashlib.blake2b(raw[at:at + length], digest_size=16).digest()
                    rows.append((key, name, at, int.from_bytes(both[:8], "little", signed=True),
                                 int.from_bytes(both[8:], "little", signed=True)))
            yield _table(rows, WINDOWS)

    return pieces.select("key", "name", "bytes").mapInArrow(run, WINDOWS)


def _grouped(distinct: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct segments those in groups to index, and those in larger groups."""
    sizes = distinct.groupBy("key").agg(F.count("*").alias("_m")).filter("_m > 1")
    held = distinct.join(sizes, "key")
    return held.filter(F.col("_m") <= group).drop("_m"), held.filter(F.col("_m") > group).drop("_m")


def repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``(_i, _h, from, to)``: stretches of ``docs(_i, _h, text)`` that lie under repeated windows."""
    every = materialize(_segments(docs, length), "segments")
    one = every.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("_i", "_h", "start", "windows", "shift")])
    one = materialize(one, "distinct-segments")
    shared = one.groupBy("anchor").agg(F.count("*").alias("_m")).filter("_m > 1").select("anchor")
    parts = materialize(_cut(docs, one.join(shared, "anchor"), length), "segment-bytes")

    whole = one.filter("copies > 1").select(
        "anchor", "digest", F.lit(0).cast("long").alias("from"), (F.col("windows") + F.lit(length - 1)).cast("long").alias("to"))
    some, hot = _grouped(parts.select(F.col("anchor").alias("key"), F.col("digest").alias("name"), "shift", "bytes"), group)
    found = _index(some, length).select(F.col("key").alias("anchor"), F.col("name").alias("digest"), "from", "to")

    cuts = materialize(_pieces(hot.select(F.col("key").alias("anchor"), F.col("name").alias("digest"), "shift", "bytes"),
                               PIECE, length), "pieces")
    unit = materialize(cuts.groupBy("key", "name").agg(F.count("*").alias("copies"), F.first("bytes").alias("bytes")),
                       "distinct-pieces")
    few, many = _grouped(unit.select("key", "name", "bytes"), group)
    single = materialize(_windows(many, length), "windows")
    twice = single.groupBy("a", "b").agg(F.count("*").alias("_c")).filter("_c > 1").select("a", "b")
    fine = (unit.filter("copies > 1").select("key", "name", F.lit(0).cast("long").alias("from"),
                                             F.length("bytes").cast("long").alias("to"))
            .unionByName(_index(few, length))
            .unionByName(single.join(twice, ["a", "b"]).select(
                "key", "name", F.col("at").alias("from"), (F.col("at") + length).alias("to"))))
    finer = cuts.select("anchor", "digest", "at", "key", "name").join(fine, ["key", "name"]).select(
        "anchor", "digest", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to"))
    marks = materialize(whole.unionByName(found).unionByName(finer), "repeats")
    return every.select("_i", "_h", "start", "anchor", "digest").join(marks, ["anchor", "digest"]).select(
        "_i", "_h", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary).

    Null text counts as empty. Texts shorter than ``length`` bytes have no window and stay whole. All copies of a
    repeated stretch go, in repeated rows too, since each also starts in another row. Rows are told
    apart by ``doc_id`` (null is one value) and text. Other columns are not read; an empty table gives no rows.
    """
    data = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumns({
        "_i": F.coalesce("doc_id", F.lit(-(1 << 63))), "_h": F.xxhash64("text")})
    marks = repeats(data.select("_i", "_h", "text"), length, group)
    lists = marks.groupBy("_i", "_h").agg(F.collect_set(F.struct("from", "to")).alias("_s"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for doc, text, found in zip(*(c.to_pylist() for c in part.columns)):
                raw = text.encode()
                gone = merged([(s["from"], s["to"]) for s in found or ()])
                edges = [0, *[x for r in gone for x in r], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows))
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             [c.split()[0] for c in schema.split(", ")])

    return data.join(lists, ["_i", "_h"], "left").select("doc_id", "text", "_s").mapInArrow(run, schema)
