"""Texts cut into keywords and words where they are scored, as the column expressions cut them.

A text goes to a task as it is; its words as a list would cost several times as much on the way. What a word
character is comes from the JVM, so both ways agree on every character.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import LETTER

BYTES_PER_CUT = 1 << 21  # of texts cut at a time; one text at least
KEYWORD_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789+#", np.uint8))


def letters(spark: SparkSession) -> bytes:
    """For every code point whether it is a word character, a bit each."""
    character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF)).where(character.rlike(LETTER))
    flags = np.zeros(0x110000, bool)
    flags[points.toArrow()["id"].to_numpy()] = True
    return np.packbits(flags).tobytes()


def _runs(of: np.ndarray, inside: np.ndarray, sizes: np.ndarray, least: int,
          data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Runs of characters of one row that are ``inside``, at least so many: their rows and texts.

    A character has its row (``of``) and its number of bytes (``sizes``) of ``data``.
    """
    edge = np.ones(len(inside) + 1, bool)
    edge[1:-1] = (inside[1:] != inside[:-1]) | (of[1:] != of[:-1])
    bounds = np.flatnonzero(edge)
    begin, end = bounds[:-1], bounds[1:]
    kept = inside[begin] & (end - begin >= least)
    begin, end = begin[kept], end[kept]
    place = np.append(0, np.cumsum(sizes, dtype=np.int64))
    first, last = place[begin], place[end]
    step = np.zeros(len(data) + 1, np.int8)
    step[first] += 1
    step[last] -= 1  # no place starts two runs, or ends two
    held = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    offsets = np.append(0, np.cumsum(last - first)).astype(np.int64)
    return of[begin], pa.Array.from_buffers(
        pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(held)])


def _lists(rows: np.ndarray, items: pa.Array, n: int) -> pa.Array:
    offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), items.cast(pa.string()))


def _without(rows: np.ndarray, items: pa.Array, stop_words: Sequence[str]) -> tuple[np.ndarray, pa.Array]:
    keep = pc.invert(pc.is_in(items, pa.array(list(stop_words), items.type)))
    return rows[keep.to_numpy(zero_copy_only=False)], items.filter(keep)


def cut(texts: pa.Array, word: np.ndarray, stop_words: Sequence[str],
        term_stop_words: Sequence[str]) -> tuple[pa.Array, pa.Array]:
    """Lists of the distinct keywords and of the words of lower-cased texts without NULL."""
    n = len(texts)
    strings = texts.to_pylist()
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(n), np.fromiter(map(len, strings), np.int64, n))
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    sizes = 1 + (points > 0x7F).view(np.int8) + (points > 0x7FF).view(np.int8) + (points > 0xFFFF).view(np.int8)
    words = _lists(*_without(*_runs(of, word[points], sizes, 2, data), term_stop_words), n)
    rows, found = _without(*_runs(of, KEYWORD_BYTES[np.minimum(points, 255)], sizes, 3, data), stop_words)
    coded = found.dictionary_encode()
    width = len(coded.dictionary) + 1
    pairs = np.sort(rows * width + coded.indices.to_numpy())
    rows, codes = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], width)
    return _lists(rows, coded.dictionary.take(pa.array(codes)), n), words


def worded(batches: Iterator[pa.RecordBatch], bits: bytes, stop_words: Sequence[str],
           term_stop_words: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches with ``kw`` and ``words`` in place of ``low``, in parts of bounded size."""
    word = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
    for batch in batches:
        held = np.cumsum(pc.binary_length(batch.column("low")).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = held[begin - 1] if begin else 0
            end = max(int(np.searchsorted(held, done + BYTES_PER_CUT, side="right")), begin + 1)
            part = batch.slice(begin, end - begin)
            kw, words = cut(part.column("low"), word, stop_words, term_stop_words)
            yield pa.RecordBatch.from_pydict(
                {c: part.column(c) for c in part.schema.names if c != "low"} | {"kw": kw, "words": words})
            begin = end
