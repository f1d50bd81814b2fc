"""Runs of words that repeat with a period, found by block convolution.

A run is a stretch of words with smallest period q (words q apart are equal) whose length is
at least ``copies`` periods and ``least`` words, and which no neighbouring word extends. At scale
B = 8, 16, 32, .. every text is cut into blocks of B words, and the number theoretic transform
gives the sum of squared differences between a block and the words d further on, for all distances d
from B to 2B - 1 (1 to 15 at the first scale) at once. A sum of zero is an occurrence of the block;
its distance is the seed of an extension to both sides. A run with period d holds
a whole block of its scale and that block's next occurrence: at least 3d words hold B <= d words from a
block's edge on and d more behind them (24 words do for d < 8). So no run is missed.

Sums are taken modulo a prime: a sum of zero stays zero, and what is zero by chance is dismissed by the
extension, which compares words. Blocks with a word that does not recur within 2B - 1 words can have no
occurrence there and are left out before the transform; in prose few are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.common import packed, slices

PRIME, ROOT = 3 * 2 ** 30 + 1, 5  # a product of two residues fits into 64 bits
FIRST = 8
CELLS = 1 << 20  # numbers in one transform of many blocks, at most, if a block has no more by itself
RUNS = "array<struct<start:long,length:long,period:long>>"

Words = Callable[[object, list[bytes]], list[bytes]]
Run = tuple[int, int, int]


@lru_cache(maxsize=32)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first ``size / 2`` powers of a root of unity of order ``size``."""
    step = pow(ROOT, (PRIME - 1) // size, PRIME)
    step = pow(step, PRIME - 2, PRIME) if inverse else step
    out = np.ones(size // 2, np.uint64)
    n = 1
    while n < len(out):
        out[n:2 * n] = out[:n] * np.uint64(pow(step, n, PRIME)) % np.uint64(PRIME)
        n *= 2
    return out


def forward(x: np.ndarray) -> np.ndarray:
    """Transform of each row, in bit-reversed order; the length is a power of two."""
    p = np.uint64(PRIME)
    rows, size = x.shape
    x, half = x.copy(), size // 2
    while half:
        pair = x.reshape(rows, -1, 2, half)
        u, v = pair[:, :, 0], pair[:, :, 1]
        apart = (u + p - v) % p * _powers(2 * half, False) % p
        pair[:, :, 0] = (u + v) % p
        pair[:, :, 1] = apart
        half //= 2
    return x


def backward(x: np.ndarray) -> np.ndarray:
    """Inverse of ``forward``."""
    p = np.uint64(PRIME)
    rows, size = x.shape
    x, half = x.copy(), 1
    while half < size:
        pair = x.reshape(rows, -1, 2, half)
        u, v = pair[:, :, 0], pair[:, :, 1] * _powers(2 * half, True) % p
        pair[:, :, 0], pair[:, :, 1] = (u + v) % p, (u + p - v) % p
        half *= 2
    return x * np.uint64(pow(size, PRIME - 2, PRIME)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray, offsets: int) -> np.ndarray:
    """Sum over i of (block[i] - window[o + i])^2 modulo the prime, for o below ``offsets``.

    ``windows`` are as long as the transform, and hold at least ``offsets - 1`` words more than a block.
    """
    p, width = np.uint64(PRIME), blocks.shape[1]
    size = windows.shape[1]
    turned = np.zeros_like(windows)
    turned[:, 0], turned[:, size - width + 1:] = blocks[:, 0], blocks[:, :0:-1]
    cross = backward(forward(turned) * forward(windows) % p)[:, :offsets]
    total = np.cumsum(np.pad(windows * windows % p, ((0, 0), (1, 0))), axis=1, dtype=np.uint64)
    own = (blocks * blocks % p).sum(axis=1)[:, None] % p
    other = (total[:, width:width + offsets] - total[:, :offsets]) % p
    return (own + other + (p - cross) * np.uint64(2)) % p


def _next(codes: np.ndarray) -> np.ndarray:
    """Distance to the next place of the same code; a large number if there is none."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    out = np.full(len(codes), np.iinfo(np.int64).max)
    same = ranked[1:] == ranked[:-1]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def seeds(codes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per scale, starts of blocks and distances of their occurrences; ``longest`` text in ``codes``."""
    far = _next(codes)
    end, width = len(codes), FIRST
    held = codes.astype(np.uint64)
    while True:
        first = 1 if width == FIRST else width
        if 3 * width > longest:
            return
        count = end // width
        # The farthest next place of any word of the block.
        reach = far[:count * width].reshape(count, -1).max(axis=1)
        starts = np.flatnonzero(reach < 2 * width) * width
        offsets = 2 * width - first
        size = 4 * width if width == FIRST else 2 * width
        step = max(1, CELLS // size)
        for a in range(0, len(starts), step):
            at = starts[a:a + step]
            # Past the end there is a code that nothing has.
            window = at[:, None] + first + np.arange(size)
            windows = np.where(window < end, held[np.minimum(window, end - 1)], np.uint64(PRIME - 1))
            zero = squared_differences(held[at[:, None] + np.arange(width)], windows, offsets) == 0
            row, offset = np.nonzero(zero)
            distance = offset + first
            fits = at[row] + distance + width <= end
            yield at[row[fits]], distance[fits]
        width *= 2


def _matching(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning, in growing steps."""
    done, step, n = 0, 64, len(x)
    while done < n:
        differ = x[done:done + step] != y[done:done + step]
        if differ.any():
            return done + int(differ.argmax())
        done += step
        step *= 2
    return n


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return out + [n] * (n > 1)


def runs(codes: np.ndarray, longest: int, least: int, copies: int) -> list[Run]:
    """All runs ``(start, length, period)`` of ``codes`` by start, then period.

    A run of period q shows at multiples d of q as well. A seed whose d words lie in a run found before
    is dropped at once: its stretch repeats these d words, and so has period q itself.
    """
    found: dict[Run, int] = {}
    cover = np.full(len(codes), -1)  # a run over this place
    backwards = codes[::-1]
    n = len(codes)
    for starts, distances in seeds(codes, longest):
        if found:
            over = cover[starts]
            start, length, period = np.array(list(found))[over].T
            known = (over >= 0) & (distances % period == 0) & (starts + distances <= start + length)
            starts, distances = starts[~known], distances[~known]
        order = np.lexsort((starts, distances))
        last, until = 0, 0
        for b, d in zip(starts[order].tolist(), distances[order].tolist()):
            if d == last and b < until:  # in the stretch that was just extended
                continue
            right = b + d + _matching(codes[b:n - d], codes[b + d:])
            left = b - _matching(backwards[n - b:], backwards[n - b - d:n - d])
            last, until = d, right - d
            length = right - left
            if length < max(least, copies * d) or any(
                    np.array_equal(codes[left:left + d], codes[left + d // r:left + d + d // r]) for r in _primes(d)):
                continue
            cover[left:right] = found.setdefault((left, length, d), len(found))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(n: int, found: list[Run]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", words: Words | None = None, least: int = 24,
                  copies: int = 3) -> DataFrame:
    """``docs`` with ``runs`` (all runs by start, then period; words numbered from 0) and ``collapsed`` added.

    Words of ``text`` are separated by ASCII blanks; ``words(key, words)`` may change them first. ``collapsed`` has
    the words that no run holds behind its first period, joined by one space. Null, empty and blank texts have no
    runs and an empty ``collapsed``. Each row is judged by itself, repeated rows and rows without an id
    too; existing columns ``runs`` and ``collapsed`` go; an empty table gives no rows. Narrow: nothing is
    shuffled, and a task holds some megabytes of text, or one row if that is larger.
    """
    if least < 3 * FIRST or copies < 3:
        raise ValueError(f"runs have {3 * FIRST} words and 3 copies at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1_000_000):
            get = lambda c: part.column(part.schema.get_field_index(c))
            each = [(t or "").encode().split() for t in get("_text").to_pylist()]
            if words:
                each = [words(k, w) if w else w for k, w in zip(get("_key").to_pylist(), each)]
            found = _batch_runs(each, least, copies)
            text = [b" ".join(w if not r else [w[i] for i in np.flatnonzero(_collapsed(len(w), r))]).decode()
                    for w, r in zip(each, found)]
            flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([get("_row"), lists, pa.array(text, pa.string())], ["_row", "runs", "collapsed"])

    data = docs.select(packed(docs, "runs", "collapsed"), docs[key].alias("_key"), docs["text"].alias("_text"))
    schema = data.select("_row").schema
    kinds = docs.sparkSession.createDataFrame([], f"runs {RUNS}, collapsed string").schema
    for field in kinds:
        schema = schema.add(field)
    return data.mapInArrow(run, schema).select("_row.*", "runs", "collapsed")


def _batch_runs(each: list[list[bytes]], least: int, copies: int) -> list[list[Run]]:
    """Runs of each text; all texts are one sequence, each closed by a code of its own, which no run holds."""
    sizes = np.array([len(w) for w in each], np.int64)
    if not sizes.sum():
        return [[] for _ in each]
    flat = np.empty(sizes.sum(), object)
    flat[:] = [x for w in each for x in w]
    code, names = pd.factorize(flat)
    ends = np.cumsum(sizes + 1) - 1
    codes = np.empty(len(code) + len(each), np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = code
    codes[ends] = len(names) + np.arange(len(each))
    out: list[list[Run]] = [[] for _ in each]
    begins = ends - sizes
    for start, length, period in runs(codes, int(sizes.max()), least, copies):
        k = int(np.searchsorted(ends, start))
        out[k].append((start - int(begins[k]), length, period))
    return out
