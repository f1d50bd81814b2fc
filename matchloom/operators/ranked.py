"""Terms of a document by rank, and the cosine of two documents over their first terms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from matchloom.operators.scoring import K2
from matchloom.operators.sides import TERM

CODE_BITS = 40


def list_items(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Row number of every element, and the elements, of a list column."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], column.type)
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(array)), lengths), array.flatten()


def ranked_cosine(codes1, tf1, codes2, tf2, max_terms: int) -> float:
    """Cosine over the first terms by (summed count descending, code).

    Codes are sorted and unique on either side, and equal for equal terms.
    """
    if not len(codes1) or not len(codes2):
        return 0.0
    at = np.minimum(np.searchsorted(codes2, codes1), len(codes2) - 1)
    shared = codes2[at] == codes1
    partner = np.zeros(len(codes2), np.int64)
    partner[at[shared]] = tf1[shared]
    alone = tf1[~shared]
    order = np.concatenate([
        codes2 - ((tf2 + partner) << CODE_BITS), codes1[~shared] - (alone << CODE_BITS)])
    kept = np.ones(len(order), bool)
    if len(order) > max_terms:
        kept = order <= np.partition(order, max_terms - 1)[max_terms - 1]
    both = kept[: len(codes2)] & (partner > 0)
    only2 = tf2[kept[: len(codes2)] & (partner == 0)]
    only1 = alone[kept[len(codes2):]]
    a, b = partner[both].astype(float), tf2[both].astype(float)
    norm1 = a @ a + K2 * float(only1 @ only1)
    norm2 = b @ b + K2 * float(only2 @ only2)
    return float(a @ b / math.sqrt(norm1 * norm2)) if norm1 > 0 and norm2 > 0 else 0.0


class TermRows:
    """Terms of some documents, scored against one other document at a time.

    Gives what :func:`ranked_cosine` gives for each pair, without ranking the terms of a pair: those above the count at
    which the limit cuts are all in, and of those at that count the first by code.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(codes) for codes, _ in vectors], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tf = np.concatenate([tf for _, tf in vectors])
        self.terms, self.place = np.unique(np.concatenate([codes for codes, _ in vectors]), return_inverse=True)

    def cosines(self, rows: np.ndarray, codes2: np.ndarray, tf2: np.ndarray, max_terms: int) -> np.ndarray:
        """Scores of these rows with a document; its codes are sorted and unique."""
        n, sizes = len(rows), self.sizes[rows]
        starts = np.cumsum(sizes) - sizes
        if not len(codes2) or not sizes.any():
            return np.zeros(n)
        of = np.repeat(np.arange(n), sizes)  # the row of each of its terms
        entries = np.arange(len(of)) + (self.starts[rows] - starts)[of]
        terms, place = self.terms, self.place[entries]
        if len(place) < len(terms):
            terms, place = terms[place], np.arange(len(place))
        near = np.minimum(np.searchsorted(codes2, terms), len(codes2) - 1)
        a, b = self.tf[entries], np.where(codes2[near] == terms, tf2[near], 0)[place]
        both, ranked = a + b, np.sort(tf2)

        def count(flags: np.ndarray) -> np.ndarray:
            return np.bincount(of[flags], minlength=n)

        def total(values: np.ndarray, flags: np.ndarray) -> np.ndarray:
            return np.bincount(of[flags], values[flags], n)

        def at_least(least: np.ndarray) -> np.ndarray:
            """How many terms of each pair have so high a summed count."""
            return (len(ranked) - np.searchsorted(ranked, least) + count(both >= least[of]) - count(b >= least[of]))

        # The count of each pair at which the limit cuts: the highest that more terms reach than may be used.
        low = np.full(n, ranked[-max_terms - 1] if len(ranked) > max_terms else 0)
        high = np.full(n, max(int(both.max()), int(ranked[-1])) + 1)
        middle = low + 1
        while True:
            more = at_least(middle) > max_terms
            low, high = np.where(more, middle, low), np.where(more, high, middle)
            if (high - low <= 1).all():
                break
            middle = (low + high) // 2
        level, room = low[of], max_terms - at_least(low + 1)
        cut = both == level
        before = np.zeros(len(of), np.int64)  # terms of the other document at that count, up to the code
        for value in np.unique(low):
            own = level == value
            before[own] = np.searchsorted(codes2[tf2 == value], terms)[place[own]]
        moved = cut.astype(np.int64) - (b == level)  # shared terms are counted at their sum
        running = np.cumsum(moved) - moved
        kept = (both > level) | (cut & (before + running - running[starts[of]] < room[of]))
        shared = kept & (b > 0)
        squares = np.append(0, np.cumsum(ranked.astype(float) ** 2))
        only2 = (squares[-1] - squares[np.searchsorted(ranked, low, side="right")] - total(b * b, b > level)
                 + (room - count(cut & kept)) * low.astype(float) ** 2)
        norm1 = total(a * a, shared) + K2 * total(a * a, kept & (b == 0))
        norm2 = total(b * b, shared) + K2 * only2
        norms = norm1 * norm2
        return np.divide(total(a * b, shared), np.sqrt(norms), out=np.zeros(n), where=norms > 0)


def term_vectors(*tables: pa.Table) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Codes in term order and counts of each document of each table; equal terms have equal codes."""
    found = []
    for table in tables:
        rows, items = list_items(table["entries"])
        terms = items.field("kind").to_numpy(zero_copy_only=False) == TERM
        found.append((rows[terms], items.field("term").filter(pa.array(terms)),
                      items.field("tf").to_numpy(zero_copy_only=False)[terms].astype(np.int64)))
    encoded = pa.concat_arrays([terms for _, terms, _ in found]).dictionary_encode()
    place = np.empty(len(encoded.dictionary), np.int64)
    place[pc.sort_indices(encoded.dictionary).to_numpy()] = np.arange(len(place))
    codes, out, at = place[encoded.indices.to_numpy()], [], 0
    for table, (rows, _, tf) in zip(tables, found):
        own, at = codes[at:at + len(rows)], at + len(rows)
        order = np.lexsort((own, rows))
        ends = np.cumsum(np.bincount(rows, minlength=table.num_rows))[:-1]
        out.append(list(zip(np.split(own[order], ends), np.split(tf[order], ends))))
    return out
