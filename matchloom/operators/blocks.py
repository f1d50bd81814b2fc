"""All pairs scored in bounded blocks, for runs where every pair is in play.

When a pair without a common term may still qualify (a low threshold, or the best
N per resume), no index can skip it. Both sides are then hashed into groups of a
size that is set from the counts of rows and of their entries, and each (resume group, job group) cell is
one small task: neither a hot term nor a hot document changes its size. A cell
keeps its scores in arrays and returns only the pairs that can be in the result,
so what is shuffled on is the result, not the pairs. Pairs over the limit on terms are
scored inside the cell too, best bound first, until the rest can't matter.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import MatchConfig
from matchloom.operators.ranked import TermRows, list_items, term_vectors
from matchloom.operators.scoring import K2, SLACK, SUMS
from matchloom.operators.shared import cell_partitions
from matchloom.operators.sides import KEYWORD, TERM

RESUMES_PER_CELL = 512
JOBS_PER_CELL = 2048
ENTRIES_PER_GROUP = 1 << 21  # terms, keywords and vector entries of the rows of a group, about
STEP = 1 << 18  # joined entries held at a time inside a cell
SCHEMA = "r string, j string, " + ", ".join(f"{c} long" for c in SUMS) + ", capped double"


def _numbers(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each value stands in ``among``; -1 for those that are not there."""
    return pc.index_in(values, value_set=among).fill_null(-1).to_numpy().astype(np.int64)


class Encoded:
    """Entries ``(row, term, tf)`` of some documents with a number for each term."""

    def __init__(self, rows: np.ndarray, terms: pa.Array, tf: np.ndarray):
        encoded = terms.dictionary_encode(null_encoding="encode")
        self.rows, self.tf = rows, tf
        self.codes, self.dictionary = encoded.indices.to_numpy(), encoded.dictionary

    @property
    def terms(self) -> list[str | None]:
        return self.dictionary.to_pylist()

    def codes_in(self, left: Encoded) -> np.ndarray:
        """The number that ``left`` has for the term of each entry; -1 for terms it lacks."""
        return _numbers(self.dictionary, left.dictionary)[self.codes]

    @cached_property
    def split(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of the terms; the number of the first word of each term, and of the second or -1."""
        words = pc.split_pattern(self.dictionary, " ", max_splits=1)
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        encoded, starts = words.flatten().dictionary_encode(), np.cumsum(lengths) - lengths
        codes = encoded.indices.to_numpy()
        first, second = np.full(len(lengths), -2, np.int64), np.full(len(lengths), -1, np.int64)
        first[lengths > 0] = codes[starts[lengths > 0]]
        second[lengths > 1] = codes[starts[lengths > 1] + 1]
        return encoded.dictionary, first, second

    @cached_property
    def by_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the terms made of the numbers of their words, ascending, and the terms in that order."""
        words, first, second = self.split
        keys = first * (len(words) + 1) + second + 1
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    @cached_property
    def by_term(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries in the order of their terms; where each term starts there, and how many it has."""
        counts = np.bincount(self.codes, minlength=len(self.terms))
        return np.argsort(self.codes, kind="stable"), np.cumsum(counts) - counts, counts


class WordTerms:
    """Terms of documents that come as words: every word and every two neighbours, counted per document."""

    def __init__(self, rows: np.ndarray, words: pa.Array):
        encoded = words.dictionary_encode()
        self.words, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        n = len(self.words) + 1
        near = rows[:-1] == rows[1:]
        singles = (rows * n + codes) * n
        doubles = (rows[:-1][near] * n + codes[:-1][near]) * n + codes[1:][near] + 1
        keys, tf = np.unique(np.concatenate([singles, doubles]), return_counts=True)
        rest, second = np.divmod(keys, n)
        self.rows, self.first = np.divmod(rest, n)
        self.second, self.tf = second - 1, tf.astype(float)

    def codes_in(self, left: Encoded) -> np.ndarray:
        vocabulary = left.split[0]
        keys, order = left.by_words
        place = np.append(_numbers(self.words, vocabulary), -1)  # the last for terms of one word
        a, b = place[self.first], place[self.second]
        found = np.flatnonzero((a >= 0) & ((b >= 0) | (self.second < 0)))
        out = np.full(len(self.rows), -1, np.int64)
        if len(found) and len(keys):
            key = a[found] * (len(vocabulary) + 1) + b[found] + 1
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[found] = np.where(keys[at] == key, order[at], -1)
        return out

    def vectors(self, left: Encoded, mine: np.ndarray, theirs: np.ndarray):
        """As :func:`term_vectors`, of these rows of either side. A blank sorts before all letters of words."""
        words = pc.unique(pa.concat_arrays([left.split[0], self.words]))
        rank = np.empty(len(words) + 1, np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        rank[-1] = -1

        def chosen(rows, wanted, tf, vocabulary, first, second):
            at = np.flatnonzero(np.isin(rows, wanted))
            place = np.append(rank[_numbers(vocabulary, words)], -1)
            return np.searchsorted(wanted, rows[at]), place[first[at]] * len(rank) + place[second[at]] + 1, tf[at]

        _, first, second = left.split
        sides = [(len(mine), *chosen(left.rows, mine, left.tf, left.split[0], first[left.codes], second[left.codes])),
                 (len(theirs), *chosen(self.rows, theirs, self.tf, self.words, self.first, self.second))]
        _, codes = np.unique(np.concatenate([keys for _, _, keys, _ in sides]), return_inverse=True)
        out, at = [], 0
        for n, rows, keys, tf in sides:
            own, at = codes[at:at + len(keys)], at + len(keys)
            order = np.lexsort((own, rows))
            ends = np.cumsum(np.bincount(rows, minlength=n))[:-1]
            out.append(list(zip(np.split(own[order], ends), np.split(tf[order].astype(np.int64), ends))))
        return out


class Side:
    """Documents in the form a cell scores them; what is made of them is made once."""

    def __init__(self, table: pa.Table):
        self.table = table
        self._unit: dict[int, np.ndarray] = {}

    @cached_property
    def keywords(self) -> Encoded:
        return Encoded(*_entries(self.table, KEYWORD))

    @cached_property
    def terms(self) -> Encoded:
        return Encoded(*_entries(self.table, TERM))

    @cached_property
    def skills(self) -> Encoded:
        rows, items = list_items(self.table["skills"])
        return Encoded(rows, items, np.ones(len(rows)))

    @cached_property
    def widths(self) -> np.ndarray:
        return np.bincount(list_items(self.table["vec"])[0], minlength=self.table.num_rows)

    def unit_vectors(self, width: int) -> np.ndarray:
        if width not in self._unit:
            self._unit[width] = _unit_vectors(self.table, width)
        return self._unit[width]

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy().astype(float)


class WordSide(Side):
    """Documents with their keywords and words in place of entries; terms are counted here."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        sizes = {
            "n_kw": pa.array(np.bincount(self.keywords.rows, minlength=table.num_rows), pa.int32()),
            "n_terms": pa.array(np.bincount(self.terms.rows, minlength=table.num_rows), pa.int32()),
            "mass": pa.array(np.bincount(self.terms.rows, self.terms.tf ** 2, table.num_rows).astype(np.int64))}
        for name, values in sizes.items():
            self.table = self.table.append_column(name, values)

    @cached_property
    def keywords(self) -> Encoded:
        rows, items = list_items(self.table["kw"])
        return Encoded(rows, items, np.ones(len(rows)))

    @cached_property
    def terms(self) -> WordTerms:
        return WordTerms(*list_items(self.table["words"]))


def _shared(left: Encoded, right: Encoded | WordTerms, shape) -> np.ndarray:
    """Sums over equal terms, as matrices: the count, the products and the squares of either side."""
    order, starts, counts = left.by_term
    out = np.zeros((4, shape[0] * shape[1]))
    code2 = right.codes_in(left)
    hit = code2 >= 0
    rows2, code2, tf2 = right.rows[hit], code2[hit], right.tf[hit]
    n = counts[code2]
    ends = np.cumsum(n)
    begin = 0
    while begin < len(n):
        done = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, done + STEP, side="right")), begin + 1)
        reps = n[begin:end]
        first = np.repeat(starts[code2[begin:end]] - (ends[begin:end] - reps - done), reps)
        at = order[first + np.arange(reps.sum())]
        a, b = left.tf[at], np.repeat(tf2[begin:end], reps)
        pair = left.rows[at] * shape[1] + np.repeat(rows2[begin:end], reps)
        for k, value in enumerate((None, a * b, a * a, b * b)):
            out[k] += np.bincount(pair, weights=value, minlength=out.shape[1])
        begin = end
    return out.reshape(4, *shape)


def _entries(table: pa.Table, kind: int):
    rows, items = list_items(table["entries"])
    keep = items.field("kind").to_numpy(zero_copy_only=False) == kind
    tf = items.field("tf").to_numpy(zero_copy_only=False)[keep].astype(float)
    return rows[keep], items.field("term").filter(pa.array(keep)), tf


def _unit_vectors(table: pa.Table, width: int) -> np.ndarray:
    """One row per document, zeros where it has no vector."""
    rows, items = list_items(table["vec"])
    out = np.zeros((table.num_rows, width))
    if not len(rows):
        return out
    position = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out[rows, position] = items.to_numpy(zero_copy_only=False)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _top_mass(terms: Encoded | WordTerms, rows: int, n: int) -> np.ndarray:
    """Sum of the ``n`` largest squared counts of each document."""
    order = np.lexsort((-terms.tf, terms.rows))
    of, tf = terms.rows[order], terms.tf[order]
    counts = np.bincount(of, minlength=rows)
    first = np.arange(len(of)) - (np.cumsum(counts) - counts)[of] < n
    return np.bincount(of[first], tf[first] ** 2, rows)


def pair_scorer(config: MatchConfig, threshold: float, top_n: int | None):
    """Function of two sides: row numbers, sums and capped scores of the pairs that may be in the result.

    The right side is in key order. ``best``, if given, has the ``top_n`` highest totals of each left row that
    earlier calls are sure of, in hundredths rounded down; pairs below them are left out, and it is brought up to date.
    """
    w = {p: config.weight(p) for p in ("keyword", "tfidf", "semantic", "skills")}
    cap, semantic = config.max_terms, config.semantic

    def score(left: Side, right: Side, best: np.ndarray | None = None):
        shape = (left.table.num_rows, right.table.num_rows)
        kw = _shared(left.keywords, right.keywords, shape)[0]
        shared, dot, s1, s2 = _shared(left.terms, right.terms, shape)
        met = _shared(left.skills, right.skills, shape)[0]

        def divide(a, b):
            return np.divide(a, b, out=np.zeros(shape), where=b > 0)

        n_kw1, n_kw2 = left.column("n_kw")[:, None], right.column("n_kw")[None, :]
        m1 = np.where(n_kw2 > 0, divide(kw, n_kw1 + n_kw2 - kw), 0.0)
        mass1, mass2 = left.column("mass")[:, None], right.column("mass")[None, :]
        norms = (K2 * mass1 - (K2 - 1) * s1) * (K2 * mass2 - (K2 - 1) * s2)
        m2_low = m2_high = divide(dot, np.sqrt(np.maximum(norms, 0)))
        over = np.zeros(shape, bool)
        if cap is not None:
            terms = left.column("n_terms")[:, None] + right.column("n_terms")[None, :]
            over = terms - shared > cap
            most = np.maximum(s1, s2)
            bound = np.sqrt(divide(most, K2 * np.maximum(cap - shared, 0) + most))
            if over.any():
                # All kept terms but those of the left document are of the right one alone, its most frequent first.
                least = max(cap - int(left.column("n_terms").max()), 0)
                alone = np.maximum(_top_mass(right.terms, shape[1], least)[None, :] - s2, least)
                bound = np.minimum(bound, np.sqrt(divide(s2, K2 * alone + s2)))
            m2_low, m2_high = np.where(over, 0.0, m2_low), np.where(over, bound, m2_high)
        lengths = np.bincount(right.skills.rows, minlength=shape[1])
        required = np.broadcast_to(lengths.astype(float)[None, :], shape)
        m4 = np.where(required > 0, divide(met, required), 1.0)
        m3 = 0.0
        if semantic:  # vectors of different lengths have cosine 0, as missing ones do
            width = int(max(left.widths.max(), right.widths.max(), 1))
            m3 = np.where(left.widths[:, None] == right.widths[None, :],
                          left.unit_vectors(width) @ right.unit_vectors(width).T, 0.0)
        rest = w["keyword"] * m1 + w["semantic"] * m3 + w["skills"] * m4
        low = np.minimum((rest + w["tfidf"] * m2_low) * 100, 100)
        high = np.minimum((rest + w["tfidf"] * m2_high) * 100, 100)
        capped = _settle(left, right, over, low, high, rest, w["tfidf"], cap, threshold, top_n, best)
        keep = high >= threshold - SLACK
        if best is not None:
            keep &= np.ceil(np.where(keep, high, 0.0) * 100) >= best.min(axis=1)[:, None]
        if top_n is not None and shape[1] > top_n:
            keep &= _may_be_top(low, high, keep, top_n)
        if best is not None:
            sure = np.where(keep & (low >= threshold + SLACK), low, -np.inf)
            every = np.concatenate([best, np.floor(sure * 100)], axis=1)
            best[:] = _highest(every, top_n)
        r, j = np.nonzero(keep)
        sums = {c: np.rint(m[r, j]).astype(np.int64) for c, m in zip(SUMS, (kw, shared, dot, s1, s2))}
        return r, j, sums, capped[r, j]

    return score


def cell_scorer(config: MatchConfig, threshold: float, top_n: int | None):
    """Function of one cell: the sums of the pairs that may be in the result."""
    pairs = pair_scorer(config, threshold, top_n)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if 0 in (left.num_rows, right.num_rows):
            return pa.table({"r": pa.array([], pa.string()), "j": pa.array([], pa.string()),
                             **{c: pa.array([], pa.int64()) for c in SUMS}, "capped": pa.array([], pa.float64())})
        right = right.sort_by("key")
        r, j, sums, capped = pairs(Side(left), Side(right))
        return pa.table({
            "r": left["key"].combine_chunks().take(pa.array(r)),
            "j": right["key"].combine_chunks().take(pa.array(j)),
            **{c: pa.array(m) for c, m in sums.items()},
            "capped": pa.array(capped, mask=np.isnan(capped)),
        })

    return score


def _term_vectors(left: Side, right: Side, mine: np.ndarray, theirs: np.ndarray):
    if isinstance(right.terms, WordTerms):
        return right.terms.vectors(left.terms, mine, theirs)
    return term_vectors(left.table.take(pa.array(mine)), right.table.take(pa.array(theirs)))


def _settle(left: Side, right: Side, over, low, high, rest, weight, cap, threshold, n, before=None) -> np.ndarray:
    """Exact scores of the pairs over the limit on terms, best bound first; NaN for all others.

    ``low`` and ``high`` become the exact total, or minus infinity for pairs that can't be in the result: once
    ``n`` pairs of a resume are known to be better than a bound, none of the pairs that follow is computed.
    """
    capped = np.full(over.shape, np.nan)
    open_pairs = over & (high >= threshold - SLACK)
    low[over & ~open_pairs] = high[over & ~open_pairs] = -np.inf
    if not open_pairs.any():
        return capped
    rows, columns = (np.flatnonzero(open_pairs.any(axis=a)) for a in (1, 0))
    of_rows, of_columns = _term_vectors(left, right, rows, columns)
    terms, open_pairs = TermRows(of_rows), open_pairs[rows]
    if n is not None:  # the n best totals so far, in hundredths rounded down, those of ``before`` among them
        sure = np.where(~over[rows] & (low[rows] >= threshold - SLACK), low[rows], -np.inf)
        every = [np.full((len(rows), n), -np.inf) if before is None else before[rows], np.floor(sure * 100)]
        best = _highest(np.concatenate(every, axis=1), n)
    bounds = np.where(open_pairs, high[rows], -np.inf)[:, columns].max(axis=0)
    for k in np.argsort(-bounds, kind="stable").tolist():
        j = columns[k]
        at = np.flatnonzero(open_pairs[:, j])
        if n is not None:
            reach = np.ceil(high[rows[at], j] * 100) >= best[at].min(axis=1)
            low[rows[at[~reach]], j] = high[rows[at[~reach]], j] = -np.inf
            at = at[reach]
            if not len(at):
                continue
        r = rows[at]
        capped[r, j] = terms.cosines(at, *of_columns[k], cap)
        total = np.minimum((rest[r, j] + weight * capped[r, j]) * 100, 100.0)
        low[r, j] = high[r, j] = total
        if n is not None:
            sure = np.where(total >= threshold - SLACK, np.floor(total * 100), -np.inf)
            best[at] = _highest(np.concatenate([best[at], sure[:, None]], axis=1), n)
    return capped


def _highest(values: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` highest values of each row, in no set order."""
    return np.partition(values, values.shape[1] - n, axis=1)[:, -n:]


def _may_be_top(low, high, keep, n):
    """Pairs that can be among the first ``n`` of their row by (rounded score, key).

    Columns are in key order. Scores so near a rounding boundary that the last bit
    decides are kept if they could be in.
    """
    cents = np.where(keep, low * 100, -1e9)
    unsure = np.abs(np.abs(cents - np.floor(cents)) - 0.5) < 1e-6
    rounded = np.where(unsure, np.floor(cents), np.rint(cents))
    order = np.argsort(-rounded, axis=1, kind="stable")[:, :n]
    best = np.zeros(low.shape, bool)
    np.put_along_axis(best, order, True, axis=1)
    nth = np.take_along_axis(rounded, order[:, -1:], axis=1)
    return best | (unsure & keep & (np.ceil(np.where(keep, high, 0.0) * 100) >= nth))


def block_sums(resumes: DataFrame, jobs: DataFrame, config: MatchConfig, threshold: float,
               top_n: int | None = None) -> DataFrame:
    """Sums of the pairs that can reach ``threshold`` (and the top ``n`` per resume).

    ``capped`` is the exact term score of pairs over the limit on terms, and null for others.
    """
    spark = resumes.sparkSession
    (n_resumes, held1), (n_jobs, held2) = (side.agg(F.count("*"), F.coalesce(F.sum(
        F.size("entries") + F.size(F.coalesce("vec", F.array()))), F.lit(0))).first() for side in (resumes, jobs))
    r_groups = max(1, math.ceil(n_resumes / RESUMES_PER_CELL), math.ceil(held1 / ENTRIES_PER_GROUP))
    # Enough cells to keep every core busy, but none above the size limit.
    wanted = math.ceil(3 * spark.sparkContext.defaultParallelism / r_groups)
    j_groups = max(1, math.ceil(n_jobs / JOBS_PER_CELL), math.ceil(held2 / ENTRIES_PER_GROUP),
                   min(wanted, math.ceil(n_jobs / 64)))

    def group(n: int):
        return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")

    def spread(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    columns = ["key", "entries", "skills", "vec", "n_kw", "n_terms", "mass"]
    left = resumes.select(*columns, group(r_groups).alias("rg"), spread(j_groups).alias("jg"))
    right = jobs.select(*columns, group(j_groups).alias("jg"), spread(r_groups).alias("rg"))
    partitions = cell_partitions(spark, r_groups * j_groups)
    left, right = (d.repartition(partitions, "rg", "jg") for d in (left, right))
    score = cell_scorer(config, threshold, top_n)
    return left.groupBy("rg", "jg").cogroup(right.groupBy("rg", "jg")).applyInArrow(score, SCHEMA)
