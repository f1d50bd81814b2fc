"""Pairs of few resumes with any number of jobs, scored where the jobs are read.

A resume side whose measured size is within the limits of the configuration becomes an
inverted index, its terms with the rows that have them, which is sent to every task. A
task reads its jobs as words, slice by slice of bounded size, counts their terms and scores
them term by term against the index, so the jobs are not shuffled, not stored, and not
copied per group of resumes. For the best N a
task remembers the N best totals of each resume, and what cannot reach them is not sent
on. A larger resume side takes the routes through the terms or through blocks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from matchloom.config import MatchConfig
from matchloom.operators import blocks
from matchloom.operators.cut import letters, worded
from matchloom.operators.scoring import SUMS

SCORED = ["key", "entries", "skills", "vec", "n_kw", "n_terms", "mass"]
READ = ["key", "kw", "words", "skills", "vec", "listed"]  # of jobs; their terms are counted where they are scored
TEXTS = ["key", "low", "skills", "vec", "listed"]  # of jobs whose texts are cut there too
KEPT = ["n_kw", "n_terms", "mass", "skills", "vec", "listed"]  # columns that go on with a pair
# What a task holds at a time: jobs, their keywords and words, and pairs on their way out.
JOBS_PER_SLICE = 512
WORDS_PER_SLICE = 1 << 18
PAIRS_PER_BATCH = 1 << 13


def fits_index(resumes: DataFrame, config: MatchConfig) -> bool:
    """Whether a stored resume side is small enough to be sent to every task."""
    if config.index_rows <= 0:
        return False
    rows, entries = resumes.agg(F.count("*"), F.coalesce(F.sum(sum(
        F.size(F.coalesce(c, F.array())) for c in ("entries", "skills", "listed", "vec"))), F.lit(0))).first()
    return rows <= config.index_rows and entries <= config.index_entries


def _slices(table: pa.Table) -> Iterator[pa.Table]:
    """Parts of a table with a bounded number of rows and of words; at least one row each."""
    sizes = sum(table[c].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("kw", "words"))
    begin = 0
    while begin < table.num_rows:
        held = np.cumsum(sizes[begin:begin + JOBS_PER_SLICE])
        n = max(int(np.searchsorted(held, WORDS_PER_SLICE, side="right")), 1)
        yield table.slice(begin, n)
        begin += n


def _schema(resumes: DataFrame, jobs: DataFrame) -> StructType:
    return StructType([
        StructField("r", StringType()), StructField("j", StringType()),
        *[StructField(c, LongType()) for c in SUMS], StructField("capped", DoubleType()),
        *[StructField(f"{c}{n}", side.schema[c].dataType) for n, side in ((1, resumes), (2, jobs)) for c in KEPT]])


def index_sums(resumes: DataFrame, jobs: DataFrame, config: MatchConfig, threshold: float,
               top_n: int | None = None) -> DataFrame:
    """Sums of the pairs that can reach ``threshold`` (and the top ``n`` per resume), with both sides' columns.

    ``resumes`` is a stored side for which :func:`fits_index` holds; rows without a key are in no pair. ``jobs`` still
    has its lower-cased text, which the tasks cut, or its words. ``capped`` is the exact term score of pairs over the limit on terms, and null for others.
    """
    columns = list(dict.fromkeys([*SCORED, *KEPT]))
    table = resumes.select(*columns).where(F.col("key").isNotNull()).toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    cuts = "low" in jobs.columns
    sent = resumes.sparkSession.sparkContext.broadcast((sink.getvalue(), letters(jobs.sparkSession) if cuts else None))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bits = sent.value
        if cuts:
            batches = worded(batches, bits, config.stop_words, config.tfidf_stop_words)
        return scored(pa.ipc.open_stream(index).read_all(), batches, config, threshold, top_n)

    return jobs.select(*(TEXTS if cuts else READ)).mapInArrow(score, _schema(resumes, jobs))


def scored(resumes: pa.Table, batches: Iterator[pa.RecordBatch], config: MatchConfig, threshold: float,
           top_n: int | None) -> Iterator[pa.RecordBatch]:
    """The work of a task: pairs of the resumes with the jobs of the batches, in batches of bounded size."""
    pairs = blocks.pair_scorer(config, threshold, top_n)
    groups = [blocks.Side(resumes.slice(at, blocks.RESUMES_PER_CELL).combine_chunks())
              for at in range(0, resumes.num_rows, blocks.RESUMES_PER_CELL)]
    best = [None if top_n is None else np.full((g.table.num_rows, top_n), -np.inf) for g in groups]
    for batch in batches:
        for part in _slices(pa.Table.from_batches([batch])):
            right = blocks.WordSide(part.sort_by("key").combine_chunks())
            sent = right.table.select(["key", *KEPT])  # a pair does not take the words along
            for left, known in zip(groups, best):
                r, j, sums, capped = pairs(left, right, known)
                for at in (slice(n, n + PAIRS_PER_BATCH) for n in range(0, len(r), PAIRS_PER_BATCH)):
                    mine, theirs = left.table.select(sent.column_names).take(pa.array(r[at])), sent.take(pa.array(j[at]))
                    yield from pa.table({
                        "r": mine["key"], "j": theirs["key"], **{c: pa.array(m[at]) for c, m in sums.items()},
                        "capped": pa.array(capped[at], mask=np.isnan(capped[at])),
                        **{f"{c}{n}": side[c] for n, side in ((1, mine), (2, theirs)) for c in KEPT},
                    }).combine_chunks().to_batches()
