"""TF-IDF of pairs with more terms than the limit.

Only the ``max_terms`` terms with the highest summed count are used, ties going to
the term that sorts first. Which terms those are differs from pair to pair, so the
sums over shared terms no longer suffice. The pairs that are left after every
bound was applied are dealt to cells of limited size, together with the documents
they name, and each cell ranks the terms of its pairs.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.ranked import ranked_cosine, term_vectors
from matchloom.operators.shared import cell_partitions

PAIRS_PER_CELL = 512
RESUMES_PER_JOB_CELL = 4096


def _cell(max_terms: int):
    def score(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        vectors, = term_vectors(docs)
        place = {k: n for n, k in enumerate(zip(docs["side"].to_pylist(), docs["key"].to_pylist()))}
        r, j = pairs["r"].to_pylist(), pairs["j"].to_pylist()
        scores = [
            ranked_cosine(*vectors[place[0, a]], *vectors[place[1, b]], max_terms)
            for a, b in zip(r, j)]
        return pa.table({"r": pa.array(r, pa.string()), "j": pa.array(j, pa.string()),
                         "capped": pa.array(scores, pa.float64())})

    return score


def capped_tfidf(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame,
                 max_terms: int) -> DataFrame:
    """``(r, j, capped)`` of the pairs ``(r, j)``, which have to be a stored table.

    The pairs of one job are spread over cells by resume, so a job that very many
    resumes match fills no single cell; a document goes only to cells that name it.
    """
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    n_pairs = pairs.count()
    cells = max(math.ceil(n_pairs / PAIRS_PER_CELL), min(2 * cores, n_pairs), 1)
    parts = math.ceil(max(resumes.count(), 1) / RESUMES_PER_JOB_CELL)

    def number(of: Column, n: int) -> Column:
        return F.pmod(of, F.lit(n)).cast("int")

    part = number(F.xxhash64("r"), parts)
    dealt = pairs.select("r", "j", number(F.xxhash64("j", part), cells).alias("cell"))

    def documents(side: DataFrame, column: str, n: int) -> DataFrame:
        named = dealt.select("cell", F.col(column).alias("key")).distinct()
        return named.join(side.select("key", "entries"), "key").select(
            F.col("cell").alias("home"), F.lit(n).alias("side"), "key", "entries")

    docs = documents(resumes, "r", 0).unionByName(documents(jobs, "j", 1))
    partitions = cell_partitions(pairs.sparkSession, cells)
    left, right = dealt.repartition(partitions, "cell"), docs.repartition(partitions, "home")
    return left.groupBy("cell").cogroup(right.groupBy("home")).applyInArrow(
        _cell(max_terms), "r string, j string, capped double")
