"""Exact top-k by inner product with segment statistics from coarse to fine.

Vectors become integers, floor(scale * x). A vector is cut into segments; the sum and the
squared deviation from the mean of each segment bound the inner product of two vectors from
above (their squared distance from below), by the Cauchy-Schwarz inequality per segment.
Candidates are dealt into blocks of bounded size and so are queries; every pair of blocks is
one task, which keeps candidates whose bound reaches the k-th best exact score met so far,
level after level, and computes exact scores for what is left. The k best of all blocks
are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = (1, 4, 16)  # segments per level
CANDIDATES, QUERIES = 4096, 1024  # rows in a block
FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: float) -> DataFrame:
    """``(vec_id, v array<long>)``; vectors that take no part are left out.

    Those are null or empty vectors, vectors with a null or non-finite component, and rows
    without an id.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("_x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long"), x.alias("_x"))
            .filter("vec_id is not null and _x is not null and size(_x) > 0").filter(~bad)
            .select("vec_id", F.transform("_x", lambda c: F.floor(c * scale)).alias("v")))


def bounds(q: np.ndarray, block: np.ndarray, segments: int) -> np.ndarray:
    """Upper bounds of the inner products of ``q`` with the rows of ``block``."""
    edges = np.unique(np.linspace(0, block.shape[1], segments + 1).astype(int))[:-1]
    width = np.diff(np.append(edges, block.shape[1]))

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.add.reduceat(x, edges, axis=-1)
        square = np.add.reduceat(x * x, edges, axis=-1)
        return total, np.sqrt(np.maximum(square - total * total / width, 0.0))

    (qs, qd), (bs, bd) = parts(q), parts(block)
    bound = (bs / width) @ qs.T + bd @ qd.T
    return bound + 1e-9 * np.abs(bound) + 1e-3  # rounding never cuts a candidate


def best_of_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                  k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k best of one block for each query, ties to the smaller id."""
    size = float(np.abs(block).max(initial=0)) * float(np.abs(queries).max(initial=0)) * block.shape[1]
    exact = np.float64 if size < 2.0 ** 52 else object  # whole numbers either way
    plain = block.astype(np.float64)
    rows = block.astype(exact)
    levels = [bounds(queries.astype(np.float64), plain, s).T for s in LEVELS if s <= max(1, block.shape[1])]
    for i, name in enumerate(query_ids):
        q, other = queries[i].astype(exact), ids != name
        first = np.argpartition(-levels[-1][i], min(4 * k, len(ids) - 1))[: 4 * k]
        first = first[other[first]]
        seen = np.sort(rows[first] @ q)[::-1]
        least = seen[k - 1] if len(seen) >= k else -np.inf
        alive = np.flatnonzero(other)
        for level in levels:
            alive = alive[level[i][alive] >= least]
        scores = rows[alive] @ q
        order = np.lexsort((ids[alive], -scores))[:k] if exact is np.float64 else np.array(
            sorted(range(len(alive)), key=lambda j: (-scores[j], ids[alive[j]]))[:k], int)
        yield name, ids[alive[order]], scores[order]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for rows whose id is divisible by ``every``.

    ``vectors`` has vec_id and embedding. Candidates are all rows with another id than the
    query's; vectors of another length than the query's do not meet it. Rows that repeat an
    id are candidates each, and each repeated query row asks once for its id. A score is exact
    as long as it fits into a long. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    data = quantized(vectors, scale).withColumn("_size", F.size("v"))
    asked = data.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    sizes = data.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    columns = max(1, -(-sizes["n"] // CANDIDATES))
    stripes = max(1, -(-sizes["q"] // QUERIES))
    kind = ["_size", "_column", "_stripe"]
    left = (data.withColumn("_column", F.pmod(F.xxhash64("vec_id", "v"), F.lit(columns)).cast("int"))
            .withColumn("_stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
            .select(*kind, "vec_id", "v"))
    right = (asked.withColumn("_stripe", F.pmod(F.xxhash64("vec_id", "v"), F.lit(stripes)).cast("int"))
             .withColumn("_column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
             .select(*kind, "vec_id", "v"))

    def cell(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, block = _matrix(rows)
            for name, who, scores in best_of_block(ids, block, *_matrix(queries), k):
                found += [(int(name), int(w), int(s)) for w, s in zip(who, scores)]
        kinds = (pa.int64(),) * 3
        return pa.table([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)],
                        names=["query_id", "vec_id", "score"])

    cells = columns * stripes
    found = (left.repartition(cells, *kind).groupBy(*kind)
             .cogroup(right.repartition(cells, *kind).groupBy(*kind)).applyInArrow(cell, FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = pa.compute.list_flatten(table.column("v")).to_numpy()
    return ids, flat.reshape(len(ids), -1)
