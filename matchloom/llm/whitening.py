"""Whitening of vectors by incremental eigendecomposition.

Each partition keeps the eigenvectors and eigenvalues of its scatter matrix and takes in one vector after
the other: a centred vector is a rank-one update, whose eigenvalues are the roots of a secular
equation and whose eigenvectors follow from them; components that the vector does not touch, and equal
eigenvalues, are deflated first. The spectra of partitions meet, a bounded number at a
time, by successive rank-one updates as well: the eigenvectors of one, scaled, and the difference of
the means. The basis found is refined by Rayleigh-Ritz: the covariance within it is summed over
all rows, centred before multiplying, and its eigenvectors turn the basis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize
from matchloom.operators.shared import cell_partitions

EPS = np.finfo(float).eps
FAN_IN = 8  # spectra that one task combines
ROWS = 2048  # rows of a partition that updates one spectrum, about
SPECTRUM = "part long, n long, mean array<double>, roots array<double>, basis array<double>"


def deflated(d: np.ndarray, z: np.ndarray, basis: np.ndarray, size: float) -> np.ndarray:
    """Which entries take part; equal eigenvalues are turned so that one of them holds all of ``z``."""
    small = 8 * EPS * size
    for i in np.flatnonzero(np.abs(np.diff(d)) <= small):
        r = np.hypot(z[i], z[i + 1])
        if r > 0:
            c, s = z[i + 1] / r, z[i] / r
            z[i], z[i + 1] = 0.0, r
            left, right = basis[:, i].copy(), basis[:, i + 1].copy()
            basis[:, i], basis[:, i + 1] = c * left - s * right, s * left + c * right
    return np.abs(z) * np.linalg.norm(z) > small


def secular(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum w_j / (d_j - x) = 0 for ascending ``d`` and positive ``w``.

    As ``(pole, shift)``: root i is d[pole] + shift, and lies between d[i] and d[i + 1] (or d[i] plus the
    sum of ``w``). The nearer pole is the origin, so that differences to poles keep all their digits.
    """
    n = len(d)
    gap = np.append(np.diff(d), w.sum())
    middle = 1 + (w / (d - (d + gap / 2)[:, None])).sum(axis=1)
    near = np.where((middle >= 0) | (np.arange(n) == n - 1), np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    from_left = near == np.arange(n)
    away = d - d[near][:, None]
    low = np.where(from_left, 0.0, -gap / 2)
    high = np.where(from_left, np.where(np.arange(n) == n - 1, gap, gap / 2), 0.0)
    x = (low + high) / 2
    edge = np.arange(n)[:, None] >= np.arange(n)  # poles up to the root's own
    own, upper = d - d[near], np.append(d[1:], np.inf) - d[near]
    done = np.zeros(n, bool)
    for _ in range(80):
        q = w / (away - x[:, None])
        f = 1 + q.sum(axis=1)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        done |= np.abs(f) <= EPS * n * (1 + np.abs(q).sum(axis=1))
        if done.all():
            break
        # Poles below and above the root are each replaced by one that has the same value and slope.
        slope = q / (away - x[:, None])
        a, b = own - x, upper - x
        psi, phi = np.where(edge, slope, 0.0).sum(axis=1), np.where(edge, 0.0, slope).sum(axis=1)
        last = np.isinf(b)
        b = np.where(last, 1.0, b)
        c = f - a * psi - np.where(last, 0.0, b * phi)
        # c + a^2 psi / (a - t) + b^2 phi / (b - t) = 0 in the step t
        m = (a + b) * f - a * b * (psi + phi)
        root = np.sqrt(np.maximum(m * m - 4 * c * a * b * f, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(m > 0, 2 * a * b * f / (m + root), (m - root) / (2 * c))
            t = np.where(last, a + a * a * psi / np.where(c == 0, np.inf, c), t)
            new = x + t
        done |= np.abs(t) <= 2 * EPS * np.abs(x)
        bad = ~np.isfinite(new) | (new <= low) | (new >= high)
        x = np.where(done, x, np.where(bad, (low + high) / 2, new))
    return near, x


def updated(d: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``basis diag(d) basis' + vector vector'``."""
    z = basis.T @ vector
    size = max(d[-1], 0.0) + z @ z
    if not size > 0:
        return d, basis
    basis = basis.copy()
    held = deflated(d, z, basis, size)
    if not held.any():
        return d, basis
    poles, part, turn = d[held], z[held], basis[:, held]
    near, shift = secular(poles, part * part)
    # Differences pole - root, exact to their last digits.
    apart = (poles[None, :] - poles[near][:, None]) - shift[:, None]
    # Weights for which these roots are exact make the eigenvectors orthogonal.
    n = len(poles)
    ratio = np.abs(apart)
    between = np.abs(poles[None, :] - poles[:, None])
    between[np.arange(n), np.arange(n)] = 1.0
    with np.errstate(divide="ignore"):
        weight = np.exp(0.5 * (np.log(ratio).sum(axis=0) - np.log(between).sum(axis=0)))
    weight = np.copysign(weight, part)
    with np.errstate(divide="ignore", invalid="ignore"):
        vectors = weight[None, :] / apart
    on_pole = ~np.isfinite(vectors).all(axis=1)
    vectors[on_pole] = (apart[on_pole] == 0).astype(float)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    roots = poles[near] + shift
    out, turned = d.copy(), basis
    out[held], turned[:, held] = roots, turn @ vectors.T
    order = np.argsort(out, kind="stable")
    return out[order], turned[:, order]


class Spectrum:
    """Number, mean, and scatter matrix (by its eigenvectors) of vectors."""

    def __init__(self, n: int, mean: np.ndarray, roots: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.roots, self.basis = n, mean, roots, basis

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def _take(self, vector: np.ndarray) -> None:
        self.roots, self.basis = updated(self.roots, self.basis, vector)

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        apart = x - self.mean
        if self.n > 1:
            self._take(apart * np.sqrt((self.n - 1) / self.n))
        self.mean = self.mean + apart / self.n

    def merge(self, other: Spectrum) -> None:
        total = self.n + other.n
        apart = other.mean - self.mean
        for root, axis in zip(other.roots, other.basis.T):
            if root > 0:
                self._take(axis * np.sqrt(root))
        self._take(apart * np.sqrt(self.n / total * other.n))
        self.mean, self.n = self.mean + apart * (other.n / total), total

    def row(self, part: int) -> dict:
        return {"part": [part], "n": [self.n], "mean": [self.mean.tolist()], "roots": [self.roots.tolist()],
                "basis": [self.basis.ravel().tolist()]}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        mean = np.array(row["mean"])
        return cls(row["n"], mean, np.array(row["roots"]), np.array(row["basis"]).reshape(len(mean), len(mean)))


KIND = pa.schema([("part", pa.int64()), ("n", pa.int64()), *[(c, pa.list_(pa.float64())) for c in ("mean", "roots", "basis")]])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0,
          shift: int = 100_000) -> DataFrame:
    """``(key, x array<long>)``, x = floor(scale * c) + shift; vectors that are null, empty or hold null or
    non-finite entries are left out, and so are those of another length than most (of equally frequent
    lengths, than the longest)."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists("_x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = (vectors.select(F.col(key).alias("key"), x.alias("_x")).filter("_x is not null and size(_x) > 0").filter(~bad)
            .select("key", F.transform("_x", lambda c: F.floor(c * scale) + shift).alias("x")))
    most = good.groupBy(F.size("x").alias("size")).count().agg(F.max(F.struct("count", "size")).alias("m")).first()["m"]
    return good.filter(F.size("x") == (most["size"] if most else 0))


def spectrum(x: DataFrame, n: int, width: int) -> Spectrum:
    """Of all rows of ``x(key, x)``: partitions by updates, then groups of ``FAN_IN`` partitions until one is left."""
    spark = x.sparkSession

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(width)
        for batch in batches:
            for row in matrix(batch.column(0)).astype(float):
                own.add(row)
        if own.n:
            yield pa.RecordBatch.from_pydict(own.row(TaskContext.get().partitionId()), schema=KIND)

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        first, *others = map(Spectrum.of, sorted(table.to_pylist(), key=lambda r: r["part"]))
        for other in others:
            first.merge(other)
        return pa.Table.from_pydict(first.row(key[0].as_py()), schema=KIND)

    parts = cell_partitions(spark, -(-n // ROWS))
    found = materialize(x.select("x").repartition(parts).mapInArrow(fit, SPECTRUM), "spectra")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        # A number of partitions of its own: groups are small in bytes, and adaptive execution would merge them.
        grouped = found.withColumn("_group", F.expr(f"part div {FAN_IN}")).repartition(parts, "_group")
        found = materialize(grouped.groupBy("_group").applyInArrow(combine, SPECTRUM), "spectra")
    return Spectrum.of(found.first().asDict())


def summed(rows: DataFrame) -> DataFrame:
    """Sums of arrays ``v`` of one length, place by place, as ``(pos, v)``: each task adds up its own rows first."""
    return rows.select(F.posexplode("v").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))


def projected_scatter(x: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``basis' V basis``, summed over all rows; entries are centred exactly, then divided and multiplied."""
    width = len(sums)
    shared = x.sparkSession.sparkContext.broadcast((sums, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, basis = shared.value
        total = np.zeros((width, width))
        for batch in batches:
            y = centred(matrix(batch.column(0)), n, sums) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    got = summed(x.select("x").mapInArrow(run, "v array<double>")).collect()  # width^2 numbers
    out = np.zeros(width * width)
    for r in got:
        out[r["pos"]] = r["v"]
    return out.reshape(width, width) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n; the numerator n*x - S is a whole number below 2^63 for any n below 10^12."""
    return (n * x - sums) / float(n)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n*x - S)^2 per row, exact; None if it does not fit a long."""
    apart = n * x - sums
    if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
        return (apart * apart).sum(axis=1).tolist()
    exact = (int(v) for v in (apart.astype(object) ** 2).sum(axis=1))
    return [v if v < 2 ** 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding",
           scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` per row and component.

    Rows that take no part are said in ``whole``. Components are numbered by falling eigenvalue; one
    whose eigenvalue is zero to rounding (copies of one vector, fewer rows or entries than components) has no
    direction and is left out, so that a single vector gives no rows. Equal vectors, repeated rows
    and rows without a key count each. ``deviation`` is null where it does not fit a long. Other
    columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = materialize(whole(vectors, key, vector, scale, shift), "whole-vectors")
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n = x.count()
    if not n:
        return spark.createDataFrame([], schema)
    rows = summed(x.select(F.col("x").alias("v"))).orderBy("pos").collect()  # one number per dimension
    sums = np.array([r["v"] for r in rows], np.int64)
    width = len(sums)

    first, _ = np.linalg.qr(spectrum(x, n, width).basis[:, ::-1])
    inside = projected_scatter(x, n, sums, first)
    roots, turn = np.linalg.eigh((inside + inside.T) / 2)
    keep = [i for i in range(width)[::-1] if roots[i] > 100 * EPS * width * max(roots[-1], 0.0)][:components]
    if not keep:
        return spark.createDataFrame([], schema)
    trace = float(np.trace(inside))
    axes = (first @ turn)[:, keep] / np.sqrt(roots[keep])
    shared = spark.sparkContext.broadcast((sums, axes))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, axes = shared.value
        for batch in batches:
            if batch.num_rows:
                each = matrix(batch.column(1))
                y = centred(each, n, sums) @ axes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(deviations(each, n, sums), pa.int64()),
                     pa.array(y.tolist(), pa.list_(pa.float64()))], ["key", "deviation", "w"])

    white = materialize(x.select("key", "x").mapInArrow(project, f"key {kind}, deviation long, w array<double>"), "whitened")
    ks = range(len(keep))
    means = white.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in ks]).first()
    off = [F.col("w")[i] - float(means[i]) for i in ks]
    spread = white.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i in ks for j in ks if i <= j]).first()
    error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i in ks for j in ks if i <= j)
    told = F.array(*[F.lit(float(roots[i] / trace)) for i in keep])
    return white.select("key", "deviation", F.posexplode("w").alias("_i", "whitened")).select(
        F.col("key").alias(key), (F.col("_i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(told, "_i").alias("explained"), F.lit(float(error)).alias("identity_error"))
