"""Whitening of embeddings by a singular value decomposition: blockwise QR to one small triangle, then one-sided Jacobi rotations.

Vectors are whole numbers (see `whole`), so counts, sums and deviations are exact, and a vector is centred before anything is
multiplied. Each task folds its centred rows into one triangle R; triangles meet in a tree of Spark groups of bounded size.
Plane rotations then make the columns of R orthogonal: the rotations multiplied together are the components, and the lengths
of the columns are the standard deviations (times sqrt(n)), to relative precision, for no covariance is ever squared up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, only, stage

SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more count as not finite: their whole numbers would not fit.
TOO_LARGE = float(1 << 32)
#: Triangles that one task puts together, and rows that are folded in at once.
FAN_IN, FOLD_ROWS = 64, 4096
#: Sums below this are held in 64-bit integers, larger ones in whole numbers of any size.
FITS = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """What `fit` learns: n vectors, sums and largest size of their whole numbers by dimension, components as columns, variances, and their total."""

    n: int
    sums: np.ndarray
    largest: int
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.n * self.largest < FITS:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.shifted(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Squared lengths of n * x - S, exact; null if beyond 38 digits."""
        d = self.shifted(x)
        most = int(np.abs(d).max(initial=0))
        if most * most * max(1, d.shape[1]) < FITS:
            return pa.array((d.astype(np.int64) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        sums = [sum(int(v) ** 2 for v in row) for row in d]
        return pa.array([Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by component: centred vectors on the components over their standard deviations; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.variances > 0, 1 / np.sqrt(self.variances), np.nan)
        return (self.centred(x) @ self.components) * scale


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Identifier and vector (array of double) of rows whose vector is not null and has finite entries below TOO_LARGE only."""
    rows = only(rows, id_col, vector_col)
    rows = rows.select(rows.columns[0], F.col(rows.columns[1]).cast("array<double>").alias("vector"))
    return rows.filter(F.coalesce(F.forall("vector", lambda c: F.coalesce(F.abs(c) < TOO_LARGE, F.lit(False))), F.lit(False)))


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """The whole numbers floor(1024 * c) + 100000 of a batch of vectors, as rows."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal columns v and lengths s, falling, so that r @ v has orthogonal columns of these lengths.

    In each round of a sweep disjoint pairs of columns are rotated at once, paired as in a round-robin tournament; a pair is
    left alone once its cosine is at rounding level, and a sweep without rotation is the last.
    """
    d = r.shape[1]
    unit = float(np.abs(r).max(initial=0)) or 1.0
    a, v = r / unit, np.eye(d)
    order, tol = np.arange(d + d % 2), np.finfo(float).eps * max(1.0, np.sqrt(len(r)))
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(order) - 1):
            i, j = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            real = (i < d) & (j < d)
            i, j = i[real], j[real]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > tol * np.sqrt(xx * yy)
            if turn.any():
                rotated = True
                i, j = i[turn], j[turn]
                zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                for m in (a, v):
                    m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if not rotated:
            break
    lengths = np.sqrt((a * a).sum(0))
    by_length = np.argsort(-lengths, kind="stable")
    return v[:, by_length], lengths[by_length] * unit


def dimension(rows: DataFrame) -> int:
    """The commonest length of vectors, the smallest of equally common ones; 0 for an empty table."""
    found = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return found["dim"] if found else 0


def totals(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, int]:
    """Number of vectors, sums and largest size of their whole numbers; one row a task and dimension is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, largest = 0, np.zeros(dim, object), 0
        for batch in batches:
            x = whole(batch.column(1), dim)
            n, sums, largest = n + len(x), sums + x.sum(axis=0).astype(object), max(largest, int(np.abs(x).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(dim), pa.int32()), "n": [n] * dim, "s": pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), "largest": [largest] * dim})

    found = rows.mapInArrow(run, "k int, n long, s decimal(38,0), largest long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("largest").alias("largest")).orderBy("k").collect()
    return found[0]["n"], np.array([int(r["s"]) for r in found], object), found[0]["largest"]


def triangle_of(rows: DataFrame, base: Whitening, dim: int) -> np.ndarray:
    """R of the centred rows: one triangle a task, then FAN_IN of them at a time until few are left, each round a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            for i in range(0, batch.num_rows, FOLD_ROWS):
                r = triangle([r, base.centred(whole(batch.column(1).slice(i, FOLD_ROWS), dim))])
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        r = triangle([np.frombuffer(b).reshape(-1, dim) for b in group.sort_values("part")["r"]])
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN_IN], "r": [r.tobytes()]})

    parts = stage(rows.mapInArrow(run, "part long, r binary"), "triangles")
    while (n := parts.count()) > 1:
        if n <= FAN_IN:
            parts = parts.withColumn("part", F.lit(0).cast("long"))
        parts = stage(parts.groupBy((F.col("part") / FAN_IN).cast("long").alias("up")).applyInPandas(together, "part long, r binary"), "triangles")
    return np.frombuffer(parts.first()["r"]).reshape(-1, dim)


def identity_error(rows: DataFrame, model: Whitening, dim: int) -> float | None:
    """The largest entry, in size, of the covariance of whitened vectors less the identity; None if no component has variance."""
    some = np.flatnonzero(model.variances > 0)
    if not len(some):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((len(some), len(some))), np.zeros(len(some))
        for batch in batches:
            w = model.whitened(whole(batch.column(1), dim))[:, some]  # centred already, to rounding
            products, sums = products + w.T @ w, sums + w.sum(axis=0)
        i, j = np.indices((len(some) + 1, len(some))).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": np.vstack((products, sums)).ravel()})

    found = {(r["i"], r["j"]): r["v"] / model.n for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    k = range(len(some))
    return max(abs(found[i, j] - found[len(some), i] * found[len(some), j] - (i == j)) for i in k for j in k)


def fit(rows: DataFrame, most: int = 8) -> Whitening | None:
    """Whitening of rows (identifier, vector) of one length, for at most `most` components; None for an empty table.

    The driver holds d sums, one triangle of d by d and `most` squared sums. A component whose standard deviation is at rounding
    level of the largest has variance 0.
    """
    dim = dimension(rows)
    if not dim:
        return None
    n, sums, largest = totals(rows, dim)
    base = Whitening(n, sums, largest, np.zeros((dim, 0)), np.zeros(0), 0.0)
    v, lengths = jacobi(triangle_of(rows, base, dim))
    lengths = np.where(lengths > dim * np.finfo(float).eps * lengths[0], lengths, 0.0)
    variances = lengths**2 / n
    model = Whitening(n, sums, largest, v[:, :most], variances[:most], float(variances.sum()))
    return Whitening(n, sums, largest, model.components, model.variances, model.trace, identity_error(rows, model, dim))


def whitening(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """Fit on all usable vectors and whiten them: identifier, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, holds null or non-finite entries (or entries of TOO_LARGE or more), or has another length than
    most vectors are left out. Components are numbered by falling variance; min(most, length) rows come from each vector, also
    for repeated rows and null identifiers. whitened is null and explained 0 where a component has no variance; explained and
    identity_error are null where none has. deviation is a decimal of 38 digits. No usable vector: no rows. Further columns are ignored.
    """
    bound_batches(rows.sparkSession)
    rows = usable(rows, id_col, vector_col)
    kind = rows.schema[0].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    dim = dimension(rows)
    rows = rows.filter(F.size("vector") == dim)
    model = fit(rows, most)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.variances)
    explained = model.variances / model.trace if model.trace else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, FOLD_ROWS):
                part = batch.slice(i, FOLD_ROWS)
                x, m = whole(part.column(1), dim), part.num_rows
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    model.deviations(x).take(pa.array(each)), pa.array(model.whitened(x).ravel(), from_pandas=True), pa.array(np.tile(explained, m), from_pandas=True),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over all embeddings, eight components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
