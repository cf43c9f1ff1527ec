"""Embedding whitening on the leading principal components, found by Chebyshev-filtered subspace iteration.

Every component c of a vector becomes the integer ``x = floor(SCALE * c) + SHIFT``. The fit list holds each distinct x vector once; all
covariances are over it, with divisor n, of rows centred exactly first: ``(n * x - S) / n`` with integer ``n * x - S``.

The covariance V is never formed. A pass over the fit list gives ``V Q = Xc' (Xc Q) / n`` for a block Q of a few columns: every task adds up its rows,
and tasks are added in groups of ``FAN`` until few sums are left for the driver, of the size of Q. The iteration:

1. A random block of ``BLOCK`` orthonormal columns (all of the space, if that is smaller); Rayleigh-Ritz gives values e and vectors.
2. A Chebyshev polynomial that is small on [a, c], c the smallest Ritz value of the block and a a floor of the spectrum from a few Lanczos steps, and grows fast above
   is applied by its three-term recurrence, one pass a degree, which damps the unwanted spectrum. The degree is held where the largest value would drown the smallest wanted one.
3. QR against the vectors already certified, Rayleigh-Ritz on all, until every wanted vector is certified: residual ``|V q - e q|`` at most ``TOLERANCE * e1``.
   A round that improves no residual any more ends the iteration too, if all are within ``ENOUGH * e1``, the reach of double sums; else it goes on.

Rows whose vector is null, empty or has null or non-finite components are dropped, as are fit and result of them; a null id stays null. Vectors of different length
are fitted apart, each length with its own n and components. Repeated rows count once in the fit and each have their result. Components without
variance (above ``NOTHING * e1``) are left out: a single distinct vector has none, so its rows give no result, as an empty table does.
Equal eigenvalues leave their vectors open; any orthonormal choice is right. Components beyond 64 bits are cut to that range; sums beyond it
are Python integers, a deviation of more than 38 digits is null. Other columns are left alone.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import read, stored

SCALE, SHIFT, COMPONENTS, BLOCK, DEGREE, FAN, ROUNDS, LANCZOS = 64, 1_000_000, 16, 48, 12, 64, 200, 8
TOLERANCE, ENOUGH, NOTHING, DROWN = 1e-13, 1e-11, 1e-12, 1e8


def shifted(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, dim, x) of the usable vectors."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    most = F.lit(2 ** 63 - 1 - SHIFT)
    x = F.transform(v, lambda c: F.least(F.floor(c.cast("double") * float(SCALE)), most) + F.lit(SHIFT))
    return rows.filter(usable).select(F.col(ident).alias("id"), F.size(v).alias("dim"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Centre:
    """The exact sums S of n rows, and what is taken off every row."""

    def __init__(self, n: int, sums: list[int], wide: bool) -> None:
        self.n, self.wide = n, wide  # wide: beyond 64 bits, so Python integers
        self.sums = np.array(sums, object if wide else np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        return (x.astype(object) if self.wide else x) * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(float) / self.n


class Fit:
    """The fit list of one vector length with its exact sums, and passes over it."""

    def __init__(self, vectors: DataFrame, dim: int) -> None:
        self.dim = dim
        self.rows = stored(vectors.filter(F.col("dim") == dim).select("x").dropDuplicates())
        most = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))
        tasks = self.rows.withColumn("p", F.spark_partition_id())
        facts = tasks.agg(F.count("*").alias("n"), most.alias("most"), F.max("p").alias("last")).first()
        self.n, self.tasks = facts.n, facts.last + 1
        sums = self.rows.mapInArrow(_sums(dim), "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
        self.centre = Centre(self.n, [int(r.total) for r in sums.orderBy("at").collect()], self.n * facts.most >= 2 ** 62)  # one row a dimension

    def total(self, part) -> np.ndarray:
        """The sum of ``part(centred rows)``, an array of fixed size, over the fit list."""
        centred, dim = self.centre.centred, self.dim

        def run(batches):
            total, at = 0.0, None
            for batch in batches:
                if batch.num_rows:
                    total = total + np.asarray(part(centred(_matrix(batch.column(0), dim)))).ravel()
                    at = TaskContext.get().partitionId()
            if at is not None:
                yield _one(at, total)

        parts, count = self.rows.mapInArrow(run, "p long, total array<double>"), self.tasks
        while count > FAN:
            count = -(-count // FAN)
            parts = parts.groupBy(F.floor(F.col("p") / FAN).alias("p")).applyInArrow(_added, "p long, total array<double>")
        return np.sum([r.total for r in sorted(parts.collect(), key=lambda r: r.p)], axis=0)  # FAN rows at most

    def times(self, q: np.ndarray) -> np.ndarray:
        """``V q``: one pass."""
        return self.total(lambda rows: rows.T @ (rows @ q)).reshape(q.shape) / self.n


def _one(p: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["p", "total"])


def _added(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("p").to_numpy(), kind="stable")  # the same sum in every run
    rows = table.column("total").to_pylist()
    total = np.sum([rows[i] for i in order], axis=0)
    return pa.Table.from_batches([_one(int(table.column("p")[0].as_py() // FAN), total)])


def _sums(dim: int):
    def run(batches):
        total = np.zeros(dim, object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dim)
                safe = int(np.abs(x).max()) * len(x) < 2 ** 62
                total = total + (x.sum(0) if safe else x.astype(object).sum(0)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))],
                                         ["at", "total"])
    return run


def spectrum_floor(times, dim: int, steps: int = LANCZOS, seed: int = 17) -> float:
    """A value that the spectrum of V hardly reaches below: the least value of a few Lanczos steps less the length of what they leave, 0 at least."""
    q = np.random.default_rng(seed).normal(size=(dim, 1))
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dim)):
        w = times(basis[-1])
        alpha.append(float((w * basis[-1]).sum()))
        for v in basis:
            w = w - v * (v * w).sum()
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= NOTHING * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    least = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))[0] if len(alpha) == len(beta) else 0.0
    return max(0.0, float(least) - beta[-1])


def chebyshev(times, block: np.ndarray, degree: int, low: float, cut: float, top: float, project=lambda y: y) -> np.ndarray:
    """A Chebyshev polynomial of V times ``block``, small on [low, cut] and scaled to about 1 at ``top``; ``project`` keeps its iterates clean."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    first = half / (top - middle)
    ratio, before, now = first, block, project(times(block) - middle * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - ratio)
        before, now = now, project(2 * (following / half) * (times(now) - middle * now) - ratio * following * before)
        ratio = following
    return now


def _degree(low: float, cut: float, top: float, wanted: float) -> int:
    """The highest degree, ``DEGREE`` at most, at which ``top`` grows no more than ``DROWN`` times as much as ``wanted``."""
    growth = [np.arccosh(max(1.0, (2 * e - cut - low) / (cut - low))) for e in (top, wanted)]
    return int(min(DEGREE, max(2, np.log(DROWN) / max(growth[0] - growth[1], 1e-9))))


def _without(held: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``y`` without its part in the span of certified vectors, which the filter would blow up otherwise."""
    return y - held @ (held.T @ y)


def leading_components(times, dim: int, want: int = COMPONENTS, block: int = BLOCK, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, largest residual) of the ``want`` largest eigenvalues of the symmetric, non-negative V behind ``times(Q) = V Q``."""
    want, block = min(want, dim), min(block, dim)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, block)))[0]
    least, floor = np.inf, None
    for _ in range(ROUNDS):
        vq = times(q)
        e, u = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        top = max(float(e[0]), 0.0)
        residual = np.linalg.norm(vq - q * e, axis=0)[:want]
        worst = float(residual.max())
        if worst <= TOLERANCE * top or block == dim or (worst <= ENOUGH * top and worst > least / 2):
            break
        least = min(least, worst)
        sure = int(np.argmax(np.append(residual > TOLERANCE * top, True)))  # leading certified vectors stay as they are
        cut = float(e[-1])
        if cut <= NOTHING * top:  # fewer directions with variance than columns: one product spans them all
            q = np.linalg.qr(vq)[0]
            continue
        floor = spectrum_floor(times, dim) if floor is None else floor
        low = floor if floor < 0.98 * cut else 0.0
        degree = _degree(low, cut, float(e[sure]), float(e[want - 1]))
        held = q[:, :sure]
        filtered = chebyshev(times, q[:, sure:], degree, low, cut, float(e[sure]), lambda y, held=held: _without(held, y))
        filtered /= np.linalg.norm(filtered, axis=0)
        for _ in range(2):
            filtered = np.linalg.qr(_without(held, filtered))[0]
        q = np.hstack([held, filtered])
    else:
        raise ArithmeticError("the components did not settle")
    return e[:want], q[:, :want], worst


def whiten(rows: DataFrame, ident: str, vector: str, want: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    vectors = stored(shifted(rows, ident, vector))
    out = None
    for dim in sorted(r.dim for r in vectors.select("dim").distinct().collect()):  # lengths of vectors, few
        part = _whitened(vectors, Fit(vectors, dim), want)
        out = part if out is None else out.unionByName(part)
    kind = vectors.schema["id"].dataType.simpleString()
    if out is None:
        out = rows.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                                    "explained double, identity_error double")
    return out


def _whitened(vectors: DataFrame, fit: Fit, want: int) -> DataFrame:
    trace = float(fit.total(lambda x: [(x * x).sum()])[0]) / fit.n
    if trace > 0:
        e, q, _ = leading_components(fit.times, fit.dim, want)
        real = e > NOTHING * e[0]
        e, q = e[real], q[:, real]
    else:
        e, q = np.zeros(0), np.zeros((fit.dim, 0))
    into, k = q / np.sqrt(e), e.size
    moments = fit.total(lambda x: np.vstack([(w := x @ into).T @ w, w.sum(0)])).reshape(k + 1, k) / fit.n if k else np.zeros((1, 0))
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max(initial=0.0))
    kind, centre, dim = vectors.schema["id"].dataType.simpleString(), fit.centre, fit.dim

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scaled = centre.scaled(_matrix(batch.column(1), dim))
                most = int(np.abs(scaled).max())
                exact = scaled if most * most * dim < 2 ** 63 else scaled.astype(object)
                deviation = [Decimal(int(v)) if v < 10 ** 38 else None for v in (exact * exact).sum(1)]
                white = (scaled.astype(float) / centre.n) @ into
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.decimal128(38, 0)),
                                                  pa.array(white.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    fields = vectors.filter(F.col("dim") == fit.dim).select("id", "x").mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    share = F.array(*(F.lit(float(v / trace)) for v in e)) if k else F.array().cast("array<double>")
    return (fields.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
                      "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
