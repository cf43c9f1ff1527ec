"""Exact top-k search by inner product over a pivot-distance index.

Vectors are carried onto a sphere by one more component, ``sqrt(R^2 - |x|^2)`` with R the largest norm, and 0 for a query; there the order by
distance is the order by inner product reversed. Every vector is keyed by its nearest pivot and its distance from it, in rings of equal width (annuli).
For a query, ring [a, b] of a pivot at distance t holds nothing nearer than ``max(t - b, a - t)``. Rings are visited by this bound in two
waves: first the nearest ones until they hold enough vectors, which gives a k-th score; then every other ring whose bound does not rule it out.
A ring with more than ``BLOCK`` vectors is several blocks, queries of a ring are dealt to groups of ``BLOCK``; a block meets a group in one task, as a matrix product.

Pivots come from a sample of ``SAMPLE`` vectors; every vector is indexed. The distances and bounds are floating-point with a margin, the scores are exact.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id. Only vectors of one length are compared.
A query id that occurs more than once is asked once, with the smallest of its vectors, and none of its rows is a candidate of it. Equal scores go to the smaller id;
a query without candidates gives no rows, an empty table gives an empty result, other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilmark.llm.common import arrow_rows, read, stored

SCALE, TOP, PIVOTS, RINGS, BLOCK, SAMPLE, EVERY, MARGIN = 256, 5, 24, 12, 4096, 4096, 50, 1e-6


def scaled(rows: DataFrame, ident: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, dim, v, norm2): ``floor(scale * x)`` of the usable vectors; norm2 is the squared length."""
    x = F.col(vector)
    usable = (F.col(ident).isNotNull() & x.isNotNull() & (F.size(x) > 0)
              & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("long"))
    out = rows.filter(usable).select(F.col(ident).cast("long").alias("id"), v.alias("v"))
    return out.select("id", F.size("v").alias("dim"), "v",
                      F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")).alias("norm2"))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in (column.to_pylist() if isinstance(column, pa.Array) else column)])


def _lifted(v: np.ndarray, radius2: float) -> np.ndarray:
    v = v.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, radius2 - (v * v).sum(1)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point where every sum is exact there."""
    most = (float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2.0 ** 52 else a @ b.T


def choose_pivots(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Centres of the sample: farthest-first start, then Lloyd steps."""
    sample = np.unique(sample, axis=0)
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    centres = sample[chosen]
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(1)
        centres = np.stack([sample[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
    return centres


class Index:
    """Pivots of each vector length, and the rings that hold vectors with their counts and bounds."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors
        radius = {r.dim: r.r for r in vectors.groupBy("dim").agg(F.max("norm2").alias("r")).collect()}
        sample = vectors.select("dim", "v", F.xxhash64("id", "v").alias("h")).orderBy("h", "dim").limit(SAMPLE).collect()
        self.pivots: dict[int, tuple[np.ndarray, float]] = {}
        for dim, r2 in radius.items():
            own = [r.v for r in sample if r.dim == dim]
            lifted = _lifted(np.array(own or [[0] * dim], np.int64), r2)
            self.pivots[dim] = choose_pivots(lifted, PIVOTS), r2
        self.keyed = stored(arrow_rows(vectors, _key, "id long, dim int, v array<long>, pivot int, ring int, distance double",
                                       self.pivots))
        rings = self.keyed.groupBy("dim", "pivot", "ring").agg(
            F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()
        # at most PIVOTS * RINGS rows for each vector length
        self.rings = {d: sorted((r for r in rings if r.dim == d), key=lambda r: (r.pivot, r.ring)) for d in radius}

    def plan(self) -> dict[int, tuple]:
        return {d: (*self.pivots[d], np.array([(r.pivot, r.ring, r.n, r.low, r.high) for r in rings], float).reshape(-1, 5))
                for d, rings in self.rings.items()}


def _key(batch: pa.RecordBatch, pivots: dict) -> pa.RecordBatch:
    dims, n = batch.column(1).to_numpy(), batch.num_rows
    pivot, ring, distance = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        centres, r2 = pivots[int(d)]
        far = _distances(_lifted(_matrix(batch.column(2).take(pa.array(at))), r2), centres)
        pivot[at], distance[at] = far.argmin(1), far.min(1)
        ring[at] = np.minimum(RINGS - 1, distance[at] / (2 * max(r2, 1e-9) ** 0.5) * 2 * RINGS).astype(np.int32)
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(pivot), pa.array(ring), pa.array(distance)],
                                      ["id", "dim", "v", "pivot", "ring", "distance"])


def _visits(batch: pa.RecordBatch, plan: dict, top: int, wave: int) -> pa.RecordBatch:
    """The rings a query visits: in wave 1 the nearest that hold enough, in wave 2 the others that may hold a better score."""
    dims, vectors, worst = batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
    visits = []
    for d, v, kth in zip(dims, vectors, worst, strict=True):
        centres, r2, rings = plan[int(d)]
        q = np.append(np.array(v, float), 0.0)[None]
        t = _distances(q, centres)[0][rings[:, 0].astype(int)]
        bound = np.maximum(0.0, np.maximum(t - rings[:, 4], rings[:, 3] - t)) * (1 - MARGIN) - MARGIN
        order = np.argsort(bound, kind="stable")
        enough = int(np.searchsorted(np.cumsum(rings[order, 2]), top + 1)) + 1  # one may be the query itself
        if wave == 1:
            visits.append(order[:enough].tolist())
        else:
            q2 = float((q * q).sum())
            reach = np.inf if kth is None else np.sqrt(max(0.0, r2 + q2 - 2.0 * kth))
            visits.append([int(i) for i in order[enough:] if bound[i] <= reach * (1 + MARGIN) + MARGIN])
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(visits, pa.list_(pa.int32()))],
                                      ["id", "dim", "v", "at"])


def _search(key: tuple, left: pd.DataFrame, right: pd.DataFrame, top: int) -> pd.DataFrame:
    """Best candidates of each query of a group in one block."""
    out = []
    if len(left) and len(right):
        ids = right["id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, data = ids[order], _matrix(right["v"])[order]
        for first in range(0, len(left), 256):
            part = left.iloc[first:first + 256]
            scores = exact_scores(_matrix(part["v"]), data)
            for q, row in zip(part["id"].to_numpy(np.int64), scores, strict=True):
                valid = np.flatnonzero(ids != q)
                s = row[valid]
                if s.size > top:
                    cut = np.partition(s, s.size - top)[s.size - top]
                    sure, ties = np.flatnonzero(s > cut), np.flatnonzero(s == cut)
                    best = np.concatenate([sure, ties[:top - sure.size]])  # ids ascend, so ties go to the smaller
                else:
                    best = np.arange(s.size)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[valid[best]], "score": s[best]}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})


def _wave(index: Index, queries: DataFrame, number: int, top: int, n_queries: int) -> DataFrame:
    plan = index.plan()
    spark = queries.sparkSession
    groups = max(1, -(-n_queries // BLOCK))
    visits = arrow_rows(queries, _visits, "id long, dim int, v array<long>, at array<int>", plan, top, number)
    visits = visits.select("id", "dim", "v", F.explode("at").alias("at"))
    rings = spark.createDataFrame([(d, r.pivot, r.ring, i, max(1, -(-r.n // BLOCK))) for d, own in index.rings.items()
                                   for i, r in enumerate(own)], "dim int, pivot int, ring int, at int, blocks int")
    small = F.broadcast(rings)  # at most PIVOTS * RINGS rows for each vector length
    group = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")
    asked = (visits.join(small, ["dim", "at"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("dim", "at", "block", group.alias("part"), "id", "v"))
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")
    held = (index.keyed.join(small, ["dim", "pivot", "ring"]).withColumn("block", block)
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("dim", "at", "block", "part", "id", "v"))
    keys = ["dim", "at", "block", "part"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(
        lambda key, a, b: _search(key, a, b, top), "query_id long, vec_id long, score long")
    return best(found, top)


def best(found: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: Index, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` highest scores of each query (id, dim, v)."""
    once = queries.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v")
    once = stored(once.withColumn("kth", F.lit(None).cast("long")))
    n = once.count()
    first = stored(_wave(index, once, 1, top, n))
    kth = first.filter(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    second = _wave(index, once.drop("kth").join(kth, "id", "left"), 2, top, n)
    return best(first.drop("rank").unionByName(second.drop("rank")), top).select("query_id", "rank", "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(scaled(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search(Index(vectors), vectors.filter(F.col("id") % EVERY == 0).select("id", "dim", "v"))


def op7_sql() -> str:
    return f"""
        WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id != c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM scored QUALIFY rank <= {TOP}"""
