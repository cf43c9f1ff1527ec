"""Hard-negative mining by a vertical scan of the dimensions, branch and bound (BOND).

Vectors lie in blocks of about ``CELLS`` components, stored by column: one row per (block, dimension) with the values of all vectors of the block
and their smallest and largest, and one row each for ids and labels. A block meets a group of ``GROUP`` anchors in one task. For every anchor:

* dimensions are read in the order of its falling magnitudes, ``STEP`` at a time, and the partial inner products grow;
* what is left lies between the sums of the smallest and of the largest contributions that the unread dimensions can make, which gives every
  candidate a lower and an upper bound;
* the bitmap of candidates loses all that can no longer count; when the dimensions are all read, the scores of those left are exact.

Two scans. In the first, candidates are the rows with the anchor's label, and those whose upper bound is below the k-th lower bound go; the best of all blocks
are the positives. In the second, candidates are the rows with other labels, and every positive has a window of scores [low % of its score, high % of it]:
a candidate goes when it can reach no window, or when in each window that it can reach there are enough candidates that are sure to lie inside and
sure to score higher. Ranks over all blocks follow. A block gives at most ``positives`` rows an anchor, then ``negatives`` rows a positive.

Rows with a null id, a null label or a vector that is null, empty or has null or non-finite components take no part. Of rows with one id one takes part, the
one with the smallest label, then vector. Only vectors of one length are compared. Equal scores go to the smaller id. Fewer positives or negatives than asked give
fewer rows, an anchor without positives gives none, an empty table gives an empty result. Scores are 64-bit integers. Other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilmark.llm.common import read, stored

SCALE, CELLS, GROUP, STEP = 256, 1 << 21, 2048, 8
POSITIVES, NEGATIVES, LOW, HIGH, EVERY, RELABEL, LABELS = 5, 10, 30, 90, 100, 7, 10
_IDS, _LABELS = -1, -2


def labelled(rows: DataFrame, ident: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v) with ``v = floor(scale * x)``, usable rows only."""
    x = F.col(vector)
    usable = (F.col(ident).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0)
              & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    return rows.filter(usable).select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                                      F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("long")).alias("v"))


def _columns(table: pa.Table) -> pa.Table:
    """The rows of one block (dim, block, id, label, v) by column, in the order of ids."""
    table = table.sort_by("id")
    dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
    v = table.column("v").combine_chunks()
    v = (v.flatten() if isinstance(v, pa.ListArray) else pa.concat_arrays([c.flatten() for c in v.chunks])).to_numpy().reshape(-1, dim)
    values = [table.column("label").to_numpy(), table.column("id").to_numpy(), *np.ascontiguousarray(v.T)]
    return pa.table([pa.array([dim] * len(values), pa.int32()), pa.array([block] * len(values), pa.int32()),
                     pa.array(range(_LABELS, dim), pa.int32()), pa.array(values, pa.list_(pa.int64())),
                     pa.array([int(c.min()) for c in values], pa.int64()), pa.array([int(c.max()) for c in values], pa.int64())],
                    names=["dim", "block", "j", "values", "low", "high"])


class Vertical:
    """The vectors by column in blocks; ``rows`` keeps them by row, for anchors."""

    def __init__(self, vectors: DataFrame, cells: int = CELLS) -> None:
        once = vectors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
        self.rows = stored(once.select("id", "label", F.size("v").alias("dim"), "v"))
        total = self.rows.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
        self.blocks = max(1, -(-total // cells))
        block = F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int").alias("block")
        self.columns = stored(self.rows.select("dim", block, "id", "label", "v").groupBy("dim", "block").applyInArrow(
            _columns, "dim int, block int, j int, values array<long>, low long, high long"))


class Block:
    """One block as a task reads it."""

    def __init__(self, table: pa.Table) -> None:
        rows = {r["j"]: r for r in table.to_pylist()}
        self.dim = len(rows) - 2
        self.ids, self.labels = np.array(rows[_IDS]["values"], np.int64), np.array(rows[_LABELS]["values"], np.int64)
        self.columns = np.array([rows[j]["values"] for j in range(self.dim)], np.int64)
        self.low, self.high = (np.array([rows[j][side] for j in range(self.dim)], np.int64) for side in ("low", "high"))
        self.cells = 0  # components read so far


def bond(block: Block, query: np.ndarray, alive: np.ndarray, stays, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the candidates of the bitmap ``alive`` that ``stays(lower, upper, rows)`` keeps to the end."""
    order = np.argsort(-np.abs(query), kind="stable")
    ends = np.sort([query * block.low, query * block.high], 0)[:, order]
    least, most = (np.append(np.cumsum(side[::-1])[::-1], 0) for side in ends)
    rows = np.flatnonzero(alive)
    score = np.zeros(rows.size, np.int64)
    for at in range(0, block.dim, step):
        if not rows.size:
            break
        for j in order[at:at + step]:
            score += query[j] * (block.columns[j] if rows.size == alive.size else block.columns[j][rows])
        done = min(at + step, block.dim)
        block.cells += rows.size * (done - at)
        keep = stays(score + least[done], score + most[done], rows)
        alive[rows[~keep]] = False
        rows, score = np.flatnonzero(alive), score[keep]
    return rows, score


def _kth(values: np.ndarray, k: int):
    """The k-th largest, None if there are fewer."""
    return np.partition(values, values.size - k)[values.size - k] if values.size >= k else None


def nearest_in_block(block: Block, query: np.ndarray, ident: int, label: int, k: int) -> list[tuple[int, int]]:
    """The ``k`` best (id, score) of the rows with this label but for the anchor's own."""
    def stays(lower: np.ndarray, upper: np.ndarray, _rows: np.ndarray) -> np.ndarray:
        kth = _kth(lower, k)
        return np.ones(lower.size, bool) if kth is None else upper >= kth

    rows, score = bond(block, query, (block.labels == label) & (block.ids != ident), stays)
    best = np.lexsort((block.ids[rows], -score))[:k]
    return list(zip(block.ids[rows[best]].tolist(), score[best].tolist(), strict=True))


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The scores s with ``low * score <= 100 * s <= high * score``."""
    return -((-low * score) // 100), (high * score) // 100


def negatives_in_block(block: Block, query: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window the ``k`` best (id, score) of the rows with another label whose score lies in it."""
    def stays(lower: np.ndarray, upper: np.ndarray, _rows: np.ndarray) -> np.ndarray:
        keep = np.zeros(lower.size, bool)
        for low, high in windows:
            kth = _kth(lower[(lower >= low) & (upper <= high)], k)  # the k-th of those that are sure to lie inside
            keep |= (upper >= (low if kth is None else kth)) & (lower <= high)
        return keep

    rows, score = bond(block, query, block.labels != label, stays)
    out = []
    for low, high in windows:
        inside = np.flatnonzero((score >= low) & (score <= high))
        best = inside[np.lexsort((block.ids[rows[inside]], -score[inside]))[:k]]
        out.append(list(zip(block.ids[rows[best]].tolist(), score[best].tolist(), strict=True)))
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _positives(anchors: pa.Table, columns: pa.Table, k: int) -> pa.Table:
    out = []
    if anchors.num_rows and columns.num_rows:
        block = Block(columns)
        for r in anchors.to_pylist():
            out += [(r["id"], *found) for found in nearest_in_block(block, np.array(r["v"], np.int64), r["id"], r["label"], k)]
    return _table(out, ["anchor_id", "positive_id", "score"])


def _negatives(anchors: pa.Table, columns: pa.Table, k: int, low: int, high: int) -> pa.Table:
    out = []
    if anchors.num_rows and columns.num_rows:
        block = Block(columns)
        for r in anchors.to_pylist():
            windows = sorted({window(p["score"], low, high) for p in r["positives"]})
            found = dict(zip(windows, negatives_in_block(block, np.array(r["v"], np.int64), r["label"], windows, k), strict=True))
            out += [(r["id"], p["positive_id"], p["score"], *n) for p in r["positives"] for n in found[window(p["score"], low, high)]]
    return _table(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _met(vertical: Vertical, anchors: DataFrame, groups: int, work, schema: str) -> DataFrame:
    """``work(anchors of a group, columns of a block)`` for every group and every block of the same vector length."""
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("part")
    asked = anchors.select("*", part, F.explode(F.sequence(F.lit(0), F.lit(vertical.blocks - 1))).alias("block"))
    held = vertical.columns.join(anchors.select("dim").distinct(), "dim", "left_semi").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["dim", "block", "part"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(work, schema)


def _first(rows: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc(score), ident)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vertical: Vertical, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors (id, label, dim, v), rows of ``vertical``."""
    anchors = stored(anchors)
    groups = max(1, -(-anchors.count() // group))
    near = _met(vertical, anchors, groups, lambda a, b: _positives(a, b, positives), "anchor_id long, positive_id long, score long")
    near = stored(_first(near, ["anchor_id"], "score", "positive_id", positives).drop("rank"))
    wanted = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))  # few, see above
    asked = anchors.join(wanted, anchors["id"] == wanted["anchor_id"]).drop("anchor_id")
    found = _met(vertical, asked, groups, lambda a, b: _negatives(a, b, negatives, low, high),
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    moved = F.when(F.col("id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vertical = Vertical(rows.withColumn("label", moved))
    return mine(vertical, vertical.rows.filter(F.col("id") % EVERY == 0))


def op12_sql() -> str:
    return f"""
        WITH whole AS (SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
            FROM whole a JOIN whole c ON a.vec_id != c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % {EVERY} = 0),
        positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN scored USING (anchor_id)
        WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
