"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct shingles of five words. Equal sets are one node. A node has a signature of ``SYMBOLS`` b-bit minimums, and two
nodes with a Jaccard similarity of 0.85 or more differ in more than ``DIFFER`` of them with a probability below 1 in 10,000. Signatures
are split into ``CHUNKS`` chunks, so two that differ in at most ``DIFFER`` symbols differ in at most ``DIFFER // CHUNKS`` = 1 in some chunk
(pigeonhole). Similarity, symbols and chunks are a :class:`Law`: op10 has these, the pipeline's stage links from 0.80 on (``STAGE``): every chunk is entered once for each of its symbols left out. All pairs under the signature threshold share an entry.

Entries are joined without making all pairs of a bucket:

1. Stars. Each bucket names a leader by hash, each node is compared with the closest of its leaders, confirmed on full sets, and
   confirmed links are joined into classes.
2. Rest. Buckets whose nodes are in several classes are searched for pairs of different classes: all but the largest class against all,
   in blocks of ``BLOCK`` rows. A pair is looked at in the first bucket it shares and must pass the signature threshold; then the nodes
   left bring their full sets, and the pairs of a node with a class are confirmed, closest first, until one is. Further links between two
   nodes that are joined by then change no class and need no confirmation.

A document without words (null, empty) has no shingles and is linked with nothing. Repeated rows are copies of one set. Rows with a null id take part with
the smallest other id of their class. An empty table gives an empty result, other columns are left alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import arrow_rows, bytes_of, fresh, read, stored
from veilmark.llm.hashing import mixed, shingle_set

SYMBOLS, CHUNKS, DIFFER, PERCENT, BLOCK, SEED = 32, 7, 13, 85, 1024, 11
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


class Law(NamedTuple):
    """Percent of similarity from which nodes are linked, and how many symbols in how many chunks may differ: less than two a chunk."""

    percent: int = PERCENT
    differ: int = DIFFER
    chunks: int = CHUNKS


OP10, STAGE = Law(), Law(80, 16, 9)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit symbols of a non-empty set."""
    least = np.full(SYMBOLS, ~np.uint64(0))
    for i in range(0, shingles.size, 8192):
        np.minimum(least, (shingles[i:i + 8192, None] * _TIMES + _PLUS).min(0), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2")


def entries(signatures: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """Keys (signature, entry): of every chunk, what is left when one symbol is left out."""
    out = np.empty((len(signatures), SYMBOLS), np.uint64)
    for number, chunk in enumerate(c.tolist() for c in np.array_split(np.arange(SYMBOLS), chunks)):
        for gone in chunk:
            key = np.full(len(signatures), number * 64 + gone + 1, np.uint64)
            for at in chunk:
                if at != gone:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, at].astype(np.uint64))
            out[:, gone] = key
    return out


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    size, one, two, sign = [], [], [], []
    for text in bytes_of(batch.column(2)):
        s = shingle_set(text)
        size.append(s.size)
        one.append(int(mixed(s).sum().view(np.int64)) if s.size else None)
        two.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if s.size else None)
        sign.append(signature(s).tobytes() if s.size else None)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
         pa.array(sign, pa.binary())], ["doc_id", "row", "n_shingles", "node", "check", "sign"])


def row_key() -> Column:
    """A row by its id and text, never null."""
    return F.xxhash64("doc_id", "text").alias("row")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, node, check, sign): node and check are two hashes of the set, null when it is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(docs.select("doc_id", row_key(), "text"), _sets,
                      f"doc_id {kind}, row long, n_shingles long, node long, check long, sign binary")


def _entered(batch: pa.RecordBatch, chunks: int) -> pa.RecordBatch:
    keys = entries(np.stack([np.frombuffer(s, "<u2") for s in batch.column(1).to_pylist()]), chunks).view(np.int64)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * SYMBOLS, pa.int32()), pa.array(keys.ravel()))
    return pa.RecordBatch.from_arrays([batch.column(0), flat], ["node", "keys"])


def _full_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [(s.size, s.astype("<u8").tobytes()) for s in map(shingle_set, bytes_of(batch.column(1)))]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()),
                                       pa.array([b for _, b in rows], pa.binary())], ["node", "n", "shingles"])


def similar(m: int, n: int, one: bytes, two: bytes, percent: int = PERCENT) -> bool:
    """Whether two full sets of m and n shingles, sorted 64-bit hashes, are similar enough."""
    s, t = np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")
    shared = int((t[np.minimum(np.searchsorted(t, s), t.size - 1)] == s).sum())
    return 100 * shared >= percent * (int(m) + int(n) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        keep = [similar(*x, percent) for x in zip(*(column[c].to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True)]
        return pa.RecordBatch.from_arrays([column["a"], column["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_rows(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b"), test, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link: label is the smallest node of its component.

    Alternates large-star and small-star steps, in which each node sends its neighbours to the smallest of them,
    until nothing changes. Each step is two shuffles with sums combined before them.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        return joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))

    edges, before = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        edges = stored(star(star(edges, True).distinct(), False).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = state


def _pairs(key: np.ndarray, slot: np.ndarray, side: np.ndarray, label: np.ndarray, n: np.ndarray, signs: np.ndarray,
           law: Law = OP10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of different classes, one of each side of a bucket, that are close, and how far they are.

    A pair counts in the first bucket it shares only. Sizes must allow the similarity.
    """
    order = np.lexsort((side, slot, key))
    new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(slot[order]) != 0)])
    start = np.flatnonzero(new)
    end, group = np.append(start[1:], order.size), np.cumsum(new) - 1
    lefts = np.add.reduceat((side[order] == 0).astype(np.int64), start)
    left = np.flatnonzero(side[order] == 0)
    first, count = (start + lefts)[group[left]], (end - start - lefts)[group[left]]
    keys, out, parts = entries(signs, law.chunks), [], np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1, 1 << 18))
    for low, high in zip(parts, [*parts[1:], left.size], strict=True):
        c = count[low:high]
        if not c.sum():
            continue
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        i, j = order[np.repeat(left[low:high], c)], order[np.repeat(first[low:high], c) + at]
        able = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= law.percent * np.maximum(n[i], n[j]))
        i, j = i[able], j[able]
        far = (signs[i] != signs[j]).sum(1)
        i, j, far = i[far <= law.differ], j[far <= law.differ], far[far <= law.differ]
        shared = (keys[i] == keys[j]).argmax(1)
        here = np.take_along_axis(keys[i], shared[:, None], 1)[:, 0].view(np.int64) == key[i]
        out.append((i[here], j[here], far[here]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _pairs_of(table: pa.Table, law: Law) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    signs = np.stack([np.frombuffer(s, "<u2") for s in table.column("sign").to_pylist()])
    return _pairs(*(table.column(c).to_numpy() for c in ("key", "slot", "side", "label", "n")), signs, law)


def _close_rows(table: pa.Table, law: Law) -> pa.Table:
    """The rows of packed buckets that are in a close pair."""
    i, j, _ = _pairs_of(table, law)
    return table.select(["key", "slot", "side", "node", "label", "n", "sign"]).take(pa.array(np.unique(np.concatenate([i, j]))))


def _new_links(table: pa.Table, law: Law) -> pa.Table:
    """Confirmed pairs (a, b) of different classes: one at least of each node with each class it has a link to in its bucket."""
    i, j, far = _pairs_of(table, law)
    node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
    sets, out, done = table.column("shingles").to_pylist(), [], set()
    for k in np.lexsort((far, i)):
        a, b = int(i[k]), int(j[k])
        if (a, label[b]) not in done and similar(n[a], n[b], sets[a], sets[b], law.percent):
            done.add((a, label[b]))
            out.append((node[a], node[b]))
    columns = list(zip(*out, strict=True)) or [[]] * 2
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def remaining(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, law: Law = OP10) -> DataFrame:
    """(a, b): confirmed links between different classes, enough to join all classes that a link joins.

    Only nodes that are close to one of another class bring their sets.
    """
    held = _labelled(members, labels)
    of_class = held.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed_keys = of_class.groupBy("key").agg(F.count("*").alias("classes"), F.sum("c").alias("total"),
                                             F.max(F.struct("c", "label")).alias("most")).filter("classes > 1")
    mixed_keys = mixed_keys.select("key", "total", F.col("most.label").alias("major"), (F.col("total") - F.col("most.c")).alias("few"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    deal = F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 30))
    rows = held.join(mixed_keys, "key").withColumn("all", blocks("total")).withColumn("minor", blocks("few"))
    right = rows.withColumn("i", F.pmod(deal, F.col("all"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("minor") - 1)))
    left = rows.filter("label != major").withColumn("j", F.pmod(deal, F.col("minor"))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    dealt = stored(right.withColumn("side", F.lit(1)).unionByName(left.withColumn("side", F.lit(0))).select(
        "key", (F.col("i") * F.col("minor") + F.col("j")).cast("long").alias("slot"), "side", "node", "label"))
    kind = "key long, slot long, side int, node long, label long, n long, sign binary"
    close = stored(_packed(dealt.join(nodes.select("node", "n", "sign"), "node"), dealt.count()).applyInArrow(lambda t: _close_rows(t, law), kind))
    return _packed(close.join(sets.select("node", "shingles"), "node"), close.count()).applyInArrow(lambda t: _new_links(t, law), "a long, b long")


def _packed(rows: DataFrame, count: int):
    """Whole buckets in packs of some thousand rows."""
    return rows.groupBy(F.pmod(F.xxhash64("key", "slot"), F.lit(max(1, count // 4096))).alias("pack"))


def classes(nodes: DataFrame, docs: DataFrame, law: Law = OP10) -> DataFrame:
    """(node, label) of the nodes linked with another; ``nodes`` is stored (node, check, doc_id, row, n, sign); ``row`` is of one member."""
    keyed = arrow_rows(nodes.select("node", "sign"), _entered, "node long, keys array<long>", law.chunks).select("node", F.explode("keys").alias("key"))
    turned = F.col("node").bitwiseXOR(F.xxhash64("key"))  # so that each bucket has a leader of its own
    buckets = keyed.groupBy("key").agg(F.min(turned).alias("low"), F.max(turned).alias("high")).filter("low != high")
    members = stored(keyed.join(buckets.select("key", F.col("low").bitwiseXOR(F.xxhash64("key")).alias("leader")), "key"))

    wanted = members.select("node").distinct().join(nodes.select("node", "row"), "node")
    found = docs.select(row_key(), "text").join(wanted, "row").select("node", "text")
    sets = stored(arrow_rows(found, _full_sets, "node long, n long, shingles binary").dropDuplicates(["node"]))

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (np.stack([np.frombuffer(s, "<u2") for s in batch.column(i).to_pylist()]) for i in (2, 3))
        far = (one != two).sum(1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.int64())], ["a", "b", "far"])

    signs = nodes.select("node", "sign")
    stars = members.filter("node != leader").select("node", "leader").distinct()
    stars = stars.join(signs, "node").join(signs.select(F.col("node").alias("leader"), F.col("sign").alias("other")), "leader")
    stars = arrow_rows(stars.select("node", "leader", "sign", "other"), close, "a long, b long, far long").filter(F.col("far") <= law.differ)
    stars = stored(stars.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
    links = stored(confirmed(stars, sets, law.percent))
    labels = stored(components(links))
    more = stored(remaining(members, labels, nodes, sets, law))
    return labels if more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, law: Law = OP10) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) of (doc_id, text); ``row`` is :func:`row_key`."""
    docs = docs.select("doc_id", "text")
    rows = stored(sketches(docs))
    nodes = stored(rows.filter("node is not null").groupBy("node", "check").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.min("sign").alias("sign"), F.min("n_shingles").alias("n")))
    labels = classes(nodes, docs, law)
    of_node = nodes.join(labels, "node", "left").select("node", "check", "doc_id", F.coalesce("label", "node").alias("label"))
    least = of_node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = of_node.join(least, "label").select("node", "check", "component_id")
    out = rows.join(of_node, ["node", "check"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("row")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, with its columns; of repeated rows one stays."""
    name = fresh(docs, "row")
    kept = near_duplicates(docs, STAGE).filter("kept").select(F.col("row").alias(name)).distinct()
    return docs.withColumn(name, row_key()).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
