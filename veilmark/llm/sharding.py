"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities; a flow of least cost from old to
new says how many bytes go where (keeping a byte costs nothing, moving one costs 1, or
what a cost matrix says). The flow is then carried out with blocks: a document larger
than ``unit`` is a block of its own, smaller ones share blocks of about ``unit`` bytes
dealt by hash. Block sizes are the only thing the driver sees, at most
``2 * PARTS * shards + shards`` of them, whatever the corpus.

A null text has no bytes and counts 8, like an empty one. Repeated rows are rows like any other.
An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import read, salted_rank, stored

SHARDS, PARTS, ROW_BYTES = 24, 500, 8


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Flow {(old, new): bytes} of least cost that ships every supply, by successive shortest paths."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost; edge i ^ 1 runs back
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(edges))
            edges.append([y, r, p])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
        for j in range(m):
            add(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        add(n + j, sink, c, 0)
    while True:
        best, by, queue = {source: 0}, {}, [source]
        while queue:
            a = queue.pop(0)
            for e in out[a]:
                b, room, price = edges[e]
                if room and best[a] + price < best.get(b, 1 << 60):
                    best[b], by[b] = best[a] + price, e
                    if b not in queue:
                        queue.append(b)
        if sink not in best:
            break
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = edges[by[at] ^ 1][0]
        moved = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= moved
            edges[e ^ 1][1] += moved
    flow = {}
    for i in range(n):
        for e in out[i]:
            if e % 2 == 0 and edges[e ^ 1][1]:
                flow[i, edges[e][0] - n] = edges[e ^ 1][1]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def place_blocks(blocks: list[tuple[int, str, int]], capacity: list[int], cost: list[list[int]] | None = None
                 ) -> list[int]:
    """The new shard of each block (old shard, id, bytes): the flow, carried out largest block first.

    Blocks rarely fit the flow to the byte, so at the end single blocks go from the fullest shard
    to the emptiest while that brings the two closer.
    """
    old_bytes: dict[int, int] = defaultdict(int)
    for old, _, size in blocks:
        old_bytes[old] += size
    olds = sorted(old_bytes)
    cost = cost or [[int(o != j) for j in range(len(capacity))] for o in olds]
    left: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), amount in min_cost_flow([old_bytes[o] for o in olds], capacity, cost).items():
        left[olds[i]][j] = amount
    new, load = [0] * len(blocks), [-c for c in capacity]
    for k in sorted(range(len(blocks)), key=lambda k: (-blocks[k][2], blocks[k][:2])):
        old, _, size = blocks[k]
        rest = left[old]
        j = max(rest, key=lambda j: (rest[j], j == old, -j)) if rest else min(range(len(load)), key=load.__getitem__)
        rest[j] = rest.get(j, 0) - size
        new[k], load[j] = j, load[j] + size
    held: list[list[tuple[int, int]]] = [[] for _ in capacity]
    for k, j in enumerate(new):
        bisect.insort(held[j], (blocks[k][2], k))
    for _ in range(20 * len(capacity) * len(capacity)):
        high, low = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
        gap = load[high] - load[low]
        at = bisect.bisect_left(held[high], (gap // 2 + 1, -1))
        near = [held[high][i] for i in (at - 1, at) if 0 <= i < len(held[high]) and 0 < held[high][i][0] < gap]
        if not near:
            break
        size, k = min(near, key=lambda x: (abs(2 * x[0] - gap), x))
        held[high].remove((size, k))
        bisect.insort(held[low], (size, k))
        load[high], load[low], new[k] = load[high] - size, load[low] + size, low
    return new


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def placed(rows: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """Add ``shard`` to rows of (doc_id, size, text_crc32, old_shard, ...); ``rows`` is read several times."""
    spark = rows.sparkSession
    totals = {r.old_shard: r.bytes for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    total = sum(totals.values())
    unit = max(1, total // (shards * parts))
    deal = F.create_map(*[F.lit(x) for o, b in totals.items() for x in (o, max(1, b // unit))]) if totals else F.lit(None)
    key = F.xxhash64("doc_id", "text_crc32", "size")
    blocks = (F.when(F.col("size") > unit, F.concat(F.lit("d"), key.cast("string")))
              .otherwise(F.concat(F.lit("b"), F.pmod(key, F.element_at(deal, F.col("old_shard"))).cast("string"))))
    rows = rows.withColumn("_block", blocks if totals else F.lit(""))
    sizes = rows.groupBy("old_shard", "_block").agg(F.sum("size").alias("bytes")).collect()
    sizes = sorted((r.old_shard, r._block, r.bytes) for r in sizes)
    homes = place_blocks(sizes, equal_capacities(total, shards))
    moves = spark.createDataFrame([(o, b, j) for (o, b, _), j in zip(sizes, homes, strict=True)],
                                  "old_shard int, _block string, shard int")
    return rows.join(F.broadcast(moves), ["old_shard", "_block"]).drop("_block")  # at most 2 * parts * shards + shards rows


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``slot``, the place of a row in its shard."""
    return salted_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", buckets=1024)


def reshard(rows: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows of (doc_id, size, text_crc32, old_shard)."""
    return numbered(placed(rows, shards, parts))


def old_layout(source: Column, shards: int = SHARDS) -> Column:
    """The layout before: whole sources in shards, dealt by the checksum of their name."""
    return F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def sized(docs: DataFrame, old_shard: Column, *keep: Column) -> DataFrame:
    text = F.col("text")
    return stored(docs.select("doc_id", text_size(text).alias("size"),
                              F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                              old_shard.alias("old_shard"), *keep))


def rewrite(docs: DataFrame, old_shard: Column, folder: str, shards: int = SHARDS) -> DataFrame:
    """Reshard ``docs`` and write the shards whose content changes, as ``folder/shard=N`` with a column ``slot``; gives the shards written.

    Every row is carried with its place, so null and repeated ids keep all their rows. A shard that keeps all its rows and receives none has no new file.
    The columns ``shard`` and ``slot`` are new; a document's own columns of these names are written as ``shard_`` and ``slot_``.
    """
    names = [c + "_" if c in ("shard", "slot") else c for c in docs.columns]
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    rows = stored(placed(sized(docs, old_shard, row.alias("row")), shards))
    moved = rows.filter("shard != old_shard")
    changed = moved.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    out = numbered(stored(rows.join(F.broadcast(changed), "shard")))  # at most one row per shard
    out.select("row.*", "shard", "slot").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.mode(
        "overwrite").partitionBy("shard").parquet(folder)
    return changed


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return reshard(sized(docs, old_layout(F.col("source")))).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
