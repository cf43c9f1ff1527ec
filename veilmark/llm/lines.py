"""Removal of lines that many documents have, through a sharded minimal perfect hash.

1. Count. Every document gives the 128-bit hashes of its distinct line keys; a batch of documents adds up its own before the shuffle, so a
   line that every document has arrives once per batch. The sum is the number of documents (rows) with the key.
2. Index. The distinct hashes found in at least ``FLOOR`` documents (a line of one document repeats nowhere) are dealt to shards of about
   ``PER_SHARD``. In a shard a minimal perfect hash gives every line a slot of its own: on each level a key falls on one of two bits a key,
   a bit met by one key alone is set and is the key's, the others go to the next level; the number of set bits before it is the slot.
   Two compact arrays stand behind the slots: a fingerprint of 8 bytes (the second half of the hash) and the count, one byte, cut off at 255.
3. Probe. A document hashes its lines again and looks them up. A line that is not in the index either finds no bit or fails on the
   fingerprint; with 8 bytes a foreign line passes once in 2 ** 64. The count against ``least`` decides.

The arrays are broadcast while they take ``BROADCAST`` bytes at most, which is checked: documents then probe in place and nothing of a text is shuffled.
Beyond that size the line hashes travel to their shards, cogrouped with the arrays, and the numbers of the lines that go travel back;
a shard with many lines is dealt to several copies of its arrays by document. Both ways give the same rows (tested).

Null or empty text is one empty line; an empty key is never counted and its line stays. A text whose lines all go is empty. Repeated rows are documents
of their own. Lines of any length and texts of any number of lines are whole. An empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import arrow_rows, bytes_of, read, stored
from veilmark.llm.hashing import mixed

LEAST, FLOOR, PER_SHARD, BROADCAST, PROBES, MOST = 10, 2, 1 << 18, 64 << 20, 1 << 20, 255
BLANK = b" \t\n\x0b\x0c\r"
_SHARD = "shard int, n long, lines long, sizes array<long>, words binary, ranks binary, prints binary, counts binary"


def line_keys(text: bytes | None) -> list[bytes]:
    return [line.strip(BLANK).lower() for line in (text or b"").split(b"\n")]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _count_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(a, b, n): documents of this batch with each key."""
    seen: Counter[bytes] = Counter()
    for text in bytes_of(batch.column(0)):
        seen.update({xxhash.xxh3_128_digest(k) for k in line_keys(text) if k})
    a, b = _halves(list(seen))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(list(seen.values()), pa.int64())],
                                      ["a", "b", "n"])


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(a ^ mixed(b + np.uint64(level))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct pairs (a, b), and the lookup of any pairs."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> None:
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        left, bits, sizes = np.arange(a.size), [], []
        while left.size:
            size = -(-2 * left.size // 64) * 64
            place = _places(a[left], b[left], len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            left = left[~alone[place]]
        words = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little").view(np.uint64)
        counts = np.bitwise_count(words).astype(np.uint32)
        return cls(np.array(sizes, np.int64), words, np.cumsum(counts, dtype=np.uint32) - counts)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where no level has a bit for it. Only a pair of the set is sure to have its own."""
        out, left, base = np.full(a.size, -1, np.int64), np.arange(a.size), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = base + _places(a[left], b[left], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = self.ranks[place[hit] >> 6].astype(np.int64) + before[hit]
            left, base = left[~hit], base + size
        return out


def _build(table: pa.Table) -> pa.Table:
    """One row: the perfect hash of a shard and the arrays behind it."""
    shard, a, b, n = (table.column(c).to_numpy() for c in ("shard", "a", "b", "n"))
    a, b = a.view(np.uint64), b.view(np.uint64)
    perfect = PerfectHash.of(a, b)
    slot = perfect.slots(a, b)
    prints, counts = np.empty(a.size, np.uint64), np.empty(a.size, np.uint8)
    prints[slot], counts[slot] = b, np.minimum(n, MOST)
    row = {"shard": int(shard[0]), "n": a.size, "lines": int(n.sum()), "sizes": perfect.sizes.tolist(), "words": perfect.words.tobytes(),
           "ranks": perfect.ranks.tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes()}
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 4
    return pa.table([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))


def counts_of(row: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Documents (up to ``MOST``) with each pair of hashes by one shard's arrays, 0 for a pair that is not there."""
    perfect = PerfectHash(np.array(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64), np.frombuffer(row["ranks"], np.uint32))
    slot = perfect.slots(a, b)
    own = (slot >= 0) & (np.frombuffer(row["prints"], np.uint64)[slot] == b)
    return np.where(own, np.frombuffer(row["counts"], np.uint8)[slot], 0)


class LineIndex:
    """Shards with the counts of all lines of ``docs`` (column text) that at least ``floor`` documents have."""

    def __init__(self, docs: DataFrame, floor: int = FLOOR, per_shard: int = PER_SHARD) -> None:
        counted = arrow_rows(docs.select("text"), _count_keys, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        keys = stored(counted.filter(F.col("n") >= floor))
        self.floor, self.keys = floor, keys.count()
        self.shards = max(1, -(-self.keys // per_shard))
        shard = F.pmod("a", F.lit(self.shards)).cast("int").alias("shard")
        self.rows = stored(keys.select(shard, "a", "b", "n").groupBy("shard").applyInArrow(_build, _SHARD))
        sizes = F.sum(sum(F.octet_length(c) for c in ("words", "ranks", "prints", "counts")))
        self.size = self.rows.agg(sizes).first()[0] or 0


def _cut(texts: list[bytes | None], goes: list[np.ndarray]) -> tuple[list, list, list]:
    kept, total, dropped = [], [], []
    for text, gone in zip(texts, goes, strict=True):
        lines = (text or b"").split(b"\n")
        total.append(len(lines))
        dropped.append(int(gone.sum()))
        kept.append(b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g) if dropped[-1] else text or b"")
    return total, dropped, kept


def _hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Hashes of all lines of some texts, which keys are not empty, and the number of lines of each text."""
    keys = [line_keys(t) for t in texts]
    a, b = _halves([xxhash.xxh3_128_digest(k) for own in keys for k in own])
    return a, b, np.array([bool(k) for own in keys for k in own], bool), [len(own) for own in keys]


def _probe_here(batch: pa.RecordBatch, index, shards: int, least: int) -> pa.RecordBatch:
    rows = {r["shard"]: r for r in index.value}
    texts = bytes_of(batch.column(1))
    a, b, full, lengths = _hashed(texts)
    shard, found = a.view(np.int64) % shards, np.zeros(a.size, np.int64)
    for s, row in rows.items():
        at = np.flatnonzero(full & (shard == s))
        found[at] = counts_of(row, a[at], b[at])
    total, dropped, kept = _cut(texts, np.split(found >= least, np.cumsum(lengths)[:-1]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())],
                                      ["doc_id", "n_lines", "n_dropped", "kept"])


def _sent(batch: pa.RecordBatch, shards: int) -> pa.RecordBatch:
    """(k, k2, shard, line, a, b) of every line with a key."""
    a, b, full, lengths = _hashed(bytes_of(batch.column(2)))
    owner = pa.array(np.repeat(np.arange(len(lengths)), lengths)[full])
    line = np.concatenate([np.arange(n) for n in lengths])[full]
    shard = (a.view(np.int64) % shards).astype(np.int32)[full]
    return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(shard), pa.array(line.astype(np.int64)),
                                       pa.array(a.view(np.int64)[full]), pa.array(b.view(np.int64)[full])], ["k", "k2", "shard", "line", "a", "b"])


def _answer(lines: pa.Table, arrays: pa.Table, least: int) -> pa.Table:
    lines = lines.select(["k", "k2", "line", "a", "b"])
    if lines.num_rows and arrays.num_rows:
        row = arrays.to_pylist()[0]
        a, b = (lines.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        lines = lines.filter(pa.array(counts_of(row, a, b) >= least))
    else:
        lines = lines.slice(0, 0)
    return lines.select(["k", "k2", "line"])


def _probe_there(docs: DataFrame, index: LineIndex, least: int, probes: int) -> DataFrame:
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))
    copies = index.rows.select("shard", F.ceil(F.col("lines") / probes).cast("int").alias("copies"))
    arrays = (index.rows.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"))
    sent = arrow_rows(keyed.select("k", "k2", "text"), _sent, "k long, k2 long, shard int, line long, a long, b long", index.shards)
    sent = sent.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("k", "line"), "copies").cast("int")).drop("copies")
    goes = sent.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInArrow(
        lambda left, right: _answer(left, right, least), "k long, k2 long, line long")
    goes = goes.groupBy("k", "k2").agg(F.collect_set("line").alias("goes"))  # no more than a text has lines

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = bytes_of(batch.column(1)), []
        for text, numbers in zip(texts, batch.column(2).to_pylist(), strict=True):
            gone = np.zeros((text or b"").count(b"\n") + 1, bool)
            gone[numbers or []] = True
            out.append(gone)
        total, dropped, kept = _cut(texts, out)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
                                           pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

    rows = keyed.join(goes, ["k", "k2"], "left").select("doc_id", "text", "goes")
    return arrow_rows(rows, cut, _schema(docs))


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept binary"


def without_common_lines(docs: DataFrame, least: int = LEAST, index: LineIndex | None = None, broadcast: int = BROADCAST,
                         probes: int = PROBES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document without the lines that ``least`` documents have.

    ``index`` may be one built before, from other documents too, as long as its floor is not above ``least`` (255 at most).
    """
    if not 1 <= least <= MOST:
        raise ValueError(f"least must be from 1 to {MOST}")
    index = index or LineIndex(docs, min(FLOOR, least))
    if index.floor > least:
        raise ValueError("the index leaves out lines that this threshold needs")
    docs = docs.select("doc_id", "text")
    if index.size <= broadcast:
        shared = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.rows.collect()])  # at most ``broadcast`` bytes
        out = arrow_rows(docs, _probe_here, _schema(docs), shared, index.shards, least)
    else:
        out = _probe_there(docs, index, least, probes)
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("text"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_common_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_sql() -> str:
    blank = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH whole AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM whole),
        keyed AS (SELECT *, translate(trim(line, {blank}), '{upper}', '{upper.lower()}') AS key FROM line),
        common AS (SELECT key, true AS goes FROM keyed WHERE key != '' GROUP BY key HAVING count(DISTINCT r) >= {LEAST})
        SELECT doc_id, count(*) AS n_lines, count(goes) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE goes IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common USING (key) GROUP BY r, doc_id"""
