"""Removal of long repeated strings with a logarithmic family of suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it starts at some other place too, in any document. Suffixes are entered sparsely and without loss:

1. Anchors. Of the ``LENGTH - GRAM + 1`` strings of ``GRAM`` bytes inside a window of ``LENGTH`` bytes, the one with the smallest hash (the leftmost of
   equals) is the window's anchor. Equal windows have their anchor at the same place, so windows need comparing only with windows of an equal anchor string.
   The windows of one anchor are neighbours; together they are a cell.
2. Cells whose anchor string occurs once hold no repeat. Of equal cells all windows repeat, and one of them stands for all.
3. Suffix arrays. Where different cells share an anchor string, the suffixes at all their windows are entered into suffix arrays, ordered by
   their first ``LENGTH`` bytes. Cells come in ``BATCHES`` batches: a batch is sorted into an array of its own, neighbours that agree
   in all those bytes repeat; it is merge-scanned against every existing level, which finds the repeats between old and new; then
   it becomes a level, and levels of equal size are merged, geometrically. Anchor strings with up to ``TOGETHER`` different cells share a task
   with others; for those with more, a string that a large part of the corpus has, the same decision is made by counting window hashes in a
   shuffle, so that no task holds them all.

Hashes are of 64 bits. Null text is empty, as is the text of a removed whole; a text under ``LENGTH`` bytes keeps everything. Repeated rows repeat each other. Matches
never cross documents. An empty table gives an empty result, other columns are left alone. Long texts are read in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import arrow_rows, bytes_of, read, stored
from veilmark.llm.hashing import mixed, prefix_sums, window_hashes

LENGTH, GRAM, BATCHES, TOGETHER, PART = 400, 200, 4, 256, 1 << 19
_SPAN = LENGTH - GRAM + 1
_LOW = np.uint64((1 << 20) - 1)


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, anchor hash, cell hash) of each cell of a text."""
    out = []
    for at in range(0, len(text) - LENGTH + 1, PART):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, PART + LENGTH - 1), at)
        sums = prefix_sums(data)
        starts = np.arange(data.size - GRAM + 1)
        gram = window_hashes(sums, starts, starts + GRAM)
        keys = (gram & ~_LOW) | starts.astype(np.uint64)
        windows = data.size - LENGTH + 1
        rows = np.full(-(-keys.size // _SPAN) * _SPAN + _SPAN, ~np.uint64(0))
        rows[:keys.size] = keys
        rows = rows.reshape(-1, _SPAN)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:windows], ahead[_SPAN - 1:_SPAN - 1 + windows]) & _LOW).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [windows - 1]])
        place = place[first]
        shape = mixed(((place - first) * 1024 + (place - last)).astype(np.uint64))
        cell = mixed(window_hashes(sums, first, last + LENGTH) ^ shape)
        out.append((place + at, first + at, last + at, gram[place], cell))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in "qqqQQ")


def _key():
    return F.xxhash64("doc_id", "text").alias("k")


def _anchor_hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [anchors(t or b"")[3] for t in bytes_of(batch.column(0))]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["g"])


def _cells(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [anchors(t or b"") for t in bytes_of(batch.column(1))]
    owner = np.repeat(np.arange(len(found)), [f[0].size for f in found])
    place, first, last, gram, cell = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(owner)), pa.array(place), pa.array((place - last).astype(np.int16)), pa.array((place - first).astype(np.int16)),
         pa.array(gram.view(np.int64)), pa.array(cell.view(np.int64))], ["k", "p", "low", "high", "g", "c"])


class Level:
    """A suffix array: windows in the order of their bytes, with their numbers; ``batches`` is its size."""

    def __init__(self, windows: np.ndarray, numbers: np.ndarray, batches: int = 1) -> None:
        order = np.argsort(windows, kind="stable")  # of two sorted runs: one merge
        self.windows, self.numbers, self.batches = windows[order], numbers[order], batches

    def inner_repeats(self, found: np.ndarray) -> None:
        same = self.windows[1:] == self.windows[:-1]
        found[self.numbers[1:][same]] = found[self.numbers[:-1][same]] = True

    def scan(self, new: Level, found: np.ndarray) -> None:
        """Mark what this level and a new one share."""
        left = np.searchsorted(self.windows, new.windows, "left")
        right = np.searchsorted(self.windows, new.windows, "right")
        shared = right > left
        found[new.numbers[shared]] = True
        covered = np.zeros(self.windows.size + 1, np.int64)
        np.add.at(covered, left[shared], 1)
        np.add.at(covered, right[shared], -1)
        found[self.numbers[np.cumsum(covered[:-1]) > 0]] = True

    def merged(self, other: Level) -> Level:
        return Level(np.concatenate([self.windows, other.windows]), np.concatenate([self.numbers, other.numbers]),
                     self.batches + other.batches)


def repeated_windows(cells: list[bytes], batch_of: list[int], length: int = LENGTH) -> np.ndarray:
    """Which windows (of all cells, in order) have bytes that another window has: the family of suffix arrays at work."""
    counts = [len(c) - length + 1 for c in cells]
    starts = np.concatenate([[0], np.cumsum(counts)])
    found, levels = np.zeros(int(starts[-1]), bool), []
    for b in sorted(set(batch_of)):
        own = [i for i, x in enumerate(batch_of) if x == b]
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(cells[i], np.uint8), length) for i in own])
        numbers = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
        new = Level(np.ascontiguousarray(windows).view(f"S{length}").ravel(), numbers)
        new.inner_repeats(found)
        for level in levels:
            level.scan(new, found)
        while levels and levels[-1].batches == new.batches:
            new = levels.pop().merged(new)
        levels.append(new)
    return found


def _search(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    found = repeated_windows([r["bytes"] for r in rows], [r["c"] % BATCHES for r in rows])
    out, at = [], 0
    for r in rows:  # the windows of a cell go from the highest offset of the anchor to the lowest
        n = r["high"] - r["low"] + 1
        if r["n"] == 1:
            step = np.diff(np.concatenate([[0], found[at:at + n].astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                out.append((r["g"], r["c"], r["high"] - int(b) + 1, r["high"] - int(a)))
        at += n
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int16()] * 2, strict=True)],
                    names=["g", "c", "low", "high"])


def _bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Bytes of the wanted cells of each text."""
    out = []
    for text, wanted in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
        out += [(w["g"], w["c"], w["n"], w["m"], w["low"], w["high"], text[w["p"] - w["high"]:w["p"] - w["low"] + LENGTH]) for w in wanted]
    kinds = [pa.int64()] * 4 + [pa.int16()] * 2 + [pa.binary()]
    columns = list(zip(*out, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                      ["g", "c", "n", "m", "low", "high", "bytes"])


def _hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Hashes of the windows of each cell, by the offset of the anchor from ``low`` on."""
    out = []
    for cell in batch.column(5).to_pylist():
        starts = np.arange(len(cell) - LENGTH, -1, -1)
        out.append(window_hashes(prefix_sums(np.frombuffer(cell, np.uint8)), starts, starts + LENGTH).view(np.int64))
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.list_(pa.int64()))],
                                      ["g", "c", "n", "low", "h"])


def repeated_cells(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that may repeat (k, p, low, high, g, c), and the repeating windows (g, c, low, high) of equal cells."""
    text = docs.select("text")
    twice = arrow_rows(text, _anchor_hashes, "g long").groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    twice = stored(twice)  # so that a join with it can split an anchor string that a large part of the corpus has
    cells = arrow_rows(docs.select(_key(), "text"), _cells, "k long, p long, low short, high short, g long, c long")
    cells = stored(cells.join(twice, "g", "left_semi"))
    kinds = stored(cells.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "p", "low", "high")).alias("at")))
    groups = kinds.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("g", "m")
    wanted = kinds.join(groups, "g").select("at.k", F.struct("g", "c", "n", "m", "at.p", "at.low", "at.high").alias("w"))
    wanted = wanted.groupBy("k").agg(F.collect_list("w").alias("w"))  # no more than a text has cells
    found = docs.select(_key(), "text").join(wanted, "k").select("text", "w")
    edges = stored(arrow_rows(found, _bytes, "g long, c long, n long, m long, low short, high short, bytes binary")
                   .dropDuplicates(["g", "c"]))

    few = edges.filter(F.col("m") <= TOGETHER)
    packs = max(1, few.count() // TOGETHER)
    searched = few.withColumn("pack", F.pmod(F.xxhash64("g"), F.lit(packs))).groupBy("pack").applyInArrow(
        _search, "g long, c long, low short, high short")
    many = edges.filter(F.col("m") > TOGETHER).select("g", "c", "n", "low", "high", "bytes").repartition("g", "c")
    hashed = arrow_rows(many, _hashed, "g long, c long, n long, low short, h array<long>").select(
        "g", "c", "n", "low", F.posexplode("h").alias("i", "h"))
    hashed = stored(hashed)
    seen = hashed.groupBy("g", "h").agg(F.count("*").alias("s")).filter("s > 1").select("g", "h")
    offset = (F.col("low") + F.col("i")).cast("short")
    counted = hashed.filter("n = 1").join(seen, ["g", "h"], "left_semi").select("g", "c", offset.alias("low"), offset.alias("high"))
    whole = kinds.filter("n > 1").select("g", "c", "at.low", "at.high")
    return cells, whole.unionByName(searched).unionByName(counted)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k, spans): byte ranges to remove from the text with key k, unmerged and unordered."""
    cells, windows = repeated_cells(docs)
    windows = windows.select("g", "c", F.col("low").alias("from"), F.col("high").alias("to"))
    spans = cells.join(windows, ["g", "c"]).select(
        "k", F.struct((F.col("p") - F.col("to")).alias("start"), (F.col("p") - F.col("from") + LENGTH).alias("end")).alias("s"))
    return spans.groupBy("k").agg(F.collect_set("s").alias("spans"))  # no more than a text has windows


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)], strict=True))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, text): the maximal removed byte ranges, the bytes that are left, and the text they make.

    A cut may go through a character of several bytes; ``text`` leaves out the pieces of such a character, ``kept`` has them.
    """
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = bytes_of(batch.column(1)), [merged_spans(s) for s in batch.column(2).to_pylist()]
        kept = [kept_bytes(t or b"", s) for t, s in zip(texts, spans, strict=True)]
        ranges = [[{"start": a, "end": b} for a, b in s] for s in spans]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(ranges, kind),
                                           pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                                          ["doc_id", "n_bytes", "spans", "kept", "text"])

    docs = docs.select("doc_id", "text")
    rows = docs.withColumn("k", _key()).join(repeated_spans(docs), "k", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(rows, cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, text string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), "text")
