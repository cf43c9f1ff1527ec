"""Best-fit packing with a linear grouping scheme.

Documents become token ids ended by id 0 and are cut into pieces of at most ``LENGTH`` tokens. All planning is done on the number of
pieces of each length, ``LENGTH`` counts whatever the corpus (:func:`plan`):

1. Large lengths are sorted, put into groups of equal cardinality and rounded up to the longest of their group.
2. Configurations of these few sizes are optimised as a linear program by column generation, the new column of each round being a
   knapsack; the solution is rounded down.
3. Pieces take the places of their group, longest first. Runs of sequences with the same real lengths stay together, so there
   are few of them however many sequences there are.
4. What is left, and all small lengths, go longest first into the fullest sequence that holds them.

Several numbers of groups are tried, the fewest sequences win. The plan gives runs of (length, first rank, sequence, offset);
pieces are ranked within their length and looked up there, so no sequence is built on the driver.

A null text is an empty document, of one token. Repeated rows are packed as often as they occur. An empty table gives an empty result.
Other columns are left alone.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import arrow_batches, arrow_rows, read, salted_rank, stored

LENGTH, SMALL, GROUPS = 2048, 600, (24, 48, 96)
VOCABULARY = "byte_bpe_50k.json"
CACHED, END, TOGETHER, BATCH = 300_000, bytes(4), 256, 1024


# --- tokens -----------------------------------------------------------------------------------------------------------------------

class Tokens:
    """Token ids as bytes (little-endian, 4 each), with a bounded cache of words.

    The tokenizer splits before a space that has no other white space beside it, so a text in which every space is such a
    one is the sequence of its words' tokens. Other texts, and those that hold an added token, are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes | None] = {}
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]  # how the tokenizer writes a space
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == space]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [array("I", e.ids).tobytes() for e in got]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space: many are encoded as one text and cut where a token begins with a space."""
        out = []
        runs = [words[at:at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for run, ids in zip(runs, self.encode([" " + " ".join(run) for run in runs]), strict=True):
            cuts = (4 * np.flatnonzero(self.spaced[np.frombuffer(ids, "<u4")])).tolist()
            if len(cuts) != len(run) or cuts[0]:
                out += self.encode([" " + w for w in run])
            else:
                out += [ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, ended by id 0."""
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known  # words after a space, by the word alone; None: white space beside white space
        whole = [any(a in (text or "") for a in self.added) for text in texts]
        split = [[""] if w else (text or "").split(" ") for text, w in zip(texts, whole, strict=True)]
        heads = [words.pop(0) for words in split]
        new = set().union(*split).difference(known)
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        known.update(dict.fromkeys(new))
        known.update(zip(plain, self.encode_words(plain), strict=True))
        word, out, odd = known.__getitem__, [], []
        for i, (words, ids) in enumerate(zip(split, self.encode(heads), strict=True)):
            parts = [ids, *map(word, words), END]
            if whole[i] or None in parts or heads[i] and heads[i][-1].isspace():
                odd.append(i)
                parts = []
            out.append(b"".join(parts))
        for i, ids in zip(odd, self.encode([texts[i] for i in odd]), strict=True):
            out[i] = ids + END
        return out


@lru_cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, keep_ids: bool = False, name: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with ``ids`` if wanted, of (doc_id, text).

    A document longer than ``length`` tokens is cut so that all pieces but the first are full.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, size, crc, own = [], [], [], [], [], []
        texts, step = batch.column(1), 256
        for first in range(0, len(texts), step):
            for i, ids in enumerate(tokens(vocabulary(name)).ids(texts.slice(first, step).to_pylist()), first):
                n = len(ids) // 4
                at, k = 0, 0
                end = n - (n - 1) // length * length
                while at < n:
                    part = ids[4 * at:4 * end]
                    row.append(i), piece.append(k), start.append(at), size.append(end - at), crc.append(zlib.crc32(part))
                    if keep_ids:
                        own.append(np.frombuffer(part, "<i4"))
                    at, end, k = end, end + length, k + 1
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return arrow_rows(docs.select("doc_id", "text"), work, schema + ", ids array<int>" * keep_ids)


def stored_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, stored. Texts travel ``BATCH`` rows at a time: a task holds one batch on either side of Python."""
    with arrow_batches(docs.sparkSession, BATCH):
        return stored(pieces(docs))


# --- the plan ---------------------------------------------------------------------------------------------------------------------

def rounded_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal cardinality of the lengths, longest first: (size, [(length, number)]); a length may be in several."""
    total = sum(counts.values())
    quota, out, own, room = -(-total // groups), [], [], -(-total // groups)
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            part = min(n, room)
            own.append((x, part))
            n, room = n - part, room - part
            if not room:
                out.append((own[0][0], own))
                own, room = [], quota
    if own:
        out.append((own[0][0], own))
    return out


def configurations(sizes: list[int], demand: list[int], length: int = LENGTH, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Configurations (number of each size) with how often each is used, demands not exceeded: a linear program, rounded down."""
    k = len(sizes)
    basis = np.diag([float(length // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.T @ np.ones(k)
        best, last = np.zeros(length + 1), np.full(length + 1, -1)
        for i, (s, p) in enumerate(zip(sizes, price, strict=True)):
            if p > 1e-12:
                for c in range(s, length + 1, s):  # a block depends on the block before only
                    with_it = best[c - s:min(c, length + 1 - s)] + p
                    part = best[c:c + with_it.size]
                    better = with_it > part + 1e-12
                    part[better] = with_it[better]
                    last[c:c + with_it.size][better] = i
        if best[length] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), length
        while last[c] >= 0:
            column[last[c]] += 1
            c -= sizes[last[c]]
        along, level = inverse @ column, inverse @ need
        ratio = [level[i] / along[i] if along[i] > 1e-9 else np.inf for i in range(k)]
        basis[:, int(np.argmin(ratio))] = column
    used = np.maximum(0, np.floor(np.linalg.solve(basis, need) + 1e-6)).astype(int)
    left, out = list(demand), []
    for j in np.argsort(-used):
        each = basis[:, j].astype(int)
        times = min([int(used[j])] + [left[i] // each[i] for i in range(k) if each[i]])
        if times > 0:
            left = [a - int(e) * times for a, e in zip(left, each, strict=True)]
            out.append((each.tolist(), times))
    return out


class Runs:
    """Sequences in runs of equal free space, and where each length's pieces go."""

    def __init__(self, length: int) -> None:
        self.length, self.sequences = length, 0
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space -> runs (first sequence, number)
        self.spaces: list[int] = []
        self.rank: dict[int, int] = defaultdict(int)
        self.out: list[tuple[int, int, int, int, int, int]] = []

    def put_back(self, space: int, first: int, n: int) -> None:
        if space not in self.free or not self.free[space]:
            bisect.insort(self.spaces, space)
        self.free[space].append((first, n))

    def place(self, x: int, first: int, n: int, each: int, offset: int) -> None:
        """``each`` pieces of length x in each of n sequences from ``first`` on, from ``offset`` on."""
        self.out.append((x, self.rank[x], n * each, first, each, offset))
        self.rank[x] += n * each

    def best_fit(self, x: int, n: int) -> None:
        while n:
            i = bisect.bisect_left(self.spaces, x)
            if i < len(self.spaces):
                space = self.spaces[i]
                first, have = self.free[space].pop()
                if not self.free[space]:
                    self.spaces.pop(i)
            else:
                space, first, have = self.length, self.sequences, -(-n // (self.length // x))
                self.sequences += have
            each = space // x
            full = min(have, n // each)
            if full:
                self.place(x, first, full, each, self.length - space)
                self.put_back(space - each * x, first, full)
                n -= full * each
            if full < have:
                if n:
                    self.place(x, first + full, 1, n, self.length - space)
                    self.put_back(space - n * x, first + full, 1)
                    full, n = full + 1, 0
                if full < have:
                    self.put_back(space, first + full, have - full)


def grouped(counts: dict[int, int], groups: int, length: int, small: int) -> Runs:
    runs = Runs(length)
    left = {x: n for x, n in counts.items() if n}
    large = {x: n for x, n in left.items() if small < x < length}
    if large:
        rounded = rounded_groups(large, groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for size, own in rounded:  # groups of one size are one demand
            merged.setdefault(size, []).extend(own)
        sizes = sorted(merged, reverse=True)
        demand = [sum(n for _, n in merged[s]) for s in sizes]
        supply = [list(merged[s]) for s in sizes]
        for each, times in configurations(sizes, demand, length):
            slots = [i for i, e in enumerate(each) for _ in range(e)]
            parts = [_take(supply[i], times) for i in slots]  # real lengths of each place, in runs
            cuts = sorted({0, *(end for p in parts for _, end in p)})
            at = [0] * len(slots)
            for low, high in zip(cuts, cuts[1:], strict=False):
                offset, first = 0, runs.sequences
                runs.sequences += high - low
                for s, part in enumerate(parts):
                    while part[at[s]][1] <= low:
                        at[s] += 1
                    x = part[at[s]][0]
                    runs.place(x, first, high - low, 1, offset)
                    left[x] -= high - low
                    offset += x
                runs.put_back(length - offset, first, high - low)
    for x in sorted(left, reverse=True):
        if left[x]:
            runs.best_fit(x, left[x])
    return runs


def _take(supply: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The next n pieces of a group as runs (length, end), longest first; ``supply`` loses them."""
    out, end = [], 0
    while end < n:
        x, have = supply[0]
        part = min(have, n - end)
        end += part
        out.append((x, end))
        if part == have:
            supply.pop(0)
        else:
            supply[0] = (x, have - part)
    return out


def plan(counts: dict[int, int], length: int = LENGTH, small: int = SMALL, groups: tuple[int, ...] = GROUPS) -> Runs:
    """The best of several groupings. ``out`` has rows (length, first rank, number, first sequence, pieces each, first offset)."""
    return min((grouped(counts, g, length, small) for g in groups), key=lambda r: r.sequences)


# --- packing ----------------------------------------------------------------------------------------------------------------------

def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to stored pieces (see :func:`pieces`)."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length
    runs = sorted(plan(counts, length).out)
    by: dict[int, list] = defaultdict(list)
    for x, rank, _, first, each, offset in runs:
        by[x].append((rank, first, each, offset))
    table = cut.sparkSession.createDataFrame(
        [(x, *(list(c) for c in zip(*rows, strict=True))) for x, rows in by.items()],
        "length long, _rank array<long>, _first array<long>, _each array<long>, _offset array<long>")
    ranked = salted_rank(cut, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "_at").join(
        F.broadcast(table), "length")  # at most one row per length, and some thousands of runs in all

    # the run of a rank is the last that starts at or before it
    run = F.expr("greatest(1, size(filter(_rank, r -> r <= _at)))")
    ranked = ranked.withColumn("_run", run)
    pick = lambda c: F.element_at(c, F.col("_run"))
    inside = F.col("_at") - pick("_rank")
    sequence = pick("_first") + F.floor(inside / pick("_each")).cast("long")
    offset = pick("_offset") + inside % pick("_each") * F.col("length")
    return ranked.withColumn("sequence_id", sequence.cast("long")).withColumn("offset", offset.cast("long")).drop(
        "_at", "_rank", "_first", "_each", "_offset", "_run")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored_pieces(read(spark, sf_dir, "documents")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places (see :func:`op2`)."""
    return pack(stored_pieces(docs))
