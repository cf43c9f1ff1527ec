"""Records of CSV files that are read in splits, with line breaks inside quotes.

Whether a line begins inside quotes depends on all lines before it in its file, so a file with quoted line breaks is usually read by one task.
Here a file is read in its splits twice. The first pass tells of each split in which state it ends, for either state it may begin in; chained along the
file, that gives the state at the start of every split. The second pass cuts records, knowing where its splits begin; a record that crosses a border
comes in fragments, and only fragments are brought together.

A quote opens a quoted part only at the start of a field, as readers of such files have it: ``5" pipe`` is a field like any other. A doubled quote stands
for one. Records end with ``\\n`` or ``\\r\\n``, blank lines between records are no records, and line breaks inside quotes are kept as they are.
A quote that is never closed takes the rest of its file into one record, which is marked as not ``closed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_START, _FIELD, _QUOTED, _CLOSING = range(4)
_AFTER_QUOTE = {_START: _QUOTED, _FIELD: _FIELD, _QUOTED: _CLOSING}


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a quoted part is open at the end of a line that begins inside one or at the start of a record."""
    if '"' not in line:
        return inside
    pieces = line.split('"')
    state, last = _QUOTED if inside else _START, len(pieces) - 1
    for i, piece in enumerate(pieces):
        if state == _CLOSING and not piece and i < last:
            state = _QUOTED  # a doubled quote
            continue
        if state != _QUOTED and piece:
            state = _START if piece.endswith(delimiter) else _FIELD
        if i < last:
            state = _AFTER_QUOTE[state]
    return state == _QUOTED


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _transitions(delimiter: str):
    """Per split: whether it ends inside quotes when it begins outside, and when it begins inside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[bool]] = {}  # the splits of one task
        for path, split, line in _rows_of(batches):
            state = ends.setdefault((path, split), [False, True])
            if '"' in line:
                state[:] = [ends_inside(line, s, delimiter) for s in state]
        yield pa.RecordBatch.from_pylist([{"path": p, "split": s, "outside": e[0], "inside": e[1]} for (p, s), e in ends.items()],
                                         pa.schema([("path", pa.string()), ("split", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())]))
    return run


def split_starts(transitions: DataFrame) -> DataFrame:
    """``(path, split)`` of the splits that begin inside quotes.

    A split either ends the same way however it begins, or hands the state on, turned or not: the state at a split's start is that
    of the last split of the first kind before it, turned once for each turning split since.
    """
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("outside") & ~F.col("inside")
    settled = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("state"), F.col("turned")))
    counted = transitions.withColumn("turned", F.sum(turns.cast("int")).over(Window.partitionBy("path").orderBy("split")))
    known = counted.select("*", F.last(settled, ignorenulls=True).over(before).alias("known"),
                           F.coalesce(F.lag("turned").over(Window.partitionBy("path").orderBy("split")), F.lit(0)).alias("so_far"))
    state = F.coalesce(F.col("known.state"), F.lit(False)) != ((F.col("so_far") - F.coalesce("known.turned", F.lit(0))) % 2 == 1)
    return known.filter(state).select("path", "split")


def _cut(starts: set[tuple[str, int]], delimiter: str):
    """Records of a split, and the fragments of those it shares: ``tail`` at its start, ``head`` at its end, ``middle`` where it has neither end."""
    names = ["path", "split", "kind", "first", "text"]
    kinds = pa.schema([("path", pa.string()), ("split", pa.int64()), ("kind", pa.string()), ("first", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            at, inside, lines, tail, first = None, False, [], False, False

            def unfinished() -> Iterator[tuple]:
                if lines:
                    yield (*at, "middle" if tail else "head", first, "\n".join(lines))

            for path, split, line in _rows_of(batches):
                if (path, split) != at:
                    yield from unfinished()
                    at, lines, first = (path, split), [], split == 0
                    inside = tail = at in starts
                lines.append(line)
                inside = ends_inside(line, inside, delimiter)
                if not inside:
                    text = "\n".join(lines).removesuffix("\r")
                    if tail or text.strip():
                        yield (*at, "tail" if tail else "record", first, text)
                        first = False
                    lines, tail = [], False
            yield from unfinished()

        part = []
        for row in records():
            part.append(row)
            if len(part) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], kinds)
                part = []
        if part:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], kinds)
    return run


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(path, first, record, closed)``: the records of all files under ``path``; ``first`` marks the first of a file, its header."""
    lines = _lines(spark, path)
    transitions = lines.mapInArrow(_transitions(delimiter), "path string, split bigint, outside boolean, inside boolean")
    # one pair for each split that begins inside quotes, a part of the list of splits by which the driver hands out the tasks
    starts = {(r.path, r.split) for r in split_starts(transitions).collect()}
    pieces = lines.mapInArrow(_cut(starts, delimiter), "path string, split bigint, kind string, first boolean, text string")
    whole = pieces.filter("kind = 'record'").select("path", "first", F.col("text").alias("record"), F.lit(True).alias("closed"))
    if not starts:
        open_ended = pieces.filter("kind != 'record'").select("path", "first", F.col("text").alias("record"), F.lit(False).alias("closed"))
        return whole.unionAll(open_ended)
    order = Window.partitionBy("path").orderBy("split", F.col("kind") == "head")
    shared = pieces.filter("kind != 'record'").withColumn(
        "begun", F.last(F.when(F.col("kind") == "head", F.col("split")), ignorenulls=True).over(order))
    joined = shared.groupBy("path", "begun").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("split", "text"))).alias("parts"),
        F.max(F.col("kind") == "tail").alias("closed"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return whole.unionAll(joined.select("path", "first", text.alias("record"), "closed"))
