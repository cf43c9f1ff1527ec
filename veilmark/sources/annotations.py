"""Spans and scores that come from models run elsewhere."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import exact_round, lookup, strip

COLUMNS = ["doc_id", "entity_type", "value", "start", "end", "confidence", "source"]


def normalize_transformer(annotations: DataFrame) -> DataFrame:
    """Map labels of a transformer tagger to identifier types, drop weak and unmapped ones."""
    kind, score = lookup(fixed.TRANSFORMER_LABELS, F.col("label")), F.col("score")
    strong = annotations.filter(kind.isNotNull() & (score >= fixed.TRANSFORMER_MIN_SCORE))
    return strong.select("doc_id", kind.alias("entity_type"), strip(F.col("text")).alias("value"), "start", "end",
                         exact_round(score, 4).alias("confidence"), F.lit("transformer").alias("source"))


def normalize_ner(annotations: DataFrame) -> DataFrame:
    """Map labels of a NER tagger without scores; one constant confidence."""
    kind = lookup(fixed.NER_LABELS, F.col("label"))
    return annotations.filter(kind.isNotNull()).select(
        "doc_id", kind.alias("entity_type"), strip(F.col("text")).alias("value"), "start", "end",
        F.lit(fixed.NER_CONFIDENCE).alias("confidence"), F.lit("spacy").alias("source"))


def read_annotations(annotations: DataFrame) -> DataFrame:
    """Route raw annotations ``(doc_id, label, text, start, end, score, source)`` to their rules."""
    return normalize_transformer(annotations.filter(F.col("source") == "transformer")).unionByName(
        normalize_ner(annotations.filter(F.col("source") == "spacy")))


def _gathered(rows: DataFrame, item: Column, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias(name))


def _attach(docs: DataFrame, lists: DataFrame) -> DataFrame:
    # No hint: texts are wide and lists narrow, so the planner broadcasts the lists
    # while they are small and otherwise joins by key, one list per document.
    return docs.join(lists, "doc_id", "left")


def annotation_lists(normalized: DataFrame) -> DataFrame:
    """``(doc_id, annotations)``: each document's external spans in order of place."""
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "entity_type",
                    "value", "confidence", "source")
    ordered = F.transform(F.col("listed"), lambda d: F.struct(
        *[d[c].alias(c) for c in ("entity_type", "value", "start", "end", "confidence", "source")]))
    return _gathered(normalized, span, "listed").select("doc_id", ordered.alias("annotations"))


def score_lists(scores: DataFrame) -> DataFrame:
    """``(doc_id, scores)``: each document's verifier scores."""
    item = F.struct("entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                    "pii_score")
    return _gathered(scores, item, "scores")


def attach_annotations(docs: DataFrame, normalized: DataFrame) -> DataFrame:
    """Put each document's external spans on its row, as ``annotations``; see ``colocated`` for a corpus that is kept."""
    return _attach(docs, annotation_lists(normalized))


def attach_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Put each document's verifier scores on its row, as ``scores``."""
    return _attach(docs, score_lists(scores))


@lru_cache(maxsize=8)
def _chunks_of_words(max_chars: int) -> Callable[..., Column]:
    """Arrow function from long texts to their chunks; one pass over the words of a text."""
    overlap = fixed.CHUNK_OVERLAP_WORDS

    def bounds(ends: list[int]) -> list[tuple[int, int]]:
        """First word and end of each chunk; ``ends[k]`` is the joined length of the words before ``k``, a space after each."""
        count, first, least, found = len(ends) - 1, 0, 0, []
        while True:
            # the first word that no longer fits is the end; every chunk but the first has one word more than it repeats
            end = min(max(bisect_right(ends, ends[first] + max_chars + 1, first + 1) - 1, least), count)
            found.append((first, end))
            if end == count:
                return found
            first, least = max(first, end - overlap), end + 1

    def starts(text: str, words: list[str], ends: list[int], firsts: list[int]) -> list[int]:
        if len(text) == ends[-1] - 1:  # one character between words: places are those in the joined words
            return [ends[k] for k in firsts]
        places = [0] * len(words)
        at = 0
        for k, word in enumerate(words):  # the next word begins at the first character that is not space, so nothing else is found before it
            places[k] = at = text.index(word, at)
            at += len(word)
        return [places[k] for k in firsts]

    @F.arrow_udf("array<struct<chunk:string,start:int>>")
    def chunks(texts: pa.Array) -> pa.Array:
        pieces, places, offsets, missing = [], [], [0], []
        for value in texts:
            text = value.as_py()
            missing.append(text is None)
            words = [] if text is None else text.split()  # splits at the characters of SPACE (tested)
            if words:
                ends = [0, *accumulate(len(w) + 1 for w in words)]
                cuts = bounds(ends)
                pieces += [" ".join(words[a:z]) for a, z in cuts]
                begun = starts(text, words, ends, [a for a, _ in cuts])
                places += [at if z > a else 0 for at, (a, z) in zip(begun, cuts)]
            elif text is not None:
                pieces.append("")
                places.append(0)
            offsets.append(len(pieces))
        items = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(places, pa.int32())], ["chunk", "start"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=pa.array(missing, pa.bool_()))

    return chunks


def chunk_text(text: Column, max_chars: int = fixed.CHUNK_CHARS) -> Column:
    """Cut a text for an external scorer: ``array<struct<chunk, start>>``.

    Words are packed greedily; each next chunk repeats the last ten words. A
    short text is one chunk as it is and stays in the JVM. ``start`` is the true
    offset of the chunk's first word. Work is linear in the words; a fold over
    them, interpreted, took some 40 microseconds for each.
    """
    whole = F.array(F.struct(text.alias("chunk"), F.lit(0).alias("start")))
    long_text = F.when(F.length(text) > max_chars, F.make_valid_utf8(text))
    return F.when(F.length(text) <= max_chars, whole).otherwise(_chunks_of_words(max_chars)(long_text))
