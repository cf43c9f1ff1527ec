"""Spans as rows: the table form of what the document row holds in arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import context, fuse, verify
from ..functions import fixed_values as fixed
from ..functions.text import exploded, let, lookup, text_blocks


def explode_spans(df: DataFrame, spans: str, *keep: str) -> DataFrame:
    """One row per element of the array column ``spans`` with its ``ordinal``."""
    return exploded(df, spans, "doc_id", *keep).select("doc_id", *keep, "ordinal", "d.*")


def with_surroundings(df: DataFrame) -> DataFrame:
    """Fused spans as rows, with the pieces of text the context rules look at.

    The pieces are cut while the text is at hand, so later steps carry a few
    hundred characters per span and never the document.
    """
    cut = let(text_blocks(F.col("clean_text")), lambda blocks: F.transform(
        F.col("detected")["fused"], lambda d: context.surroundings(d, blocks)))
    flagged = df.select("*", context.has_structured(F.col("detected")["fused"]).alias("structured"))
    rows = exploded(flagged, cut, "doc_id", "structured", element="c")
    before = F.right(F.col("c.prefix"), F.lit(fixed.VERSION_PREFIX_CHARS))
    return rows.select("doc_id", "structured", "ordinal", "c.d.*", "c.window", "c.prefix", "c.following",
                       before.alias("before"))


def verification_requests(df: DataFrame) -> DataFrame:
    """``(sentence, hypothesis, counter_hypothesis)`` rows for an external sentence scorer."""
    cut = let(text_blocks(F.col("clean_text")), lambda blocks: F.transform(
        F.col("judged")["accepted"], lambda d: F.struct(
            d["entity_type"].alias("entity_type"), d["start"].alias("start"), d["end"].alias("end"),
            d["confidence"].alias("confidence"), verify.sentence_of(blocks, d["start"], d["end"]).alias("sentence"))))
    rows = exploded(df, cut, "doc_id", element="c").select("doc_id", "c.*")
    wanted = rows.filter(verify.needs_verification(F.col("entity_type"), F.col("confidence"), F.col("sentence")))
    return wanted.select(
        "doc_id", "entity_type", "start", "end", "confidence", "sentence",
        lookup(fixed.HYPOTHESES, F.col("entity_type")).alias("hypothesis"),
        F.lit(fixed.COUNTER_HYPOTHESIS).alias("counter_hypothesis"))


def apply_verifier_scores(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """Rescore span rows by a table of verifier scores; unscored spans pass unchanged.

    Joined on the whole span key, so even a document with very many spans
    spreads over all tasks.
    """
    keys = ["doc_id", "entity_type", "start", "end"]
    joined = entities.join(scores.select(*keys, "pii_score"), keys, "left")
    return joined.withColumn(
        "verifier_note", verify.verifier_note(F.col("pii_score"))).withColumn(
        "confidence", verify.verified_confidence(F.col("confidence"), F.col("pii_score")))


def overlap_pairs(df: DataFrame, spans: str) -> DataFrame:
    """Overlapping span pairs of one document with their intersection over union; a sweep on the row, no join."""
    return exploded(df, fuse.overlapping_pairs(F.col(spans)), "doc_id", position="pair").select("doc_id", "d.*")
