"""Preparing spans for an external sentence scorer, and applying its scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import exact_round, let, lookup, one_of, slice_blocks, strip


def sentence_of(blocks: Column, start: Column, end: Column) -> Column:
    """The sentence around a span: up to the nearest ``. ! ?`` or newline on each
    side within 300 characters, the closing mark included; else the 300-character
    edge. ``blocks`` are the :func:`text_blocks` of the text."""
    reach = fixed.SENTENCE_REACH
    left = F.regexp_extract(slice_blocks(blocks, start - reach, start), r"[^.!?\n]*\z", 0)
    right = F.regexp_extract(slice_blocks(blocks, end, end + reach), r"^[^.!?\n]*[.!?\n]?", 0)
    return strip(F.concat(left, slice_blocks(blocks, start, end), right))


def needs_verification(entity_type: Column, confidence: Column, sentence: Column) -> Column:
    return (one_of(entity_type, list(fixed.HYPOTHESES)) & (confidence < fixed.VERIFY_BELOW)
            & (F.length(sentence) >= fixed.VERIFY_MIN_SENTENCE))


def hypothesis(entity_type: Column) -> Column:
    return lookup(fixed.HYPOTHESES, entity_type)


def verifier_verdict(score: Column) -> Column:
    return (F.when(score < 0.35, F.lit("rejects")).when(score < 0.50, F.lit("uncertain"))
            .when(score >= 0.70, F.lit("confirms")).when(score.isNotNull(), F.lit("neutral")))


def verified_confidence(confidence: Column, score: Column) -> Column:
    """Confidence after the verifier; unchanged without a score."""
    raised = F.least(F.lit(1.0), confidence * (F.lit(1.0) + (score - F.lit(0.70)) * F.lit(0.3)))
    moved = (F.when(score < 0.35, confidence * F.lit(0.15)).when(score < 0.50, confidence * F.lit(0.40))
             .when(score >= 0.70, raised))
    return let(moved, lambda m: F.when(m.isNull(), confidence).otherwise(exact_round(m, 4)))


def verifier_note(score: Column) -> Column:
    shown = F.format_string("%.2f", exact_round(score, 2))
    return F.concat(F.lit("transformer_"), verifier_verdict(score), F.lit(":pii="), shown)
