"""Sensitivity of one span and risk of one document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .confidence import type_counts
from .text import constant, exact_round, first_level, let, lookup, one_of


def _weight(profile: tuple[float, ...]) -> float:
    total = 0.0
    for share, factor in zip(fixed.PROFILE_SHARES, profile):
        total += share * factor
    return total * 100


WEIGHTS = {name: _weight(profile) for name, profile in fixed.RISK_PROFILE.items()}
DEFAULT_WEIGHT = _weight(fixed.DEFAULT_PROFILE)


def risk_weight(entity_type: Column) -> Column:
    return F.coalesce(lookup(WEIGHTS, entity_type), F.lit(DEFAULT_WEIGHT))


def sensitivity_level(score: Column) -> Column:
    return first_level(score, fixed.SENSITIVITY_FLOORS)


def policy(level: Column) -> Column:
    return lookup(fixed.LEVEL_STRATEGY, level)


def risk_level(score: Column) -> Column:
    return first_level(score, fixed.RISK_FLOORS)


def classify_entity(span: Column) -> Column:
    """The span with weight, effective score, level and strategy added."""
    def with_level(b: Column) -> Column:
        return let(sensitivity_level(b["score"]), lambda level: span
                   .withField("sensitivity_weight", b["weight"])
                   .withField("effective_score", exact_round(b["score"], 2))
                   .withField("sensitivity_level", level)
                   .withField("anonymization_strategy", policy(level)))

    return let(risk_weight(span["entity_type"]), lambda w: let(
        F.struct(w.alias("weight"), (w * span["confidence"]).alias("score")), with_level))


def classify_entities(spans: Column) -> Column:
    return F.transform(spans, classify_entity)


def total_risk(classified: Column) -> Column:
    return F.aggregate(classified, F.lit(0.0), lambda t, d: t + d["sensitivity_weight"] * d["confidence"])


def mean_risk(total: Column, count: Column) -> Column:
    """Risk relative to the highest possible one, 0-100; 0 for an empty document."""
    highest = (count * 100).cast("double")
    return F.when(count > 0, total / highest * F.lit(100.0)).otherwise(F.lit(0.0))


def high_risk_types(classified: Column) -> Column:
    serious = F.filter(classified, lambda d: one_of(d["sensitivity_level"], ["CRITICAL", "HIGH"]))
    return F.array_sort(F.array_distinct(F.transform(serious, lambda d: d["entity_type"])))


def recommendations(level: Column, types: Column) -> Column:
    """One line for the level and one per listed type that is present."""
    lines = [lookup(fixed.LEVEL_ADVICE, level)]
    lines += [F.when(F.array_contains(types, t), F.lit(line)) for t, line in fixed.TYPE_ADVICE.items()]
    return F.filter(F.array(*lines), lambda line: line.isNotNull())


def classify_document(classified: Column) -> Column:
    """Risk summary of a document's classified spans; empty documents get their own row."""
    def summary(f: Column) -> Column:
        return F.struct(
            F.when(f["n"] > 0, exact_round(f["total"], 2)).alias("absolute_risk_score"),
            exact_round(f["score"], 2).alias("risk_score"),
            risk_level(f["score"]).alias("risk_level"),
            f["n"].alias("entity_count"), f["counts"].alias("entity_breakdown"),
            high_risk_types(f["spans"]).alias("high_risk_entities"),
            F.when(f["n"] > 0, recommendations(risk_level(f["score"]), F.map_keys(f["counts"])))
            .otherwise(constant([fixed.NO_PII_ADVICE])).alias("recommendations"))

    def facts(spans: Column) -> Column:
        total, count = total_risk(spans), F.size(spans).cast("long")
        return let(F.struct(total.alias("total"), count.alias("n")), lambda b: F.struct(
            spans.alias("spans"), b["total"].alias("total"), b["n"].alias("n"),
            mean_risk(b["total"], b["n"]).alias("score"), type_counts(spans).alias("counts")))

    return let(classified, lambda spans: let(facts(spans), summary))


def no_risk() -> Column:
    """What :func:`classify_document` gives for a document without accepted spans; a constant."""
    zero = F.lit(0.0)
    return F.struct(
        F.lit(None).cast("double").alias("absolute_risk_score"), zero.alias("risk_score"), risk_level(zero).alias("risk_level"),
        F.lit(0).cast("long").alias("entity_count"), F.create_map().cast("map<string,bigint>").alias("entity_breakdown"),
        F.array().cast("array<string>").alias("high_risk_entities"), constant([fixed.NO_PII_ADVICE]).alias("recommendations"))
