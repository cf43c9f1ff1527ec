"""Document-level recalibration of accepted spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import constant, exact_round, let


def pairs_present(types: Column) -> Column:
    """The constant type pairs whose both members are in ``types``."""
    pairs = constant([{"a": a, "b": b, "boost": boost} for a, b, boost in fixed.PAIR_BOOSTS])
    present = F.filter(pairs, lambda p: F.array_contains(types, p["a"]) & F.array_contains(types, p["b"]))
    return F.when(F.size(types) > 1, present).otherwise(F.slice(pairs, 1, 0))


def pair_boost(entity_type: Column, present: Column) -> Column:
    """Sum of the boosts of all present pairs this type belongs to."""
    mine = F.filter(present, lambda p: (p["a"] == entity_type) | (p["b"] == entity_type))
    return F.aggregate(mine, F.lit(0.0), lambda total, p: total + p["boost"])


def frequency_factor(count: Column) -> Column:
    return F.when(count > fixed.FREQUENT_OVER, F.lit(fixed.FREQUENT_FACTOR)).otherwise(F.lit(1.0))


def recalibrated(confidence: Column, boost: Column, count: Column) -> Column:
    boosted = F.least(F.lit(1.0), confidence + boost)
    return exact_round(F.least(F.lit(1.0), boosted * frequency_factor(count)), 4)


def type_counts(spans: Column) -> Column:
    """``map<type, count>`` of an array of spans."""
    types = F.transform(spans, lambda d: d["entity_type"])
    counted = let(types, lambda ts: F.map_from_entries(F.transform(F.array_distinct(ts), lambda t: F.struct(
        t.alias("t"), F.size(F.filter(ts, lambda u: u == t)).cast("long").alias("n")))))
    return F.when(F.size(spans) == 1, F.create_map(spans[0]["entity_type"], F.lit(1).cast("long"))).otherwise(counted)


def recalibrate(spans: Column) -> Column:
    """Pair boosts, then the boost for types seen more than three times."""
    def facts(all_spans: Column) -> Column:
        return let(type_counts(all_spans), lambda counts: F.struct(
            all_spans.alias("spans"), counts.alias("counts"),
            pairs_present(F.map_keys(counts)).alias("pairs")))

    def apply(f: Column) -> Column:
        return F.transform(f["spans"], lambda d: d.withField("confidence", recalibrated(
            d["confidence"], pair_boost(d["entity_type"], f["pairs"]),
            F.element_at(f["counts"], d["entity_type"]))))

    return let(spans, lambda all_spans: let(facts(all_spans), apply))
