"""Fusion of spans from several detectors into one span per identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .detect import SPAN_TYPE, SPANS_TYPE, overlap_islands
from .text import exact_round, let, lookup, running


def overlap_length(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two spans, 0.0 when they do not overlap."""
    shared = overlap_length(a, b)
    union = (a["end"] - a["start"]) + (b["end"] - b["start"]) - shared
    return F.when(shared > 0, shared / union).otherwise(F.lit(0.0))


def overlapping_pairs(spans: Column) -> Column:
    """Overlapping pairs of an array of spans with their intersection over union, each pair once and in array order.

    A sweep: in the order of starts, a span overlaps those after it that start before it ends. How many
    start before each end comes from one sort of starts and ends together, so work follows the overlaps.
    """
    def counts(ordered: Column) -> Column:
        def event(at: Column, kind: int, j: Column) -> Column:
            return F.struct(at.alias("at"), F.lit(kind).alias("kind"), j.alias("j"))

        events = F.array_sort(F.concat(F.transform(ordered, lambda d, j: event(d["start"], 1, j)),
                                       F.transform(ordered, lambda d, j: event(d["end"], 0, j))))
        begun = let(events, lambda e: F.zip_with(e, running(F.transform(e, lambda x: x["kind"]), lambda a, b: a + b), lambda x, n: F.struct(
            x["j"].alias("j"), x["kind"].alias("kind"), n.alias("n"))))
        return F.transform(F.array_sort(F.filter(begun, lambda x: x["kind"] == 0)), lambda x: x["n"])

    def pair(a: Column, b: Column) -> Column:
        first, second = (F.when(a["i"] < b["i"], x).otherwise(y) for x, y in ((a, b), (b, a)))
        return F.struct(first["i"].alias("ordinal_a"), second["i"].alias("ordinal_b"), first["entity_type"].alias("type_a"),
                        second["entity_type"].alias("type_b"), iou(a, b).alias("iou"))

    def swept(b: Column) -> Column:
        def of(d: Column, j: Column) -> Column:
            others = F.slice(b["sorted"], j + 2, F.greatest(F.get(b["begun"], j) - j - 1, F.lit(0)))
            return F.transform(F.filter(others, lambda x: x["end"] > d["start"]), lambda x: pair(d, x))

        return F.flatten(F.transform(b["sorted"], of))

    ordered = F.array_sort(F.transform(spans, lambda d, i: F.struct(
        d["start"].alias("start"), i.alias("i"), d["end"].alias("end"), d["entity_type"].alias("entity_type"))))
    return let(ordered, lambda o: let(F.struct(o.alias("sorted"), counts(o).alias("begun")), swept))


def union_detections(*detections: Column) -> Column:
    """Spans of all sources in source order, stably sorted by start."""
    together = F.concat(*[F.coalesce(d, F.array().cast(SPANS_TYPE)) for d in detections])

    def by_start(spans: Column) -> Column:
        keyed = F.transform(spans, lambda d, i: F.struct(d["start"].alias("start"), i.alias("i"), d.alias("d")))
        return F.when(F.size(spans) <= 1, spans).otherwise(F.transform(F.array_sort(keyed), lambda k: k["d"]))

    return let(together, by_start)


def group_overlaps(spans: Column) -> Column:
    """First-fit groups: a span joins the first group with a member at IoU >= 0.5.

    Groups are never merged later, so this is not a connected-component search.
    Spans that share no position cannot be in one group, so each run of
    overlapping spans is grouped on its own.
    """
    groups_type = f"array<array<{SPAN_TYPE}>>"

    def place(groups: Column, span: Column) -> Column:
        fits = F.transform(groups, lambda g: F.exists(g, lambda m: iou(span, m) >= fixed.IOU_THRESHOLD))
        return let(F.array_position(fits, F.lit(True)), lambda at: F.when(
            at == 0, F.concat(groups, F.array(F.array(span)))).otherwise(
            F.transform(groups, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(span))).otherwise(g))))

    def first_fit(island: Column) -> Column:
        return F.aggregate(island, F.array().cast(groups_type), place)

    return F.when(F.size(spans) > 0, F.flatten(F.transform(
        overlap_islands(spans),
        lambda i: F.when(F.size(i) > 1, first_fit(i)).otherwise(F.array(i))))).otherwise(F.array().cast(groups_type))


def weighted_confidence(group: Column) -> Column:
    """Average confidence weighted by how reliable each source is."""
    def reliability(d: Column) -> Column:
        return F.coalesce(lookup(fixed.SOURCE_RELIABILITY, d["source"]), F.lit(fixed.OTHER_RELIABILITY))

    begin = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weight"))
    return F.aggregate(group, begin, lambda s, d: F.struct(
        (s["total"] + d["confidence"] * reliability(d)).alias("total"),
        (s["weight"] + reliability(d)).alias("weight")), lambda s: s["total"] / s["weight"])


def boost_factor(entity_type: Column, sources: Column) -> Column:
    two = {t: pair[0] for t, pair in fixed.AGREEMENT_BOOST.items()}
    three = {t: pair[1] for t, pair in fixed.AGREEMENT_BOOST.items()}
    return (F.when(sources >= 3, F.coalesce(lookup(three, entity_type), F.lit(fixed.DEFAULT_AGREEMENT_BOOST[1])))
            .when(sources == 2, F.coalesce(lookup(two, entity_type), F.lit(fixed.DEFAULT_AGREEMENT_BOOST[0])))
            .otherwise(F.lit(1.0)))


def alone(d: Column, bound: bool = False) -> Column:
    """The merged span of a group of one; ``bound`` as in :func:`exact_round`, for a span in a plain column."""
    confidence = F.least(F.lit(1.0), d["confidence"])
    return F.struct(
        d["entity_type"].alias("entity_type"), d["value"].alias("value"), d["start"].alias("start"), d["end"].alias("end"),
        exact_round(confidence, 4, bound).alias("confidence"),
        F.coalesce(d["source"], F.lit("")).alias("source"), F.lit(1).alias("detector_count"), F.lit(1.0).alias("boost_factor"))


def merge_group(group: Column) -> Column:
    """One span for a group: best source's type and value, widest extent, boosted confidence."""
    def priority(d: Column) -> Column:
        return F.coalesce(lookup(fixed.SOURCE_PRIORITY, d["source"]), F.lit(fixed.OTHER_PRIORITY))

    ranked = F.array_sort(F.transform(group, lambda d, i: F.struct(
        priority(d).alias("priority"), i.alias("i"), d.alias("d"))))

    def facts(g: Column) -> Column:
        sources = F.array_sort(F.array_distinct(F.transform(g, lambda k: k["d"]["source"])))
        return F.struct(g[0]["d"].alias("best"), F.transform(g, lambda k: k["d"]).alias("members"),
                        sources.alias("sources"))

    def merged(f: Column) -> Column:
        members, count = f["members"], F.size(f["sources"])
        highest = F.array_max(F.transform(members, lambda d: d["confidence"]))
        base = F.when(count > 1, F.greatest(weighted_confidence(members), highest)).otherwise(highest)
        boost = boost_factor(f["best"]["entity_type"], count)
        return F.struct(
            f["best"]["entity_type"].alias("entity_type"), f["best"]["value"].alias("value"),
            F.array_min(F.transform(members, lambda d: d["start"])).alias("start"),
            F.array_max(F.transform(members, lambda d: d["end"])).alias("end"),
            exact_round(F.least(F.lit(1.0), base * boost), 4).alias("confidence"),
            F.array_join(f["sources"], "+").alias("source"),
            count.alias("detector_count"), boost.alias("boost_factor"))

    return F.when(F.size(group) == 1, alone(group[0])).otherwise(let(ranked, lambda g: let(facts(g), merged)))


def fuse(*detections: Column) -> Column:
    """Merge the spans of any number of sources (patterns, transformer, NER)."""
    return F.transform(let(union_detections(*detections), group_overlaps), merge_group)
