"""Re-identification risk of identifier combinations in one document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import constant, exact_round, first_level, let, lookup


def _rules() -> Column:
    return constant([{"combination": sorted(types), "risk_level": level, "correlation_score": score,
                      "description": text} for types, level, score, text in fixed.COMBINATIONS])


def match_rules(types: Column) -> Column:
    """All combination rules whose types are all present."""
    fired = F.filter(_rules(), lambda r: F.forall(r["combination"], lambda t: F.array_contains(types, t)))
    return F.when(F.size(types) > 1, fired).otherwise(F.slice(_rules(), 1, 0))


def superset_dedup(fired: Column) -> Column:
    """Drop a fired rule when a larger fired rule contains it."""
    def covered(rule: Column, all_fired: Column) -> Column:
        return F.exists(all_fired, lambda o: (F.size(rule["combination"]) < F.size(o["combination"]))
                        & F.forall(rule["combination"], lambda t: F.array_contains(o["combination"], t)))

    return let(fired, lambda rules: F.filter(rules, lambda r: ~covered(r, rules)))


def correlation_score(rules: Column) -> Column:
    return F.aggregate(rules, F.lit(0.0), lambda total, r: total + r["correlation_score"])


def reid_level(score: Column) -> Column:
    return first_level(score, fixed.REID_FLOORS)


def reid_recommendations(level: Column, rules: Column, types: Column) -> Column:
    none = F.array().cast("array<string>")
    critical = F.slice(F.filter(rules, lambda r: r["risk_level"] == "CRITICAL"), 1, fixed.REID_COMBO_LINES)
    combos = F.transform(critical, lambda r: F.concat(
        F.lit("  → "), F.array_join(r["combination"], " + "), F.lit(": "), r["description"]))
    pairs = [F.when(F.array_contains(types, a) & F.array_contains(types, b), F.array(F.lit(line))).otherwise(none)
             for (a, b), line in fixed.REID_PAIR_ADVICE]
    headline = F.filter(F.array(lookup(fixed.REID_ADVICE, level)), lambda line: line.isNotNull())
    return F.concat(headline, combos, *pairs)


def no_combinations() -> Column:
    """What :func:`analyze_combinations` gives where no rule can fire; a constant."""
    level = next((name for name, floor in fixed.REID_FLOORS if 0.0 >= floor), "LOW")
    headline = constant([fixed.REID_ADVICE[level]]) if level in fixed.REID_ADVICE else F.array().cast("array<string>")
    return F.struct(F.slice(_rules(), 1, 0).alias("correlation_risks"), F.lit(0.0).alias("total_correlation_score"),
                    F.lit(level).alias("re_identification_level"), F.lit(0).cast("long").alias("quasi_id_combinations_found"),
                    headline.alias("recommendations"))


def analyze_combinations(types: Column) -> Column:
    """Fired rules, total score, level and advice for the types of a document."""
    def summary(f: Column) -> Column:
        return F.struct(
            f["rules"].alias("correlation_risks"), exact_round(f["score"], 2).alias("total_correlation_score"),
            f["level"].alias("re_identification_level"),
            F.size(f["rules"]).cast("long").alias("quasi_id_combinations_found"),
            reid_recommendations(f["level"], f["rules"], f["types"]).alias("recommendations"))

    def facts(b: Column) -> Column:
        return let(correlation_score(b["rules"]), lambda score: F.struct(
            b["types"].alias("types"), b["rules"].alias("rules"), score.alias("score"),
            reid_level(score).alias("level")))

    def matched(ts: Column) -> Column:
        return let(F.struct(ts.alias("types"), superset_dedup(match_rules(ts)).alias("rules")), lambda b: let(facts(b), summary))

    return let(types, lambda ts: F.when(F.size(ts) <= 1, no_combinations()).otherwise(matched(ts)))


def adjusted_score(base: Column, correlation: Column) -> Column:
    return F.least(F.lit(100.0), base + correlation)
