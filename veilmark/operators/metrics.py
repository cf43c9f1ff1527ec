"""Corpus analytics over analysis results and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import exploded


def serious(level: Column) -> Column:
    return level.isin("HIGH", "CRITICAL")


def overview(results: DataFrame) -> DataFrame:
    """Documents, reported entities (ignored ones included), mean risk and mean time."""
    latency = F.col("processing_time_ms") if "processing_time_ms" in results.columns else F.lit(None).cast("double")
    return results.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"),
        F.avg("risk_analysis.risk_score").alias("mean_risk"), F.avg(latency).alias("mean_latency_ms"))


def recent_analyses(log: DataFrame, count: int = 8) -> DataFrame:
    newest = log.orderBy(F.col("timestamp").desc(), F.col("document_id")).limit(count)
    return newest.select("timestamp", "document_id", "document_name", "entity_count", "risk_level")


def entity_breakdown_all(entities: DataFrame) -> DataFrame:
    """Count per type, largest first, with the share of the largest count."""
    counts = entities.groupBy("entity_type").agg(F.count("*").alias("count"))
    # One row per type: the only data the global maximum looks at.
    most = F.max("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("count") / most * 100.0).orderBy(F.col("count").desc(), "entity_type")


def daily_trend(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("documents"), F.sum("entity_count").alias("pii_detected"),
        F.count_if(serious(F.col("risk_level"))).alias("high_risk"))


def entity_explorer(results: DataFrame) -> DataFrame:
    """Every reported entity with its confidence in percent and colour band."""
    rows = exploded(results, "entities", "document_id", element="e")
    percent = F.floor(F.col("e.confidence") * 100.0 + 0.5)
    colour = F.when(percent > 85, F.lit("green")).when(percent > 60, F.lit("yellow")).otherwise(F.lit("red"))
    return rows.select("document_id", "ordinal", "e.entity_type", "e.sensitivity_level",
                       percent.alias("confidence_percent"), colour.alias("colour"), "e.strategy")


def transformation_history(results: DataFrame) -> DataFrame:
    """Original and replacement of every entity; needs results kept with original values."""
    rows = exploded(results, "entities", "document_id", element="e")
    return rows.select("document_id", "ordinal", "e.original_value", "e.anonymized_value", "e.strategy")


def _plain_number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def audit_feed(results: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One status line per document; refused files ``(path, refusal)`` become error lines."""
    level = F.col("risk_analysis.risk_level")
    status = F.when(level == "CRITICAL", F.lit("err")).when(level == "HIGH", F.lit("warn")).otherwise(F.lit("ok"))
    took = F.lit("")
    if "processing_time_ms" in results.columns:
        took = F.concat(F.lit(" · "), _plain_number(F.col("processing_time_ms")), F.lit("ms"))
    done = results.select(
        F.concat("document_name", F.lit(" processed — "), F.size("entities").cast("string"),
                 F.lit(" entities, risk "), level).alias("message"),
        F.concat(F.lit("doc_id: "), F.col("document_id").cast("string"), F.lit(" · score: "),
                 _plain_number(F.col("risk_analysis.risk_score")), took, F.lit(" · encrypted: "),
                 F.when(F.col("encrypted"), F.lit("yes")).otherwise(F.lit("no"))).alias("detail"),
        status.alias("status"))
    if failures is None:
        return done
    failed = failures.select(F.concat(F.lit("File analysis failed: "), F.col("refusal")).alias("message"),
                             F.concat(F.lit("File: "), F.col("path")).alias("detail"), F.lit("err").alias("status"))
    return done.unionByName(failed)


def confidence_by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type", "sensitivity_level").agg(
        F.count("*").alias("entities"), F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def audit_projection(log: DataFrame) -> DataFrame:
    return log.select("timestamp", "document_id", "document_name", "risk_level", "risk_score", "entity_count")


def validated_types(results: DataFrame, *keep: str) -> DataFrame:
    """Types of each document that were accepted with enough confidence; also for empty documents."""
    good = F.filter(F.col("entities"), lambda e: (e["sensitivity_level"] != "IGNORED")
                    & (e["confidence"] >= fixed.RETHRESHOLD))
    return results.select("document_id", *keep, F.array_sort(F.array_distinct(
        F.transform(good, lambda e: e["entity_type"]))).alias("types"))


def check_expectations(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Pass flag per case: wanted types found, unwanted ones not, wanted text in the output.

    A case whose document has no result fails.
    """
    found = validated_types(results, "anonymized_text").withColumnRenamed("document_id", "case_id")
    joined = cases.join(found, "case_id", "left")
    wanted = F.coalesce("should_detect", F.array().cast("array<string>"))
    unwanted = F.coalesce("should_reject", F.array().cast("array<string>"))
    text = F.col("check_anonymized_contains")
    passed = ((F.size(F.array_except(wanted, F.col("types"))) == 0)
              & (F.size(F.array_intersect(unwanted, F.col("types"))) == 0)
              & (text.isNull() | F.contains(F.col("anonymized_text"), text)))
    return joined.select("case_id", "description", F.coalesce(passed, F.lit(False)).alias("passed"))


def pass_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))
