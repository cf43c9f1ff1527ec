"""Corpus-wide tokens and pseudonyms: one answer per value, kept in a table.

Input everywhere is a span table ``(doc_id, ordinal, value, entity_type)``,
best a written one, since building it means detecting over all text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.anonymize import pseudonym, tokenize
from .lineage import checkpointed

WIDE_TOKEN = 64


def first_seen(spans: DataFrame) -> DataFrame:
    """Where and under which type each value first appears in document order.

    A plain minimum, so a value that fills a third of the table is combined
    before the shuffle. ``mixed`` marks values seen under several types.
    """
    first = F.min(F.struct("doc_id", "ordinal", "entity_type"))
    found = spans.groupBy("value").agg(
        first.alias("first"), (F.min("entity_type") != F.max("entity_type")).alias("mixed"))
    return found.select("value", F.col("first.entity_type").alias("entity_type"),
                        F.col("first.doc_id").alias("doc_id"), F.col("first.ordinal").alias("ordinal"), "mixed")


def build_vault(spans: DataFrame) -> DataFrame:
    """``(value, entity_type, token, mixed, collided)``; the first type of a value wins.

    Short tokens of different values can coincide in a large corpus. Those
    values get a full-length token, so the vault always maps back to one value.
    """
    short = first_seen(spans).withColumn("token", tokenize(F.col("value"), F.col("entity_type")))
    clashes = short.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select(
        "token", F.lit(True).alias("collided"))
    marked = short.join(clashes, "token", "left").withColumn("collided", F.coalesce("collided", F.lit(False)))
    wide = tokenize(F.col("value"), F.col("entity_type"), WIDE_TOKEN)
    return marked.select("value", "entity_type", F.when(F.col("collided"), wide).otherwise(F.col("token"))
                         .alias("token"), "mixed", "collided")


def token_map(vault: DataFrame) -> DataFrame:
    return vault.select("value", "entity_type", "token")


def tokenize_spans(spans: DataFrame, vault: DataFrame) -> DataFrame:
    """Add the corpus-wide ``token`` to each span.

    A token is a function of value and type; only values with several types or
    a collision need the vault, and they are few.
    """
    special = vault.filter(F.col("mixed") | F.col("collided")).select("value", F.col("token").alias("vault_token"))
    own = tokenize(F.col("value"), F.col("entity_type"))
    return spans.join(special, "value", "left").withColumn(
        "token", F.coalesce(F.col("vault_token"), own)).drop("vault_token")


def detokenize(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    """Original value of each token, null when unknown."""
    return tokens.join(vault.select("token", F.col("value").alias("original_value")), "token", "left")


def numbered(first: DataFrame) -> DataFrame:
    """``(value, entity_type, number)``: first appearances (see :func:`first_seen`) numbered from 1 within their type.

    A running number over a whole type would put that type in one task. The
    first appearances are spread by range instead, numbered inside each range,
    and shifted by the counts of the ranges before it. The range of a row is
    stored with it by the checkpoint: a recomputed one could differ.
    """
    order = ["entity_type", "doc_id", "ordinal", "value"]
    ranged = checkpointed(first.select("value", "entity_type", "doc_id", "ordinal").repartitionByRange(*order).withColumn(
        "part", F.spark_partition_id()))
    counts = ranged.groupBy("entity_type", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("entity_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("entity_type", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("entity_type", "part").orderBy("doc_id", "ordinal", "value")
    placed = ranged.withColumn("place", F.row_number().over(inside)).join(shifts, ["entity_type", "part"])
    return placed.select("value", "entity_type", (F.col("place") + F.col("shift")).alias("number"))


def pseudonym_vault(spans: DataFrame) -> DataFrame:
    """``(value, entity_type, number, pseudonym)``: numbered by first appearance within type."""
    return numbered(first_seen(spans)).withColumn("pseudonym", pseudonym(F.col("value"), F.col("entity_type"), F.col("number")))


def pseudonym_map(vault: DataFrame) -> DataFrame:
    return vault.select("value", "pseudonym")
