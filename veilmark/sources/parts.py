"""Building documents from table rows, pages, paragraphs and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

SEGMENT_PARTS = 1024


def rows_to_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """``"col: val | col: val"`` of a row of any table, blank values left out."""
    cells = []
    for name in columns or df.columns:
        value = F.col(f"`{name}`").cast("string")
        cells.append(F.when(~is_blank(value), F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws(" | ", *cells)


def table_row_text(cells: Column) -> Column:
    """Non-blank cells of a table row joined by ``" | "``; null when all are blank."""
    filled = F.filter(cells, lambda c: ~is_blank(c))
    return F.when(F.size(filled) > 0, F.array_join(filled, " | "))


def drop_blank_paragraphs(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.filter(~is_blank(F.col("text")))


def assemble_document(parts: DataFrame) -> DataFrame:
    """Join the parts of each document with newlines, table rows after everything else.

    Input ``(doc_id, ordinal, text[, kind])``. Parts are first joined in segments
    of neighbouring ordinals, so a document with very many parts is put together
    by many tasks and only its segments meet.
    """
    late = F.col("kind") == "table_row" if "kind" in parts.columns else F.lit(False)
    placed = parts.select(
        "doc_id", F.when(late, 1).otherwise(0).alias("late"), "ordinal", "text",
        F.floor(F.col("ordinal") / SEGMENT_PARTS).alias("segment"))

    def joined(order: str) -> Column:
        pieces = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text"))))
        return F.array_join(F.transform(pieces, lambda p: p["text"]), "\n")

    segments = placed.groupBy("doc_id", "late", "segment").agg(joined("ordinal").alias("text"))
    ordered = segments.withColumn("place", F.struct("late", "segment"))
    return ordered.groupBy("doc_id").agg(joined("place").alias("text"))


def document_stats(parts: DataFrame) -> DataFrame:
    """Number of parts and characters per document."""
    return parts.groupBy("doc_id").agg(
        F.count("*").alias("part_count"), F.sum(F.length("text")).alias("char_count"),
        F.max(F.length("text")).alias("longest_part"))
