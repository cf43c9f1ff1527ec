"""Reading files as documents, with type routing and a size gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import is_blank, let, with_once
from .csv_records import csv_records


def file_suffix(path: Column) -> Column:
    """Lower-cased suffix without the dot; empty when the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))


def route_by_type(files: DataFrame, as_bytes: bool = False) -> DataFrame:
    """Add ``document_type`` and ``refusal`` (null for accepted files) by file name.

    ``as_bytes`` also lets the one type in that is only accepted as an upload.
    """
    allowed = fixed.FILE_TYPES + (fixed.BYTES_ONLY_TYPES if as_bytes else [])
    routed = files.withColumn("document_type", file_suffix(F.col("path")))
    return routed.withColumn("refusal", F.when(~F.col("document_type").isin(*allowed), F.lit("unsupported type")))


def size_gate(files: DataFrame, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """Refuse files over ``max_bytes``, by metadata only."""
    return files.withColumn("refusal", F.coalesce(F.col("refusal"), F.when(
        F.col("length") > max_bytes, F.lit("file too large"))))


def accepted_files(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("refusal").isNull()).drop("refusal")


def quarantined_files(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("refusal").isNotNull())


def document_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def document_id(path: Column, text: Column) -> Column:
    """Repeatable id for documents that come without one."""
    return F.left(F.sha2(F.concat(path, text), 256), F.lit(12))


def read_bytes(spark: SparkSession, path: str, suffix: str, max_bytes: int | None) -> DataFrame:
    # The file-name filter prunes the listing, the length filter skips reading content.
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[" + "][".join(c + c.upper() for c in suffix) + "]").load(path))
    return files if max_bytes is None else files.filter(F.col("length") <= max_bytes)


def bytes_to_text(content: Column) -> Column:
    """UTF-8 text with each malformed sequence replaced."""
    return F.make_valid_utf8(content.cast("string"))


def _as_documents(files: DataFrame, text: Column, document_type: str) -> DataFrame:
    named = files.select(F.col("path"), text.alias("text"))
    return named.select(
        document_id(F.col("path"), F.col("text")).alias("doc_id"), document_name(F.col("path")).alias("document_name"),
        F.lit(document_type).alias("document_type"), "text",
        F.create_map(F.lit("source"), F.col("path")).alias("metadata"))


def text_docs(files: DataFrame, universal_newlines: bool = True) -> DataFrame:
    """Every row of ``(path, content)`` as one document; line ends become ``\\n`` as in text-mode reading."""
    text = bytes_to_text(F.col("content"))
    if universal_newlines:
        text = F.regexp_replace(text, "\r\n?", "\n")
    return _as_documents(files, text, "txt")


def read_text_docs(spark: SparkSession, path: str, max_bytes: int | None = None,
                   universal_newlines: bool = True) -> DataFrame:
    """Every ``.txt`` file as one document."""
    return text_docs(read_bytes(spark, path, "txt", max_bytes), universal_newlines)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header as all-string rows; empty cells are ``""``, never null.

    Large files are read in splits, quoted line breaks included (see ``csv_records``). Names come from the first file; every file's first
    record is its header. A record with fewer fields is filled up, one with more is cut.
    """
    options = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = spark.read.options(**options).csv(path, header=True, inferSchema=False, multiLine=True).columns  # opens one file
    schema = ", ".join(f"`{i}` string" for i in range(len(names)))
    cells = csv_records(spark, path).filter(~F.col("first")).select(F.from_csv("record", F.lit(schema), options).alias("r"))
    return cells.select(*(F.coalesce(F.col("r")[str(i)], F.lit("")).alias(n) for i, n in enumerate(names)))


_RECORD, _FIELD = "\ufdd0", "\ufdd1"  # noncharacters that stand for the line ends and commas outside quotes


def _csv_records(text: Column) -> Column:
    """Records of a CSV text as arrays of fields.

    Between quotes every second piece is quoted; an empty piece outside them, between two quoted ones, is a doubled quote.
    """
    def joined(pieces: Column) -> Column:
        def outside(piece: Column) -> Column:
            return F.translate(F.regexp_replace(piece, "\r\n?", "\n"), "\n,", _RECORD + _FIELD)

        return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).when(
            (p == "") & (i > 0) & (i < F.size(pieces) - 1), F.lit('"')).otherwise(outside(p))), "")

    whole = let(F.split(text, '"', -1), joined)
    return F.transform(F.filter(F.split(whole, _RECORD, -1), lambda r: r != ""), lambda r: F.split(r, _FIELD, -1))


def _csv_names(header: Column) -> Column:
    """Column names, told apart where they repeat or are empty."""
    named = F.transform(header, lambda n, i: F.when(n == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(n))
    return let(named, lambda names: F.transform(names, lambda n, i: let(
        F.size(F.filter(F.slice(names, 1, i), lambda x: x == n)),
        lambda k: F.when(k > 0, F.concat_ws(".", n, k.cast("string"))).otherwise(n))))


def csv_texts(files: DataFrame) -> DataFrame:
    """``(path, text, rows, columns, problem)`` per file of ``(path, content)``; text is null where there is a problem."""
    text = F.col("content").cast("string")
    files = files.select("path", F.is_valid_utf8(text).alias("valid"), F.regexp_replace(text, "^\ufeff", "").alias("text"))
    read = with_once(files, "records", F.when(
        F.col("valid") & (F.size(F.split("text", '"', -1)) % 2 == 1), _csv_records(F.col("text"))))
    header, body = F.get("records", F.lit(0)), F.slice("records", 2, F.greatest(F.size("records") - 1, F.lit(0)))
    ragged = F.exists(body, lambda r: F.size(r) > F.size(header))
    problem = (F.when(~F.col("valid"), "not UTF-8").when(F.col("records").isNull(), "quote without end")
               .when(F.size("records") == 0, "no header").when(ragged, "more fields than names"))

    def line(record: Column, names: Column) -> Column:
        cells = F.zip_with(F.slice(names, 1, F.size(record)), record, lambda n, v: F.when(
            ~is_blank(v), F.concat(n, F.lit(": "), v)))
        return F.array_join(F.filter(cells, lambda c: c.isNotNull()), " | ")

    lines = let(_csv_names(header), lambda names: F.array_join(F.transform(body, lambda r: line(r, names)), "\n"))
    return with_once(read, "problem", problem).select(
        "path", F.when(F.col("problem").isNull(), lines).alias("text"), F.size(body).cast("string").alias("rows"),
        F.size(header).cast("string").alias("columns"), "problem")


def csv_docs(files: DataFrame) -> DataFrame:
    """Every readable CSV of ``(path, content)`` as one document, whatever its columns; :func:`csv_texts` tells of the others.

    A file's lines never leave it, so no shuffle is needed to join them.
    """
    texts = csv_texts(files.select("path", "content")).filter(F.col("problem").isNull())
    return texts.select(
        document_id(F.col("path"), F.col("text")).alias("doc_id"), document_name(F.col("path")).alias("document_name"),
        F.lit("csv").alias("document_type"), "text", F.create_map(
            F.lit("source"), F.col("path"), F.lit("row_count"), F.col("rows"),
            F.lit("col_count"), F.col("columns")).alias("metadata"))


def read_csv_docs(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Every readable ``.csv`` file as one document."""
    return csv_docs(read_bytes(spark, path, "csv", max_bytes))


def unreadable(texts: DataFrame, sheets: DataFrame) -> DataFrame:
    """``(path, reason)`` of text and CSV files, both ``(path, content)``, without a text to analyze."""
    plain = text_docs(texts).select(F.col("metadata")["source"].alias("path"), "text", F.lit(None).cast("string").alias("problem"))
    tables = csv_texts(sheets.select("path", "content")).select("path", "text", "problem")
    reason = F.coalesce("problem", F.when(is_blank(F.col("text")), "no text"))
    return plain.unionByName(tables).select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def reject_blank_docs(docs: DataFrame) -> DataFrame:
    return docs.filter(~is_blank(F.col("text")))
