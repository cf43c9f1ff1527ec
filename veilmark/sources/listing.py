"""Listing a folder tree as rows: folders are listed in tasks, level by level, and no list of files passes through the driver."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpointed

ENTRIES = "path string, length bigint, modificationTime timestamp, folder boolean"
_KINDS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])


def _whole(path: str) -> str:
    """The path with its scheme, as Spark's readers show it; without one it is a local path."""
    parts = urlsplit(path)
    if len(parts.scheme) < 2:
        return "file:" + os.path.abspath(path)
    return "file:" + parts.path if parts.scheme == "file" else path.rstrip("/")


def _hidden(name: str) -> bool:
    return name.startswith((".", "_")) and "=" not in name


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for whole in batch.column(0).to_pylist():
            parts = urlsplit(whole)
            system, start = (fs.LocalFileSystem(), whole[5:]) if parts.scheme == "file" else fs.FileSystem.from_uri(whole)
            prefix = whole[:len(whole) - len(start)] if whole.endswith(start) else f"{parts.scheme}://{parts.netloc}"
            found = [system.get_file_info(start)]
            if found[0].type == fs.FileType.Directory:
                found = [e for e in system.get_file_info(fs.FileSelector(start)) if not _hidden(e.base_name)]
            rows = [{"path": prefix + e.path, "length": e.size or 0, "modificationTime": e.mtime, "folder": e.type == fs.FileType.Directory}
                    for e in found if e.type in (fs.FileType.File, fs.FileType.Directory)]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[at:at + 4096], _KINDS)


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, modificationTime)`` of all files at or under ``path``, empty ones too; hidden names are left out as scans do.

    One job a level of folders. A path that is not there gives no rows.
    """
    folders, files = spark.createDataFrame([(_whole(path),)], "path string"), []
    while True:
        entries = checkpointed(folders.select("path").repartition("path").mapInArrow(_listed, ENTRIES))
        files.append(entries.filter("NOT folder").drop("folder"))
        folders = entries.filter("folder")
        if folders.isEmpty():
            break
    whole = files[0]
    for level in files[1:]:
        whole = whole.unionAll(level)
    return whole.withColumn("modificationTime", F.col("modificationTime").cast("timestamp"))
