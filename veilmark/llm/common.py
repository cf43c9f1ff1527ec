"""Helpers shared by the operators: stored tables, ranks of skewed groups, batches of Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilmark.operators.lineage import checkpointed, shared_folder

__all__ = ["arrow_batches", "arrow_rows", "bytes_of", "checkpointed", "column_sums", "fresh", "read", "salted_rank", "stored"]

BUCKETS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again.

    Cuts lineage as ``checkpoint()`` does, in compressed columns. A lost executor
    costs a reread. The folder of one call is never used again.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def arrow_rows(df: DataFrame, work: Callable, schema: str, *args) -> DataFrame:
    """``mapInArrow`` with ``work(batch, *args) -> list of columns or RecordBatch``, one call per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch, *args)

    return df.mapInArrow(run, schema)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows for the Arrow steps of what is run inside; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, made from ``name``."""
    while name in df.columns:
        name += "_"
    return name


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def column_sums(counts: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``counts`` with ``name``: the sum of ``value`` over the earlier rows of the key."""
    earlier = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def salted_rank(df: DataFrame, keys: list[str], order: list[str | Column], name: str, buckets: int = BUCKETS,
                extra: DataFrame | None = None) -> DataFrame:
    """Number the rows of every key from 0, in an order drawn from a hash of ``order``.

    ``keys`` must not be null. A key's rows are dealt to ``buckets`` by their hash and
    ranked bucket by bucket, so a key with a third of all rows is never one task; the
    counts of (key, bucket) give each bucket its first rank. ``df`` is read twice:
    store it when it is costly. ``extra`` holds columns by key to be joined in the same
    pass.
    """
    salted = df.withColumn("_h", F.xxhash64(*order)).withColumn("_salt", F.pmod("_h", F.lit(buckets)).cast("int"))
    first = column_sums(salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n")), keys, "_salt", "_n", "_first")
    if extra is not None:
        first = first.join(extra, keys, "left")
    within = W.partitionBy(*keys, "_salt").orderBy("_h", *order)
    return (salted.withColumn("_rn", F.row_number().over(within)).join(first.drop("_n"), [*keys, "_salt"])
            .withColumn(name, (F.col("_first") + F.col("_rn") - 1).cast("long")).drop("_h", "_salt", "_rn", "_first"))


def bounded_sample(df: DataFrame, key: str, per_key: int, ident: list[str]) -> DataFrame:
    """About ``per_key`` rows at most of each value of ``key``, drawn by a hash of ``ident``; ``_h`` is that hash.

    For fitting only. A value with more rows is thinned to about twice the bound before its
    rows meet in one task. The counts per value go to the driver, so values must be few, as classes are.
    """
    counts = {r[0]: r[1] for r in df.groupBy(key).count().collect()}
    hashed = df.withColumn("_h", F.xxhash64(*ident))
    share = F.lit(1.0)
    for value, n in counts.items():
        if n > 2 * per_key:
            share = F.when(F.col(key) == value, 2.0 * per_key / n).otherwise(share)
    thinned = hashed.filter(F.col("_h").cast("double") < (share * 2.0 - 1.0) * 2.0 ** 63)
    first = W.partitionBy(key).orderBy("_h", *ident)
    return thinned.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= per_key).drop("_rn")
