"""Daily totals of an audit stream that take late records in.

A day is closed once the watermark, the latest time seen before this batch less the allowed lateness, has passed its end; its totals are then written
once and never changed. A record that comes after its day was closed goes to a table of late records, from which corrections are added up whenever
they are wanted: totals and corrections together are the totals of all records.

One streaming query writes the folder through ``foreachBatch``, batch ids counting from 0:

* ``open``: per batch, the sums of the days that are not closed yet, all a next batch needs of the past;
* ``closed``: per batch, the totals of the days it closed;
* ``late``: per batch, the records that came too late, or without a time;
* ``clock``: per batch, the watermark after it.

A batch reads only what the batch before it wrote, so a batch that is run again writes the same, and its work does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpointed
from ..operators.metrics import serious

SUMS = "day timestamp, documents bigint, pii_detected bigint, total_risk double, high_risk bigint"
LATE = "timestamp timestamp, entity_count bigint, risk_score double, risk_level string"
CLOCK = "watermark timestamp"


def _sums(records: DataFrame) -> DataFrame:
    return records.groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("entity_count"), F.lit(0)).cast("bigint").alias("pii_detected"),
        F.coalesce(F.sum("risk_score"), F.lit(0.0)).alias("total_risk"), F.count_if(serious(F.col("risk_level"))).alias("high_risk"))


def _added(*sums: DataFrame) -> DataFrame:
    whole = sums[0]
    for other in sums[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy("day").agg(*(F.sum(c).alias(c) for c in ("documents", "pii_detected", "total_risk", "high_risk")))


def _shown(sums: DataFrame) -> DataFrame:
    return sums.select("day", "documents", "pii_detected", "high_risk", (F.col("total_risk") / F.col("documents")).alias("mean_risk"))


class DailyTotals:
    def __init__(self, path: str, lateness: str = "1 hour") -> None:
        self.path, self.lateness = path.rstrip("/"), lateness

    def _read(self, spark: SparkSession, name: str, schema: str, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={batch_id}")

    def _every(self, spark: SparkSession, name: str, schema: str, batches: int) -> DataFrame:
        if not batches:
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}").filter(F.col("batch") < batches).drop("batch")

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def _closes(self, day: Column, watermark: Column) -> Column:
        return F.coalesce(day + F.expr("INTERVAL 1 DAY") <= watermark, F.lit(False))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Take in records (timestamp, entity_count, risk_score, risk_level)."""
        spark = batch.sparkSession
        before = self._read(spark, "clock", CLOCK, batch_id - 1).first()  # one row
        mark = F.lit(before.watermark if before else None).cast("timestamp")
        records = batch.select(F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("entity_count").cast("bigint").alias("entity_count"),
                               F.col("risk_score").cast("double").alias("risk_score"), "risk_level")
        late = F.col("timestamp").isNull() | self._closes(F.date_trunc("day", "timestamp"), mark)
        records = checkpointed(records.withColumn("late", late))
        self._write(records.filter("late").drop("late"), "late", batch_id)
        sums = checkpointed(_added(self._read(spark, "open", SUMS, batch_id - 1), _sums(records.filter("NOT late"))))
        latest = records.agg(F.max("timestamp").alias("t")).select((F.col("t") - F.expr(f"INTERVAL {self.lateness}")).alias("watermark"))
        after = latest.select(F.greatest("watermark", mark).alias("watermark"))
        self._write(after, "clock", batch_id)
        now = F.lit(self._read(spark, "clock", CLOCK, batch_id).first().watermark).cast("timestamp")
        self._write(sums.filter(self._closes(F.col("day"), now)), "closed", batch_id)
        self._write(sums.filter(~self._closes(F.col("day"), now)), "open", batch_id)

    def writer(self) -> Callable[[DataFrame, int], None]:
        return self.write

    def closed(self, spark: SparkSession, batches: int) -> DataFrame:
        """Totals of the days closed by the first ``batches`` batches, as they were written when the day closed."""
        return _shown(self._every(spark, "closed", SUMS, batches))

    def late(self, spark: SparkSession, batches: int) -> DataFrame:
        """Records that came after their day was closed, or without a time."""
        return self._every(spark, "late", LATE, batches)

    def corrections(self, spark: SparkSession, batches: int) -> DataFrame:
        """What the late records add to each day."""
        return _shown(_sums(self.late(spark, batches)))

    def totals(self, spark: SparkSession, batches: int) -> DataFrame:
        """All days with their corrections: the totals of all records so far. Records without a time make a day of their own, null."""
        return _shown(_added(self._every(spark, "closed", SUMS, batches), self._read(spark, "open", SUMS, batches - 1),
                             _sums(self.late(spark, batches))))
