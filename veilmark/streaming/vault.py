"""Tokens and pseudonyms of a stream that stay reversible however long it runs.

A vault is a folder that one streaming query writes through ``foreachBatch``, batch ids counting from 0. It holds three tables:

* ``values``: value, entity type, token, number and pseudonym, filed under a hash prefix of the value;
* ``tokens``: token and value, filed under a hash prefix of the token, for the way back and for collisions;
* ``counters``: per batch, how many values of each type have a number.

A batch asks only the prefixes of its own values and tokens. A value that is there keeps what it has; a new one gets the next number of its type, in the
order of first appearance, and a short token, unless that token stands for another value already or two new values share it: then
the new ones get the full-length token. So every token and every pseudonym maps back to one value.

Rows lie in runs, merged as the digits of a counter carry: ``FACTOR`` runs of one batch become a run of ``FACTOR`` batches, and so on. Which runs hold the first n
batches follows from n alone, so nothing is listed, a batch reads at most ``FACTOR - 1`` runs a digit, one file per prefix each, and a batch that is run again
after a failure reads what it read before and overwrites its own rows with the same ones. Runs that were merged stay readable until :func:`dead_runs` are removed.

Null values take no part. A batch without rows adds an empty run. The first type seen for a value wins, over all batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.anonymize import pseudonym, tokenize
from ..operators.lineage import checkpointed
from ..operators.vault import WIDE_TOKEN, first_seen, numbered

PREFIXES, FACTOR = 256, 8
SCHEMAS = {
    "values": "value string, entity_type string, token string, number bigint, pseudonym string, batch_id bigint, prefix int",
    "tokens": "token string, value string, batch_id bigint, prefix int",
    "counters": "entity_type string, total bigint",
}


def live_runs(batches: int, factor: int = FACTOR) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold the first ``batches`` batches; run (l, i) holds ``factor ** l`` of them from ``i * factor ** l`` on."""
    out, level = [], 0
    while batches:
        out += [(level, batches - 1 - d) for d in range(batches % factor)]
        batches, level = batches // factor, level + 1
    return out


def merges_after(batch_id: int, factor: int = FACTOR) -> list[tuple[int, int]]:
    """Runs that are complete with this batch and merged from ``factor`` runs one level below."""
    out, count, level = [], batch_id + 1, 0
    while count % factor == 0:
        count, level = count // factor, level + 1
        out.append((level, count - 1))
    return out


def dead_runs(batches: int, factor: int = FACTOR) -> list[str]:
    """Folders below a vault of ``batches`` batches that no batch to come and no replay of the last one reads."""
    used = {*live_runs(batches, factor), *live_runs(max(0, batches - 1), factor), (0, batches - 1)}
    every, level, size = [], 0, 1
    while size <= batches:
        every += [(level, i) for i in range(batches // size)]
        level, size = level + 1, size * factor
    return [f"{side}/run={level}-{i}" for side in ("values", "tokens") for level, i in every if (level, i) not in used]


class StreamVault:
    def __init__(self, path: str, prefixes: int = PREFIXES, factor: int = FACTOR) -> None:
        self.path, self.prefixes, self.factor = path.rstrip("/"), prefixes, factor

    def prefix(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.prefixes)).cast("int")

    def _run(self, side: str, run: tuple[int, int]) -> str:
        return f"{self.path}/{side}/run={run[0]}-{run[1]}"

    def _read(self, spark: SparkSession, side: str, runs: list[tuple[int, int]], prefixes: list[int] | None = None) -> DataFrame:
        out = spark.createDataFrame([], SCHEMAS[side])
        for run in runs:
            # one schema without and one partition column: a run without rows has no files
            rows = spark.read.schema(SCHEMAS[side]).parquet(self._run(side, run))
            out = out.unionByName(rows if prefixes is None else rows.filter(F.col("prefix").isin(prefixes)))
        return out

    def _store(self, rows: DataFrame, side: str, run: tuple[int, int]) -> None:
        rows.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(self._run(side, run))

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.prefix for r in rows.select("prefix").distinct().collect())  # PREFIXES at most

    def read(self, spark: SparkSession, batches: int) -> DataFrame:
        """All that the first ``batches`` batches brought: value, entity_type, token, number, pseudonym, batch_id."""
        return self._read(spark, "values", live_runs(batches, self.factor)).drop("prefix")

    def known(self, rows: DataFrame, batches: int) -> DataFrame:
        """Vault rows of the prefixes that occur among the values of ``rows``."""
        asked = self._touched(rows.select(self.prefix(F.col("value")).alias("prefix")))
        return self._read(rows.sparkSession, "values", live_runs(batches, self.factor), asked).drop("prefix")

    def detokenize(self, tokens: DataFrame, batches: int) -> DataFrame:
        """``tokens`` (column token) with ``original_value``, null where the vault has none; reads the prefixes of these tokens."""
        asked = self._touched(tokens.select(self.prefix(F.col("token")).alias("prefix")))
        back = self._read(tokens.sparkSession, "tokens", live_runs(batches, self.factor), asked)
        return tokens.join(back.select("token", F.col("value").alias("original_value")), "token", "left")

    def apply(self, spans: DataFrame, batches: int) -> DataFrame:
        """``spans`` (column value) with the vault's ``token`` and ``pseudonym``."""
        mine = self.known(spans, batches).select("value", "token", "pseudonym")
        return spans.join(mine, "value", "left")

    def _counters(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], SCHEMAS["counters"])
        return spark.read.schema(SCHEMAS["counters"]).parquet(f"{self.path}/counters/batch={batch_id}")

    def _tokens(self, fresh: DataFrame, batch_id: int) -> DataFrame:
        """``fresh`` (value, entity_type, ...) with tokens that no other value has."""
        short = fresh.withColumn("token", tokenize(F.col("value"), F.col("entity_type")))
        asked = self._touched(short.select(self.prefix(F.col("token")).alias("prefix")))
        stored = self._read(fresh.sparkSession, "tokens", live_runs(batch_id, self.factor), asked)
        taken = stored.select("token").join(short.select("token").distinct(), "token", "left_semi")
        shared = short.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
        clashes = taken.unionByName(shared).distinct().withColumn("clash", F.lit(True))
        wide = tokenize(F.col("value"), F.col("entity_type"), WIDE_TOKEN)
        return short.join(clashes, "token", "left").withColumn("token", F.when(F.col("clash"), wide).otherwise(F.col("token"))).drop("clash")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Add the unseen values of spans (doc_id, ordinal, value, entity_type)."""
        spark = batch.sparkSession
        # kept in one place: several steps below must see the same rows, and a stream's input should be read once
        seen = checkpointed(first_seen(batch.filter(F.col("value").isNotNull())).withColumn("prefix", self.prefix(F.col("value"))))
        stored = self._read(spark, "values", live_runs(batch_id, self.factor), self._touched(seen))
        fresh = checkpointed(seen.join(stored.select("value"), "value", "left_anti"))
        before = self._counters(spark, batch_id - 1)
        named = numbered(fresh).join(before, "entity_type", "left")
        number = F.col("number") + F.coalesce("total", F.lit(0))
        rows = self._tokens(named.withColumn("number", number).drop("total"), batch_id)
        rows = checkpointed(rows.select(
            "value", "entity_type", "token", "number", pseudonym(F.col("value"), F.col("entity_type"), F.col("number")).alias("pseudonym"),
            F.lit(batch_id).cast("long").alias("batch_id"), self.prefix(F.col("value")).alias("prefix")))
        self._store(rows, "values", (0, batch_id))
        self._store(rows.select("token", "value", "batch_id", self.prefix(F.col("token")).alias("prefix")), "tokens", (0, batch_id))
        added = rows.groupBy("entity_type").agg(F.count("*").alias("total"))
        after = before.unionByName(added).groupBy("entity_type").agg(F.sum("total").alias("total"))  # one row a type
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counters/batch={batch_id}")
        for level, i in merges_after(batch_id, self.factor):
            parts = [(level - 1, j) for j in range(i * self.factor, (i + 1) * self.factor)]
            for side in ("values", "tokens"):
                self._store(self._read(spark, side, parts), side, (level, i))

    def writer(self) -> Callable[[DataFrame, int], None]:
        """The function for ``foreachBatch``."""
        return self.write
