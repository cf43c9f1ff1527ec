"""Counts with Laplace noise, and an account of the privacy budget they use.

A count is released with noise of scale ``bound / epsilon``, where ``bound`` is the largest number of rows one person (or document) may add to all groups; rows beyond
it are left out of the count, the same ones in every run. The noise of a group is drawn from a hash of a secret seed, the release's name and the
group: asking again gives the same answer, so averaging reveals nothing, and a lost task is computed again alike.

Only groups of a given list should be released, as a group that appears only where it has rows tells of a person; with ``groups`` the ones without rows get noise too.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LEDGER = "release string, epsilon double"
_PARTS = 13  # hexadecimal digits that make a fraction: 52 bits, exact in a double


def _fraction(text: Column) -> Column:
    """A number in (0, 1) from a text, uniform over texts."""
    return (F.conv(F.left(F.sha2(text, 256), F.lit(_PARTS)), 16, 10).cast("double") + 0.5) / float(16 ** _PARTS)


def laplace(scale: float, text: Column) -> Column:
    """Laplace noise of mean 0, drawn by ``text``."""
    u = _fraction(text) - 0.5
    return -F.lit(float(scale)) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def group_text(keys: list[str]) -> Column:
    """One text for the values of ``keys``; nulls and separators inside values stay distinct."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def noisy_counts(rows: DataFrame, keys: list[str], person: str, epsilon: float, seed: str, release: str, bound: int = 1,
                 groups: DataFrame | None = None) -> DataFrame:
    """``keys, noisy, released``: rows per group with noise; ``released`` is whole and not negative.

    ``bound`` rows of each person are counted, chosen by hash; rows with a null person belong to one person. ``groups`` lists the groups to release,
    null keys included; rows of other groups are left out before the choice.
    """
    if epsilon <= 0 or bound < 1:
        raise ValueError("epsilon and bound must be positive")
    if groups is not None:
        wanted = groups.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        rows = rows.join(wanted, on=same, how="left_semi")
    # Of equal rows it does not matter which is taken; a person with very many rows is thinned by groups first.
    drawn = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(release), F.col("_group")), 256)
    per_group = rows.withColumn("_group", group_text(keys)).groupBy(F.col(person).alias("_person"), *keys, "_group").agg(
        F.least(F.count("*"), F.lit(bound)).alias("_n"))
    order = Window.partitionBy("_person").orderBy(drawn, "_group").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(order), F.lit(0))
    taken = per_group.withColumn("_taken", F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(bound) - before)))
    counts = taken.groupBy(*keys, "_group").agg(F.sum("_taken").alias("_count"))
    if groups is not None:
        listed = wanted.select(*(F.col(f"_{k}").alias(k) for k in keys)).withColumn("_group", group_text(keys))
        counts = listed.join(counts.select("_group", "_count"), "_group", "left").withColumn("_count", F.coalesce("_count", F.lit(0)))
    noise = laplace(bound / epsilon, F.concat_ws("|", F.lit(seed), F.lit("noise"), F.lit(release), F.col("_group")))
    noisy = counts.withColumn("noisy", F.col("_count") + noise)
    return noisy.select(*keys, "noisy", F.greatest(F.lit(0), F.round("noisy")).cast("bigint").alias("released"))


class BudgetSpent(Exception):
    """A release would use more privacy budget than there is."""


class Budget:
    """The releases made from one dataset, kept in a folder: together they use at most ``total``.

    A release has a name; asking for it again with the same epsilon costs nothing, as it gives the same answer. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, total: float) -> None:
        self.spark, self.path, self.total = spark, path.rstrip("/"), total
        self._write([], "none")

    def _write(self, rows: list[tuple], name: str) -> None:
        self.spark.createDataFrame(rows, _LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def releases(self) -> dict[str, float]:
        ledger = self.spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(self.path)
        return {r.release: r.epsilon for r in ledger.collect()}  # one row a release

    def spend(self, release: str, epsilon: float) -> None:
        known = self.releases()
        if release in known:
            if known[release] != epsilon:
                raise ValueError(f"{release} was made with epsilon {known[release]}")
            return
        if sum(known.values()) + epsilon > self.total * (1 + 1e-9):
            raise BudgetSpent(f"{release} needs {epsilon}, {self.total - sum(known.values())} is left")
        self._write([(release, float(epsilon))], hashlib.sha256(release.encode()).hexdigest())


def release_counts(budget: Budget, rows: DataFrame, keys: list[str], person: str, epsilon: float, seed: str, release: str, bound: int = 1,
                   groups: DataFrame | None = None) -> DataFrame:
    """:func:`noisy_counts` paid from a budget; nothing is computed when it is spent."""
    budget.spend(release, epsilon)
    return noisy_counts(rows, keys, person, epsilon, seed, release, bound, groups)
