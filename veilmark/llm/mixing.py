"""Mixing sources to target weights as subset-sum fitting.

Every source has a target of words (:func:`targets`). Its documents are all taken ``floor(target / size)`` times; what is left of the
target is a budget for a subset of them to be taken once more. Documents are counted by exact length, a bounded knapsack over these counts
says how many of each length fill the budget (:func:`fill`), and the documents of a length are chosen in an order drawn from the seed.

The histogram of one source is the unit of planning: one row per length that occurs. No document is taken more than ``MOST`` times.
A null text has no words; a null source is a source of its own, last in order. A source without words gets target 0.
Repeated rows count each. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import read, salted_rank, stored

MOST, WEIGHTS, SEED, CAPACITY, ROOM = 3, (1, 2, 3), 7, 1 << 15, 1 << 30
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict:
    """Exact target of each source: shares of all words by weight, capped at ``most`` times the source, the excess shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, done = dict(order), {}
    rest = Fraction(sum(size.values()))
    while len(done) < len(size):
        open_ = [s for s in size if s not in done]
        unit = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * size[s]]
        for s in full or open_:
            done[s] = Fraction(most * size[s]) if full else weight[s] * unit
            rest -= done[s] if full else 0
    return done


def fill(counts: dict[int, int], budget: int, capacity: int = CAPACITY) -> dict[int, int]:
    """How many of each length to take, ``counts`` at most, so that their sum comes closest to ``budget`` from below.

    The knapsack is dynamic programming over sums, a bit set per step. It takes the whole budget where its bit sets need ``ROOM`` bits at most.
    Where they need more, all but ``capacity``, or what ``ROOM`` allows, comes from every length in proportion, rounded down, and from
    one more of the longest while more than that is left, and the knapsack is exact for the whole rest only.
    """
    counts = {x: n for x, n in counts.items() if x > 0 and n > 0}
    total = sum(x * n for x, n in counts.items())
    if budget >= total:
        return counts
    if budget <= 0:
        return {}
    capacity = max(capacity, min(budget, ROOM // sum(n.bit_length() for n in counts.values())))
    take = {x: n * max(0, budget - capacity) // total for x, n in counts.items()}
    rest = budget - sum(x * n for x, n in take.items())
    for x in sorted(counts, reverse=True):
        if rest - x >= capacity and take[x] < counts[x]:
            take[x] += 1
            rest -= x
    for x in sorted(counts, reverse=True):  # only a few lengths, or copies of one length: fill by multiples
        if rest > capacity:
            more = min(counts[x] - take[x], (rest - capacity) // x)
            take[x], rest = take[x] + more, rest - more * x
    if rest > 2 * capacity:  # every length left is more than rest - capacity, so one document fits at most
        one = max((x for x in counts if x <= rest and take[x] < counts[x]), default=None)
        return {x: n + (x == one) for x, n in take.items() if n or x == one}
    space = rest
    limit, reach, steps = (1 << (space + 1)) - 1, 1, []
    for x in sorted(counts, reverse=True):
        left, part = min(counts[x] - take[x], space // x), 1
        while left > 0 and not reach >> space & 1:
            part = min(part, left)
            steps.append((x, part, reach))
            reach |= reach << x * part & limit
            left, part = left - part, part * 2
    at = reach.bit_length() - 1
    for x, part, before in reversed(steps):
        if not before >> at & 1:
            take[x], at = take[x] + part, at - x * part
    return {x: n for x, n in take.items() if n}


def _plan(hist: pd.DataFrame) -> pd.DataFrame:
    """Of one source: how often every document is taken, and how many of each length once more."""
    total, target = int((hist["size"] * hist["n"]).sum()), int(Fraction(hist["budget"].iloc[0]))
    whole = min(MOST, target // total) if total else 0
    extra = fill(dict(zip(hist["size"], hist["n"], strict=True)), target - whole * total) if whole < MOST else {}
    return pd.DataFrame({"src": hist["src"], "size": hist["size"], "whole": whole,
                         "extra": [extra.get(s, 0) for s in hist["size"]]})


def mix(rows: DataFrame, seed: int = SEED, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add source_size, target and taken to stored rows of (doc_id, src, size, ...); ``src`` is from :func:`source_key`.

    ``order`` names the columns that tell rows of one length apart; with the text's hash among them the choice is the same in every run
    for repeated and for null ids too.
    """
    hist = rows.groupBy("src", "size").agg(F.count("*").alias("n"))
    sizes = [(r.src, int(r.total)) for r in hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()]
    goal = targets([(None if s == "-" else s[1:], n) for s, n in sizes])
    # one row per source
    goals = rows.sparkSession.createDataFrame(
        [(s, n, float(goal[None if s == "-" else s[1:]]), str(round(goal[None if s == "-" else s[1:]]))) for s, n in sizes],
        "src string, source_size long, target double, budget string")
    plan = (hist.join(goals.select("src", "budget"), "src").groupBy("src")
            .applyInPandas(_plan, "src string, size long, whole long, extra long"))
    ranked = salted_rank(rows, ["src", "size"], [F.lit(seed), *order], "_rank", extra=plan)
    times = F.col("whole") + F.when(F.col("_rank") < F.col("extra"), 1).otherwise(0)
    return ranked.withColumn("taken", (times * F.col("size")).cast("long")).drop("_rank", "whole", "extra").join(
        goals.drop("budget"), "src")


def source_key(source: Column) -> Column:
    """A source as a key that is never null and keeps null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = stored(docs.select("doc_id", source_key(F.col("source")).alias("src"), n_words(F.col("text")).alias("size"),
                              F.xxhash64("text").alias("hash")))
    return mix(rows, order=("doc_id", "hash")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their columns, a document that is taken n times in n rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("doc_id", source_key(F.col("source")).alias("src"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"),
                       row.alias("row"))
    taken = mix(rows, order=("doc_id", "hash")).filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return taken.select("row.*")
