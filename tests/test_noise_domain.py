"""Noise on counts with its budget, and the domain of a text."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veilmark.functions import domain
from veilmark.operators import noise


def test_noise_has_its_mean_and_spread_over_seeds(spark):
    scale = 4.0
    drawn = spark.range(20000).select(noise.laplace(scale, F.concat(F.lit("seed"), F.col("id").cast("string"))).alias("x"))
    mean, spread, median = drawn.select(F.avg("x"), F.avg(F.abs("x")), F.expr("percentile(abs(x), 0.5)")).first()
    assert abs(mean) < 0.15 and abs(spread / scale - 1) < 0.05 and abs(median / (scale * math.log(2)) - 1) < 0.05


def rows(spark):
    return spark.createDataFrame([(p % 40 if p % 9 else None, "abc"[p % 3] if p % 7 else None, "clash") for p in range(400)], "who int, kind string, noisy string")


def test_reruns_agree_and_releases_differ(spark):
    def counts(seed="s", release="r", parts=3):
        got = noise.noisy_counts(rows(spark).repartition(parts), ["kind"], "who", 0.5, seed, release, bound=3)
        return {r.kind: (r.noisy, r.released) for r in got.collect()}

    assert counts() == counts(parts=7)
    assert counts() != counts(seed="t") and counts() != counts(release="q")
    assert all(isinstance(n, int) and n >= 0 for _, n in counts().values())


def test_a_person_adds_at_most_the_bound(spark):
    data = rows(spark).collect()
    for bound in (1, 3, 50):
        got = noise.noisy_counts(rows(spark), ["kind"], "who", 1e9, "s", "r", bound=bound)  # hardly any noise
        people = {}
        for r in data:
            people[r.who] = people.get(r.who, 0) + 1
        assert sum(r.released for r in got.collect()) == sum(min(n, bound) for n in people.values())


def test_groups_without_rows_are_released_too(spark):
    groups = spark.createDataFrame([("a",), ("zz",), (None,)], "kind string")
    got = {r.kind: r for r in noise.noisy_counts(rows(spark), ["kind"], "who", 0.2, "s", "r", bound=2, groups=groups).collect()}
    assert set(got) == {"a", "zz", None} and got["zz"].noisy != 0
    assert noise.noisy_counts(rows(spark).limit(0), ["kind"], "who", 1, "s", "r").count() == 0
    with pytest.raises(ValueError):
        noise.noisy_counts(rows(spark), ["kind"], "who", 0, "s", "r")


def test_a_spent_budget_refuses(spark, tmp_path):
    budget = noise.Budget(spark, str(tmp_path / "b"), total=1.0)
    first = noise.release_counts(budget, rows(spark), ["kind"], "who", 0.6, "s", "one").collect()
    assert noise.release_counts(budget, rows(spark), ["kind"], "who", 0.6, "s", "one").collect() == first
    with pytest.raises(noise.BudgetSpent):
        noise.release_counts(budget, rows(spark), ["kind"], "who", 0.5, "s", "two")
    with pytest.raises(ValueError):
        budget.spend("one", 0.1)
    noise.Budget(spark, str(tmp_path / "b"), total=1.0).spend("three", 0.4)  # opened again
    assert budget.releases() == {"one": 0.6, "three": 0.4}


def plain(text):
    tokens = [t for t in re.split(r"[^\w]|_", (text or "").lower()) if t]
    every = {t for terms in domain.FINANCIAL.values() for t in terms}
    found = [" ".join(tokens[i:i + n]) for i in range(len(tokens)) for n in (1, 2, 3) if i + n <= len(tokens)]
    found = [f for f in found if f in every]
    ranked = sorted((-sum(f in terms for f in found), name) for name, terms in domain.FINANCIAL.items())
    ranked = [(-n, name) for n, name in ranked if n]
    density = len(found) / len(tokens) if tokens else 0.0
    inside = density >= domain.LEAST_DENSITY
    confidence = ranked[0][0] / sum(n for n, _ in ranked) * min(1, density / domain.FULL_DENSITY) if inside else 0.0
    return inside, ranked[0][1] if inside else None, [n for _, n in ranked] if inside else [], confidence, density


def test_domains(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "weather", "Café", "know", "your", "customer", "card", "number", "stolen", "loan", "BANK", "pan", "fraud", "x1"]
    texts = [None, "", "...", "Loan", "anti-money laundering", "the know your customer"] + [
        rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary[:rng.choice([4, 15])], k=rng.randint(1, 400))) for _ in range(80)] + ["word " * 5000 + "loan"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in frame.select("i", domain.classify_domain(F.col("t")).alias("d")).collect():
        inside, name, subs, confidence, density = plain(texts[r.i])
        assert (r.d.in_domain, r.d.domain, r.d.sub_domains) == (inside, name, subs), texts[r.i]
        assert r.d.keyword_density == pytest.approx(density) and r.d.domain_confidence == pytest.approx(confidence)
    plan = frame.select(domain.classify_domain(F.col("t")).alias("d"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
