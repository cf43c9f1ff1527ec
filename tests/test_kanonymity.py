"""k-anonymity against a search of the whole lattice."""

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from veilmark.operators import kanonymity as ka


def plain(rows, forms, weights, k, share):
    """(levels, classes) by trying every node."""
    best = None
    for node in product(*(range(len(f)) for f in forms)):
        classes = Counter(tuple(f[j](v) for f, j, v in zip(forms, node, row)) for row in rows)
        lost = sum(n for n in classes.values() if n < k)
        if lost <= int(share * len(rows)):
            loss = sum(w * j / (len(f) - 1) for f, j, w in zip(forms, node, weights))
            best = min(best or (9, 0, ()), (round(loss, 9), lost, node))
    return best


def band(width):
    return lambda v: None if v is None else f"{v // width * width} to {v // width * width + width}"


PARENTS = [{"Oslo": "Norway", "Bergen": "Norway", "Turin": "Italy", "Rome": "Italy"}, {"Norway": "Europe", "Italy": "Europe"}]


def climb(steps):
    def level(v):
        for table in PARENTS[:steps]:
            v = None if v is None else table.get(v, "*")
        return v
    return level


FORMS = [[lambda v: None if v is None else str(v), band(5), band(20), lambda v: "*"],
         [climb(0), climb(1), climb(2), lambda v: "*"], [lambda v: v, lambda v: "*"]]


@pytest.mark.parametrize(("seed", "n", "k", "share", "weights"), [
    (1, 60, 3, 0.0, (1, 1, 1)), (2, 200, 5, 0.05, (1, 1, 1)), (3, 200, 5, 0.1, (1, 3, 0.5)), (4, 40, 2, 0.3, (2, 1, 1)), (5, 300, 10, 0.02, (1, 1, 1))])
def test_the_least_node_of_the_whole_lattice(spark, seed, n, k, share, weights):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(18, 60)]), rng.choice(["Oslo", "Bergen", "Turin", "Rome", None, "Atlantis"]), rng.choice("mf")) for _ in range(n)]
    frame = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "id long, age int, city string, sex string, n string")
    hierarchies = [ka.number_bands("age", [5, 20], weights[0]), ka.by_parents("city", PARENTS, weights[1]), ka.Hierarchy("sex", (ka._plain, ka._hidden), weights[2])]
    found = ka.k_anonymize(frame, hierarchies, k, share)
    loss, lost, node = plain(rows, FORMS, weights, k, share)
    assert tuple(found.levels.values()) == node and found.suppressed == lost <= share * n
    got = found.rows.collect()
    classes = Counter((r.age, r.city, r.sex) for r in got)
    assert len(got) == n - lost and min(classes.values()) >= k and all(r.n == "clash" for r in got)
    for r in got:
        assert (r.age, r.city, r.sex) == tuple(f[j](v) for f, j, v in zip(FORMS, node, rows[r.id]))


def test_few_nodes_are_counted(spark):
    rng = random.Random(9)
    frame = spark.createDataFrame([tuple(rng.randint(0, 99) for _ in range(3)) for _ in range(400)], "a int, b int, c int")
    lattice = ka.Lattice(frame, [ka.number_bands(c, [2, 10, 50]) for c in "abc"], 5)
    every = lattice.suppressed(lattice.nodes)
    assert all(every[a] >= every[b] for a in lattice.nodes for b in lattice.nodes if all(x <= y for x, y in zip(a, b)))
    lattice.counted = 0
    best = lattice.least(8)
    assert lattice.counted < len(lattice.nodes) * 0.7
    assert lattice.loss(best) == min(lattice.loss(n) for n in lattice.nodes if every[n] <= 8)


def test_tables_that_are_empty_or_too_small(spark):
    schema = "a int, b string"
    hierarchies = [ka.number_bands("a", [10]), ka.of_type("b", "GENDER")]
    none = ka.k_anonymize(spark.createDataFrame([], schema), hierarchies)
    assert none.rows.count() == 0 and none.levels == {"a": 0, "b": 0} and none.suppressed == 0
    few = ka.k_anonymize(spark.createDataFrame([(1, "f"), (2, "m")], schema), hierarchies)
    assert few.rows.count() == 0 and few.suppressed == 2
    nulls = ka.k_anonymize(spark.createDataFrame([(None, None)] * 6, schema), hierarchies)
    assert nulls.levels == {"a": 0, "b": 0} and nulls.rows.collect() == [(None, None)] * 6
    with pytest.raises(ValueError):
        ka.number_bands("a", [4, 10])


def test_every_level_follows_from_the_one_before(spark):
    """Otherwise more generalization could split a class."""
    values = ["23", "07 years", "27", "29", "", "adult", "560001", "560002", "561234", "1/2/2024", "9/2/2024", "2024-03-01", "2024-02-09", "1.2.99", "x",
              "9876543210", "9876500000", "Delhi", "female", "male", "abcdefgh"]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    for kind in [*ka.RULES, "OTHER"]:
        levels = ka.RULES.get(kind, ka.DEFAULT_RULE)
        rows = frame.select(*(level(F.col("v")).alias(f"l{i}") for i, level in enumerate(levels))).collect()
        for a, b in zip(range(len(levels)), range(1, len(levels))):
            seen = {}
            for r in rows:
                assert seen.setdefault(r[a], r[b]) == r[b], (kind, a)
        assert {r[-1] for r in rows} == {"*"} and rows[-1][0] is None


def test_spans_of_documents(spark):
    rows = []
    for i in range(40):
        rows += [(i, 0, str(20 + i % 4), "AGE"), (i, 1, f"56000{i % 2}", "PINCODE"), (i, 2, f"u{i}@x.org", "EMAIL")]
    rows += [(90, 0, "88", "AGE"), (90, 1, "999999", "PINCODE"), (91, 0, "a@b.org", "EMAIL"), (5, 7, "23", "AGE")]
    spans = spark.createDataFrame(rows, "doc_id long, ordinal int, value string, entity_type string")
    got, levels = ka.k_anonymize_spans(spans, ["AGE", "PINCODE"], k=5, max_suppressed=0.1)
    by_document = {}
    for r in got.collect():
        if r.entity_type == "EMAIL":
            assert r.replacement is None
        else:
            by_document.setdefault(r.doc_id, {}).setdefault(r.entity_type, set()).add(r.replacement)
    assert by_document.pop(90) == {"AGE": {"[AGE_REDACTED]"}, "PINCODE": {"[PINCODE_REDACTED]"}}
    shapes = Counter(str(sorted((t, sorted(v)) for t, v in d.items())) for d in by_document.values())
    published = {s: n for s, n in shapes.items() if "REDACTED" not in s}
    assert published and min(published.values()) >= 5 and sum(shapes.values()) - sum(published.values()) <= 3
    assert len(got.collect()) == len(rows) and set(levels) == {"AGE", "PINCODE"}
