"""The vault of a stream: collisions, numbers, replays, and what a batch reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilmark.streaming import vault
from veilmark.streaming.vault import StreamVault, dead_runs, live_runs, merges_after

SCHEMA = "doc_id int, ordinal int, value string, entity_type string"


def spans(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(kept, spark, batches):
    return {r.value: r for r in kept.read(spark, batches).collect()}


def test_runs_hold_every_batch_once():
    for factor in (2, 3, 8):
        for n in range(200):
            held = sorted(b for level, i in live_runs(n, factor) for b in range(i * factor ** level, (i + 1) * factor ** level))
            assert held == list(range(n))
            made = [r for b in range(n) for r in [(0, b), *merges_after(b, factor)]]
            assert set(live_runs(n, factor)) <= set(made) and len(live_runs(n, factor)) <= (factor - 1) * 8
            dead = {d.split("=")[1] for d in dead_runs(n, factor)}
            assert not dead & {f"{level}-{i}" for m in (n, max(0, n - 1)) for level, i in live_runs(m, factor)}


def test_a_forced_collision_over_two_batches_maps_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vault, "tokenize", lambda v, t, n=8: F.concat(t, F.lit("_TOKEN_"), F.lit("SAME") if n == 8 else F.sha2(v, 256)))
    kept = StreamVault(str(tmp_path / "v"), prefixes=4)
    kept.write(spans(spark, [(1, 0, "a", "PHONE")]), 0)
    kept.write(spans(spark, [(2, 0, "b", "PHONE"), (2, 1, "a", "PHONE"), (3, 0, "x", "NAME"), (3, 1, "y", "NAME"), (4, 0, None, "NAME")]), 1)
    kept.write(spans(spark, [(5, 0, "z", "NAME")]), 2)  # its short token is free: x and y both gave it up
    found = state(kept, spark, 3)
    assert found["a"].token == "PHONE_TOKEN_SAME" and found["z"].token == "NAME_TOKEN_SAME"
    assert len({r.token for r in found.values()}) == 5 == len({r.pseudonym for r in found.values()})
    back = kept.detokenize(spark.createDataFrame([(r.token,) for r in found.values()] + [("unknown",)], "token string"), 3)
    assert {r.token: r.original_value for r in back.collect()} == {r.token: v for v, r in found.items()} | {"unknown": None}


def test_numbers_are_gapless_over_batches_with_a_replay(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(b * 100 + rng.randint(0, 30), i, f"v{rng.randint(0, 60)}", rng.choice(["PHONE", "NAME"])) for i in range(25)] for b in range(7)]
    kept, seen, order = StreamVault(str(tmp_path / "v"), prefixes=4, factor=2), {}, {"PHONE": [], "NAME": []}
    for b, rows in enumerate(batches):
        kept.write(spans(spark, rows), b)
        if b in (1, 2, 3, 6):
            before = state(kept, spark, b + 1)
            kept.write(spans(spark, rows).repartition(3), b)  # run again after a failure
            assert state(kept, spark, b + 1) == before
        firsts = {}
        for doc, at, value, kind in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
            if value not in seen and value not in firsts:
                firsts[value] = (kind, doc, at)
        for value, (kind, _, _) in sorted(firsts.items(), key=lambda x: (x[1][1], x[1][2], x[0])):
            seen[value] = b
            order[kind].append(value)
    found = state(kept, spark, len(batches))
    assert set(found) == set(seen) and {v: r.batch_id for v, r in found.items()} == seen
    for kind, values in order.items():
        assert [found[v].number for v in values] == list(range(1, len(values) + 1))
        assert all(found[v].pseudonym.startswith(f"{kind}_PSEUDO_{found[v].number:03d}_") for v in values)
    asked = spans(spark, [(1, 0, "v1", "x"), (1, 1, "nothing", "x")])
    assert {r.value: r.token for r in kept.apply(asked, len(batches)).collect()} == {"v1": found["v1"].token if "v1" in found else None, "nothing": None}


def test_a_batch_reads_a_bounded_number_of_files(spark, tmp_path):
    kept = StreamVault(str(tmp_path / "v"), prefixes=8, factor=3)
    one, read = spans(spark, [(1, 0, "value 0 0", "PHONE")]), []
    for b in range(10):
        kept.write(spans(spark, [(b, i, f"value {b} {i}", "PHONE") for i in range(40)]), b)
        known = kept.known(one, b + 1)
        plan = known._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"PartitionFilters: \[[^\]]*prefix#", plan)) == len(live_runs(b + 1, 3))
        read.append(known.select(F.input_file_name()).distinct().count())
        assert known.filter("value = 'value 0 0'").count() == 1
    assert read == [len(live_runs(b + 1, 3)) for b in range(10)] and read[8] == 1  # one file of one prefix per run


def test_an_empty_batch(spark, tmp_path):
    kept = StreamVault(str(tmp_path / "v"), prefixes=2, factor=2)
    for b, rows in enumerate([[], [(1, 0, "a", "PHONE")], [], []]):
        kept.write(spans(spark, rows), b)
    assert state(kept, spark, 4)["a"].number == 1
    with pytest.raises(Exception):
        kept.read(spark, 9).count()  # batches that never came
