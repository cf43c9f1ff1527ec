"""Daily totals of a stream with late records."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veilmark.streaming.daily import LATE, DailyTotals
from veilmark.streaming.stream import stream_audit_metrics

START = datetime(2024, 1, 1)


def plain(batches, lateness):
    """(sums by day, days closed by batch, late records by batch) record by record."""
    mark, closed, late, seen = None, [], [], {}
    for rows in batches:
        late.append([r for r in rows if r[0] is None or (mark and r[0].replace(hour=0, minute=0, second=0) + timedelta(days=1) <= mark)])
        for r in rows:
            if r not in late[-1]:
                seen.setdefault(r[0].date(), []).append(r)
        times = [r[0] for r in rows if r[0]]
        mark = max([t - lateness for t in times] + ([mark] if mark else []), default=None)
        closed.append({d for d in seen if mark and datetime.combine(d, datetime.min.time()) + timedelta(days=1) <= mark} - set().union(*closed))
    return closed, late


def test_totals_and_corrections_are_the_batch_result(spark, tmp_path):
    rng = random.Random(4)
    batches = []
    for b in range(5):
        rows = [(START + timedelta(days=b + rng.choice([0, 0, 0.4, -1, -2]), hours=rng.random() * 10, microseconds=rng.randint(0, 10 ** 6)), rng.randint(0, 5),
                 float(rng.randint(0, 100)), rng.choice(["LOW", "HIGH", "CRITICAL", None])) for _ in range(30)]
        batches.append(rows + ([(None, 1, 2.0, "HIGH")] if b == 2 else []))
    batches.insert(3, [])
    kept = DailyTotals(str(tmp_path / "d"), "3 hours")
    for b, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, LATE)
        kept.write(frame, b)
        if b in (2, 4):
            before = sorted(map(str, kept.totals(spark, b + 1).collect()))
            kept.write(frame.repartition(3), b)  # run again after a failure
            assert sorted(map(str, kept.totals(spark, b + 1).collect())) == before
    n = len(batches)
    closed, late = plain(batches, timedelta(hours=3))
    assert sum(map(len, late)) > 5 and kept.late(spark, n).count() == sum(map(len, late))
    shut = [r.day.date() for r in kept.closed(spark, n).collect()]
    assert sorted(shut) == sorted(set().union(*closed)) and len(shut) == len(set(shut)) > 2
    whole = {}
    for r in (r for rows in batches for r in rows):
        whole.setdefault(r[0].date() if r[0] else None, []).append(r)
    got = {r.day.date() if r.day else None: r for r in kept.totals(spark, n).collect()}
    assert set(got) == set(whole)
    for day, rows in whole.items():
        assert got[day].documents == len(rows) and got[day].pii_detected == sum(r[1] for r in rows)
        assert got[day].high_risk == sum(r[3] in ("HIGH", "CRITICAL") for r in rows)
        assert abs(got[day].mean_risk - sum(r[2] for r in rows) / len(rows)) < 1e-9
    assert kept.corrections(spark, n).agg(F.sum("documents")).first()[0] == sum(map(len, late))


def test_a_stream_of_nothing(spark, tmp_path):
    kept = DailyTotals(str(tmp_path / "d"))
    for b in range(2):
        kept.write(spark.createDataFrame([], LATE), b)
    assert kept.totals(spark, 2).count() == kept.late(spark, 2).count() == kept.closed(spark, 2).count() == 0


def test_spark_closes_days_in_append_mode(spark, tmp_path):
    rows = [(START + timedelta(days=d, hours=h), 1, 10.0, "HIGH") for d in range(3) for h in range(3)]
    spark.createDataFrame(rows, LATE).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(LATE).parquet(str(tmp_path / "in"))
    stream_audit_metrics(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.day.day, r.documents) for r in got} == {(1, 3), (2, 3)}  # the last day is still open
