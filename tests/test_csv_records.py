"""CSV records over split borders."""

import csv
import io
import random

import pytest

from veilmark.sources import files
from veilmark.sources.csv_records import csv_records, ends_inside


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield size
    for k, v in before.items():
        spark.conf.set(k, v)


def table(rng, n, width=3):
    cells = ["", "plain", "a, b", 'say "hi"', "two\nlines", 'x\n"\n,\n', "\r\n", "é😀", ' 5" pipe', '"', "\n\n\n", "z" * 200, ',"']
    return [[f"r{i}"] + [rng.choice(cells) for _ in range(width - 1)] for i in range(n)]


def written(rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO()
    csv.writer(out, quoting=quoting, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize(("seed", "split", "end"), [(1, 64, "\n"), (2, 17, "\r\n"), (3, 300, "\n"), (4, 5, "\n"), (5, 10 ** 6, "\r\n")])
def test_quoted_line_breaks_across_splits(spark, tmp_path, small_splits, seed, split, end):
    rng = random.Random(seed)
    wanted, folder = [], tmp_path / "in"
    folder.mkdir()
    for f in range(3):
        rows = table(rng, 40 if split < 20 else 120)
        (folder / f"{f}.csv").write_bytes(written([["id", "a", "b"], *rows], end=end).encode())
        wanted += rows
    small_splits(split)
    got = [list(r) for r in files.read_csv_rows(spark, str(folder)).collect()]
    assert sorted(got) == sorted(wanted)


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "line with \"\"quotes\"\",\n" * 400
    (tmp_path / "a.csv").write_text(f'id,t\n1,"{long}"\n2,x\n')
    small_splits(100)
    rows = {r.id: r.t for r in files.read_csv_rows(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {"1": long.replace('""', '"'), "2": "x"}
    assert csv_records(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20


def test_the_state_after_a_line():
    for line, outside, inside in [("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""', True, False), ('"a"', False, True),
                                  ('x,"a', True, False), ('","', False, True), ('""', False, True), ('"a"b"', False, True), ("", False, True), ('a,""",b', True, False)]:
        assert ends_inside(line, False) == outside, line
        if '"' not in line:
            assert ends_inside(line, True) == inside, line
    rng = random.Random(8)
    for _ in range(300):  # against a plain reader: a record goes on while quotes are open
        text = written(table(rng, 6))
        state, ends = False, []
        for line in text.split("\n")[:-1]:
            state = ends_inside(line, state)
            ends.append(state)
        assert ends.count(False) == 6 and not ends[-1]


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n  \nid,note\n\n1,"open\nto the end\n3,4\n')
    got = {(r.record, r.first, r.closed) for r in csv_records(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {("id,note", True, True), ('1,"open\nto the end\n3,4', False, False)}
    (tmp_path / "b.csv").write_text("id,note\n1\n2,x,more\n\n3,\"\"\n")
    assert sorted(map(tuple, files.read_csv_rows(spark, str(tmp_path / "b.csv")).collect())) == [("1", ""), ("2", "x"), ("3", "")]
    (tmp_path / "c.csv").write_text("id,note\n")
    assert files.read_csv_rows(spark, str(tmp_path / "c.csv")).count() == 0
