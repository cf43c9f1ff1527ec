"""Line dedup, hard negatives and whitening against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import lines, negatives, whitening
from veilmark.llm.common import stored


def plain_lines(texts, least):
    keys = [lines.line_keys(None if t is None else t.encode()) for t in texts]
    count = Counter(k for own in keys for k in set(own) if k)
    out = []
    for text, own in zip(texts, keys):
        kept = [x for x, k in zip((text or "").split("\n"), own) if not k or count[k] < least]
        out.append((len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def line_texts(rng, n):
    common = ["Menu", " menu ", "MENU\t", "É b", "é b", "", "  ", "\x1c", "x" * 300] + [f"line {i}" for i in range(12)]
    return [None if rng.random() < .05 else "\n".join(rng.choice(common + [f"own {rng.random()}"] * 6) for _ in range(rng.randint(0, 9)))
            for _ in range(n)]


@pytest.mark.parametrize(("least", "broadcast"), [(10, 1 << 20), (10, 0), (1, 0), (2, 1 << 20), (30, 0)])
def test_lines_of_many_documents_go(spark, least, broadcast):
    texts = line_texts(random.Random(least), 150) + ["Menu\nhot"] * 60 + ["\n".join(f"l{i % 700}" for i in range(30_000))] + ["a\r\nb"] * 12
    docs = stored(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kept string"))
    index = lines.LineIndex(docs, floor=min(2, least), per_shard=40)
    assert index.shards > 1 or least > 1
    got = lines.without_common_lines(docs, least, index, broadcast=broadcast, probes=50).toPandas().sort_values("doc_id")
    want = plain_lines(texts, least)
    assert list(zip(got["n_lines"], got["n_dropped"], got["text"])) == [(w[0], w[1], w[3]) for w in want]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_lines_of_odd_rows(odd, broadcast):
    got = lines.without_common_lines(odd, 2, broadcast=broadcast).collect()
    texts = [r.text for r in odd.select("text").collect()]
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in got) == sorted((w[0], w[1], w[3]) for w in plain_lines(texts, 2))
    assert lines.without_common_lines(odd.limit(0), 2, broadcast=broadcast).count() == 0


def test_thresholds_that_the_index_cannot_serve(spark):
    docs = stored(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))
    index = lines.LineIndex(docs, floor=2)
    for least in (0, 1, 256):
        with pytest.raises(ValueError):
            lines.without_common_lines(docs, least, index)
    assert [r.text for r in lines.without_common_lines(docs, 2, index).collect()] == ["", ""]


def test_perfect_hash_is_minimal_and_tells_foreign_keys():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 64, 65, 50_000):
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        a[: n // 2] = a[0] if n else 0  # equal first halves
        perfect = lines.PerfectHash.of(a, b)
        assert sorted(perfect.slots(a, b)) == list(range(n))
        assert perfect.words.size * 64 <= 4 * n + 256
    table = lines._build(__import__("pyarrow").table({"shard": [0] * n, "a": a.view(np.int64), "b": b.view(np.int64), "n": np.arange(n) + 2}))
    row = table.to_pylist()[0]
    assert (lines.counts_of(row, a, b) == np.minimum(np.arange(n) + 2, 255)).all()
    assert not lines.counts_of(row, a, b + np.uint64(1)).any()
    assert sum(len(row[c]) for c in ("words", "ranks", "prints", "counts")) < 11 * n


def plain_negatives(rows, anchors, k, m, low, high):
    out = []
    for i in anchors:
        label, v = rows[i]
        score = {j: int(v @ w) for j, (_, w) in rows.items() if j != i and len(w) == len(v)}
        positives = sorted((-score[j], j) for j in score if rows[j][0] == label)[:k]
        for s, j in positives:
            inside = sorted((-score[x], x) for x in score if rows[x][0] != label and low * -s <= 100 * score[x] <= high * -s)[:m]
            out += [(i, j, r, x, -s, -t) for r, (t, x) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "cells", "group"), [(1, 800, 3), (2, 1 << 21, 2048), (3, 5000, 5)])
def test_negatives_match_brute_force(spark, seed, cells, group):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 12)) + .5
    rows = {i: (int(rng.integers(0, 4)), None) for i in range(300)}
    rows = {i: (c, (centres[c] + rng.normal(size=12)).round(1)) for i, (c, _) in rows.items()}
    for i in range(40, 80):
        rows[i] = (rows[i][0], rows[40][1])  # ties
    rows |= {400: (1, np.zeros(12)), 401: (9, np.ones(12)), 410: (2, np.array([3.0, 1.0])), 411: (2, np.array([1.0, 2.0])), 412: (3, np.array([1.0, 1.0]))}
    bad = [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 12, 1), (503, [float("inf")] * 12, 1), (504, [], 1), (505, [1.0] * 12, None),
           (None, [1.0] * 12, 1)]
    frame = spark.createDataFrame([(i, v.tolist(), c, "clash") for i, (c, v) in rows.items()] + [(*b, "clash") for b in bad]
                                  + [(7, rows[7][1].tolist(), rows[7][0], "twice"), (7, [9.0] * 12, 99, "other")],
                                  "vec_id long, embedding array<double>, label int, block string")
    vertical = negatives.Vertical(negatives.labelled(frame, "vec_id", "embedding", "label"), cells=cells)
    asked = vertical.rows.filter("id % 10 = 0 or id in (7, 401, 411)")
    whole = {i: (c, np.floor(256 * v).astype(int)) for i, (c, v) in rows.items()}
    anchors = [i for i in whole if i % 10 == 0 or i in (7, 401, 411)]
    got = negatives.mine(vertical, asked, group=group)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(whole, anchors, 5, 10, 30, 90)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    vertical = negatives.Vertical(negatives.labelled(none, "vec_id", "embedding", "label"))
    assert negatives.mine(vertical, vertical.rows).count() == 0


def test_the_scan_reads_less_than_everything():
    """On vectors with few large components, as trained embeddings have, most candidates go before their last dimension."""
    rng = np.random.default_rng(8)
    v = np.floor(256 * rng.normal(size=(2000, 64)) * (0.85 ** np.arange(64))).astype(np.int64)
    block = negatives.Block.__new__(negatives.Block)
    block.dim, block.ids, block.labels, block.columns = 64, np.arange(2000), np.arange(2000) % 2, np.ascontiguousarray(v.T)
    block.low, block.high, block.cells = v.min(0), v.max(0), 0
    for i in range(0, 2000, 100):
        got = negatives.nearest_in_block(block, v[i], i, int(i % 2), 5)
        score = v @ v[i]
        want = sorted((-int(score[j]), j) for j in range(2000) if j != i and j % 2 == i % 2)[:5]
        assert [(-s, j) for j, s in got] == want
    assert block.cells < 0.5 * 20 * 1000 * 64


def by_eigh(x, want=16):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.astype(object).sum(0)
    centred = (fit.astype(object) * n - s).astype(float) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return n, s, e[::-1][:want], q[:, ::-1][:, :want], e.sum()


@pytest.mark.parametrize(("n", "d", "flat"), [(400, 64, True), (400, 64, False), (300, 5, False), (30, 80, True)])
def test_whitening_matches_eigenvectors(spark, n, d, flat):
    rng = np.random.default_rng(n + d)
    v = rng.normal(size=(n, d)) * (0.12 if flat else 2.0 * 0.8 ** np.arange(d))
    v = np.vstack([v, v[:20], v[:1]])
    frame = spark.createDataFrame([(i, r.tolist(), "clash") for i, r in enumerate(v)], "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(frame, "vec_id", "embedding").toPandas()
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    count, s, e, q, trace = by_eigh(x)
    k = min(16, d)
    assert (got["n"] == count).all() and got["identity_error"].max() < 1e-8 and len(got) == len(v) * k
    scaled = x.astype(object) * count - s
    for c, part in got.sort_values("id").groupby("component"):
        want = scaled.astype(float) / count @ q[:, c - 1] / np.sqrt(e[c - 1])
        have = part["whitened"].to_numpy()
        assert np.abs(have * np.sign(have @ want) - want).max() < 1e-7
        assert abs(part["explained"].iloc[0] / (e[c - 1] / trace) - 1) < 1e-9
        assert [int(y) for y in part["deviation"]] == [int(y) for y in (scaled * scaled).sum(1)]


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (9, [1.0]), (10, [1e30, 1.0, 2.0]), (11, [-1e30, 5.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(frame, "vec_id", "embedding").toPandas()
    two = got[got["n"] == 3]
    assert len(two) == 8 and two["id"].isna().sum() == 2 and two["identity_error"].max() < 1e-9
    assert not set(got["id"].dropna()) & {3, 4, 5, 6, 7, 8, 9}  # one distinct vector has no variance
    assert len(got[got["id"] >= 10]) == 2 and (got[got["id"] >= 10]["component"] == 1).all()
    assert whitening.whiten(frame.limit(0), "vec_id", "embedding").count() == 0
    assert whitening.whiten(frame.filter("vec_id = 8"), "vec_id", "embedding").count() == 0


def test_the_filter_needs_few_passes_and_adds_in_levels(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(5000, 96)) * np.linspace(1, 3, 96)
    passes = []
    cov = np.cov(v.T, bias=True)
    e, q, worst = whitening.leading_components(lambda y: passes.append(y.shape) or cov @ y, 96)
    assert np.allclose(e, np.linalg.eigvalsh(cov)[::-1][:16], rtol=1e-12) and worst <= 1e-11 * e[0] and len(passes) < 150
    monkeypatch.setattr(whitening, "FAN", 2)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v[:600, :8])], "vec_id long, embedding array<double>").repartition(7)
    fit = whitening.Fit(stored(whitening.shifted(frame, "vec_id", "embedding")), 8)
    x = np.floor(64 * v[:600, :8]) + 1_000_000
    assert np.allclose(fit.times(np.eye(8)), np.cov(np.unique(x, axis=0).T, bias=True), rtol=1e-12)


def test_op13_on_the_given_vectors(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(given["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, _, e, q, trace = by_eigh(x)
    got = whitening.op13(spark, sf_dir).toPandas()
    assert len(got) == len(x) * 16 and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    for c, part in got.sort_values("vec_id").groupby("component"):
        want = (x - np.unique(x, axis=0).mean(0)) @ q[:, c - 1] / np.sqrt(e[c - 1])
        have = part["whitened"].to_numpy()
        assert np.abs(have * np.sign(have @ want) - want).max() < 1e-7 and abs(part["explained"].iloc[0] * trace / e[c - 1] - 1) < 1e-9
