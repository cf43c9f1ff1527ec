"""Quality rules by line labelling: a linear-chain conditional random field marks each line content or boilerplate.

The lines with a word are the chain. Emission scores are linear in the features of :func:`line_features`,
transitions have a weight for each pair of labels, and the best labels are found by Viterbi
decoding. A document is kept when at least ``CONTENT_SHARE`` of its words stand in content lines, and the base rules
(few words, much repetition) do not reject it. The field is fitted on the lines of documents of ``labels``, a line labelled as its document is
unless it is plainly the other kind (:func:`line_labels`): on at most ``SAMPLE`` documents of each kind, and of a long one on ``FIT_CHAINS`` chains of ``CHAIN`` lines,
spread over the whole text.

Null text counts as empty, and an empty text has no words and fails the base rules. Without usable labels every line is
content. Repeated rows are judged alike, an empty table gives an empty result, and other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import bounded_sample, bytes_of, fresh, read

SAMPLE, FIT_CHAINS, CONTENT_SHARE, SURE = 1500, 8, 0.5, 0.6
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
CHAIN, STEPS, RATE, RIDGE = 32, 150, 0.1, 1e-3
SPACE, SYMBOLS, MORE_SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"#*$%&|<>{}[]=~^_\\/@"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)) + bytes(range(128, 256)), b"0123456789"
FEATURES = 17


@dataclass(frozen=True)
class Field:
    """Weights: emission (feature, label), transition (label, next label), first label. Label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray
    first: np.ndarray


def without_labels() -> Field:
    emission = np.zeros((FEATURES, 2))
    emission[0, 1] = 1.0
    return Field(emission, np.zeros((2, 2)), np.zeros(2))


def repeated_words(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Which words stand in a window of words that the text holds twice or more."""
    n = len(words)
    found = np.zeros(n, bool)
    if n <= window:
        return found
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return found
    key, base = codes, len(ids)
    for k in range(1, window):
        if key.size and int(key.max()) >= (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key[:-1] * base + codes[k:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    for k in range(window):
        found[k:n - window + 1 + k] |= twice
    return found


def _count(line: bytes, of: bytes) -> int:
    return len(line) - len(line.translate(None, of))


def line_features(line: bytes, words: list[bytes], again: float, seen: bool) -> list[float]:
    """Features in 0..1 of a line with words; ``again``: its share of words in repeated windows; ``seen``: an equal line came before."""
    n, size = len(words), len(line)
    upper, lower = _count(line, UPPER), _count(line, LOWER)
    side = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marks = _count(line, MORE_SYMBOLS)
    return [1.0, float(n <= 2), float(2 < n <= 5), min(n, 200) ** 0.5 / 15, min(1.0, 4 * marks / size), float(marks > 2),
            upper / (upper + lower + 1), _count(line, DIGITS) / size, min(1.0, 4 * _count(line, b"!?") / size),
            1 - len(set(words)) / n, side / n, float(seen), min(1.0, abs((size - n + 1) / n - 5.5) / 10),
            float(line.rstrip(SPACE)[-1:] in b".!?:;,"), again,
            min(1.0, marks / n), float(3 * side >= n)]


@dataclass
class Read:
    """What one pass over a text gives."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    features: list = None
    line_words: list = None

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


def read_text(text: bytes | None, features: bool = True) -> Read:
    """Counts of a whole text, and the features of its lines (left out when the base rules already reject)."""
    text = text or b""
    words = text.split()  # of bytes: at ASCII white space only
    got = Read(len(words), features=[], line_words=[])
    solid = text.translate(None, SPACE)
    got.word_chars = len(solid.decode("utf-8", "replace")) if not solid.isascii() else len(solid)
    got.n_symbols = _count(text, SYMBOLS)
    again = repeated_words(words)
    got.n_repeat_words = int(again.sum())
    sums = np.concatenate([[0], np.cumsum(again)])
    at, before, features = 0, set(), features and not got.base_failed
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        seen = line in before
        got.n_dup_lines += seen
        before.add(line)
        if features:
            got.features.append(line_features(line, own, float(sums[at + len(own)] - sums[at]) / len(own), seen))
            got.line_words.append(len(own))
        at += len(own)
    return got


def viterbi(scores: np.ndarray, field: Field) -> list[int]:
    """Best labels of a chain with emission ``scores`` (line, label); ties go to content."""
    (t00, t01), (t10, t11) = field.transition.tolist()
    rows, back = scores.tolist(), []
    a, b = rows[0][0] + field.first[0], rows[0][1] + field.first[1]
    for s0, s1 in rows[1:]:
        to0, to1 = b + t10 >= a + t00, b + t11 >= a + t01
        back.append((int(to0), int(to1)))
        a, b = s0 + (b + t10 if to0 else a + t00), s1 + (b + t11 if to1 else a + t01)
    labels = [int(b >= a)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def content_share(got: Read, field: Field) -> float:
    """Share of the words that stand in content lines."""
    if not got.features:
        return 0.0
    labels = viterbi(np.asarray(got.features) @ field.emission, field)
    return sum(n for n, y in zip(got.line_words, labels, strict=True) if y) / max(1, sum(got.line_words))


def line_labels(chains: list[np.ndarray], labels: list[int], sure: float = SURE) -> list[np.ndarray]:
    """A label for every line: its document's, but the other where the line alone is that with more than ``sure`` probability.

    A field without transitions, fitted on the labels of the documents, says what a line is like on its own: heads, menus and feet recur in bad documents, so
    in a good one they stand out, as do plain sentences in a bad one. From here on chains hold both labels and transitions have something to learn from.
    """
    alone = fit_field(chains, [np.full(len(c), y) for c, y in zip(chains, labels, strict=True)], chain=1)
    out = []
    for c, y in zip(chains, labels, strict=True):
        scores = c @ alone.emission + alone.first
        other = 1 / (1 + np.exp(scores[:, y] - scores[:, 1 - y]))
        out.append(np.where(other > sure, 1 - y, y))
    return out


def fit_field(chains: list[np.ndarray], labels: list[np.ndarray], chain: int = CHAIN) -> Field:
    """Maximum likelihood by Adam, with forward-backward over all chains at once; ``labels`` has one for every line."""
    if len({int(y) for own in labels for y in own}) < 2:
        return without_labels()
    cut = [(c[i:i + chain], y[i:i + chain]) for c, y in zip(chains, labels, strict=True) for i in range(0, len(c), chain)]
    n, most = len(cut), max(len(c) for c, _ in cut)
    x, real, y = np.zeros((n, most, FEATURES)), np.zeros((n, most), bool), np.zeros((n, most), int)
    for i, (c, own) in enumerate(cut):
        x[i, :len(c)], real[i, :len(c)], y[i, :len(c)] = c, True, own
    seen_e = np.stack([x[real & (y == k)].sum(0) for k in (0, 1)], 1)
    follows = real[:, 1:]
    seen_t = np.array([[float((follows & (y[:, :-1] == i) & (y[:, 1:] == j)).sum()) for j in (0, 1)] for i in (0, 1)])
    seen_f = np.bincount(y[:, 0], minlength=2).astype(float)
    w = np.zeros(FEATURES * 2 + 6)
    m, v, lines = np.zeros_like(w), np.zeros_like(w), float(real.sum())
    for step in range(1, STEPS + 1):
        e, t, f = w[:-6].reshape(FEATURES, 2), w[-6:-2].reshape(2, 2), w[-2:]
        s = x @ e
        ahead = np.empty((n, most, 2))
        ahead[:, 0] = s[:, 0] + f
        for k in range(1, most):
            ahead[:, k] = np.logaddexp(ahead[:, k - 1, :1] + t[0], ahead[:, k - 1, 1:] + t[1]) + s[:, k]
        behind = np.zeros((n, most, 2))
        for k in range(most - 2, -1, -1):
            nxt = np.where(real[:, k + 1, None], s[:, k + 1] + behind[:, k + 1], -np.inf)
            both = np.logaddexp(nxt[:, :1] + t[:, 0], nxt[:, 1:] + t[:, 1])
            behind[:, k] = np.where(real[:, k + 1, None], both, 0.0)
        total = np.logaddexp(ahead[:, 0, 0] + behind[:, 0, 0], ahead[:, 0, 1] + behind[:, 0, 1])
        marginal = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        pairs = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                p = ahead[:, :-1, i] + t[i, j] + s[:, 1:, j] + behind[:, 1:, j] - total[:, None]
                pairs[i, j] = np.exp(p[follows]).sum()
        grad = np.concatenate([(np.einsum("nlf,nlk->fk", x, marginal) - seen_e).ravel(), (pairs - seen_t).ravel(),
                               marginal[:, 0].sum(0) - seen_f]) / lines + RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Field(w[:-6].reshape(FEATURES, 2), w[-6:-2].reshape(2, 2), w[-2:])


def _fit_lines(features: list[list[float]]) -> np.ndarray:
    """The lines of a text that the field is fitted on: all, or of a long text ``FIT_CHAINS`` chains spread evenly over the whole of it."""
    lines = np.asarray(features, float).reshape(-1, FEATURES)
    if len(lines) <= FIT_CHAINS * CHAIN:
        return lines
    starts = np.linspace(0, len(lines) - CHAIN, FIT_CHAINS).astype(int)
    return np.concatenate([lines[a:a + CHAIN] for a in starts])


def _sample_features(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, labels = bytes_of(batch.column(0)), batch.column(1)
    rows = [_fit_lines(read_text(t).features).ravel() for t in texts]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), labels], ["x", "quality"])


def train_field(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on at most ``SAMPLE`` labelled documents of each quality; only line features go to the driver."""
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"))
    ids = bounded_sample(marked, "quality", SAMPLE, ["doc_id"]).select("doc_id", "quality")
    ids = F.broadcast(ids)  # at most 2 * SAMPLE rows
    sample = docs.select("doc_id", "text").filter("text is not null").join(ids, "doc_id")
    sample = bounded_sample(sample, "quality", 2 * SAMPLE, ["doc_id", "text"]).select("text", "quality")
    rows = sample.mapInArrow(lambda it: (_sample_features(b) for b in it if b.num_rows), "x array<double>, quality int").collect()
    rows = sorted((r.quality, tuple(r.x)) for r in rows if r.x)
    chains, kinds = [np.array(x).reshape(-1, FEATURES) for _, x in rows], [q for q, _ in rows]
    return fit_field(chains, line_labels(chains, kinds)) if len(set(kinds)) == 2 else without_labels()


def judged(text: Column, field: Field) -> Column:
    """Struct of the counts, base_failed, content_share and kept."""
    fields = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
              "content_share double, kept boolean")

    @F.pandas_udf(fields)
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            got = read_text(text.encode("utf-8", "surrogatepass") if text else b"")
            share = content_share(got, field)
            out.append((got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed,
                        share, not got.base_failed and share >= CONTENT_SHARE))
        return pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")])

    return judge(text)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    field = train_field(docs, read(spark, sf_dir, "labels"))
    return docs.select("doc_id", judged(F.col("text"), field).alias("j")).select("doc_id", "j.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their columns."""
    field = train_field(docs, read(spark, sf_dir, "labels"))
    name = fresh(docs, "_kept")
    return docs.withColumn(name, judged(F.col("text"), field)["kept"]).filter(name).drop(name)
