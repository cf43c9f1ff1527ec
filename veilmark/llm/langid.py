"""Language identification with a blended-spectrum presence kernel, Nystrom landmarks and one-versus-rest kernel ridge regression.

A text is folded to lower-case letters and single spaces. Its features are the distinct n-grams of length 1 to ``N_MAX``, hashed to
``2 ** BITS`` numbers; the kernel of two texts is the number of n-grams they share over the geometric mean of their numbers of n-grams.
``LANDMARKS`` labelled texts span the solution (Nystrom): with K the kernel of the ``PER_LANG`` sampled texts of each language against
the landmarks and M that of the landmarks, the weights solve ``(K'K + ridge M) a = K'y`` for targets +1 (the language) and -1 (the rest).
Scoring is two matrix products a batch: presence times landmarks, then kernel times weights.

The languages are the non-null ``lang`` values of the training rows. A text that is null or has no letter is ``und`` with score 0, as is every
text when there is nothing to learn from. The score is the winning regression value, carried from -1..1 to 0..1; ties go to the first
language by code point. Repeated rows get the same answer, an empty table gives an empty result, other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import arrow_rows, bounded_sample, read

N_MAX, BITS, LANDMARKS, PER_LANG, RIDGE, BATCH = 4, 20, 128, 400, 0.1, 32
FOLDS, HELD_OUT = 4, 2


@lru_cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray | None:
    """Sorted distinct hashed n-grams of the whole text, None when it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32)
    seen, code = _flags(), points
    for n in range(1, N_MAX + 1):
        if n > 1:
            if code.size < 2:
                break
            code = code[:-1] * np.uint32(0x01000193) + points[n - 1:]
        mixed = (code ^ (code >> np.uint32(15)) ^ np.uint32(n * 0x51ED2701 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        seen[mixed >> np.uint32(32 - BITS)] = True
    ids = np.flatnonzero(seen)
    seen[ids] = False
    return ids.astype(np.int32)


@lru_cache
def _flags() -> np.ndarray:
    return np.zeros(1 << BITS, bool)


@dataclass
class Model:
    """Landmarks as sets of n-grams, weights (landmark, language)."""

    landmarks: list[np.ndarray]
    weights: np.ndarray
    langs: list[str]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of every n-gram of the landmarks (-1 elsewhere), and their presence (n-gram, landmark), scaled."""
        if not hasattr(self, "_tables"):
            known = np.unique(np.concatenate(self.landmarks))
            place = np.full(1 << BITS, -1, np.int32)
            place[known] = np.arange(known.size)
            has = np.zeros((known.size, len(self.landmarks)), np.float32)
            for j, ids in enumerate(self.landmarks):
                has[place[ids], j] = 1 / np.sqrt(ids.size)
            self._tables = place, has
        return self._tables

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        place, has = self.tables()
        rows = np.zeros((len(sets), has.shape[0]), np.float32)
        for i, ids in enumerate(sets):
            at = place[ids]
            rows[i, at[at >= 0]] = 1 / np.sqrt(ids.size)
        return rows @ has

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self.kernel(sets[i:i + BATCH]) @ self.weights for i in range(0, len(sets), BATCH)])


def fit(sets: list[np.ndarray], langs: list[str]) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    each = max(1, LANDMARKS // len(names))
    chosen = [i for n in names for i in [k for k, x in enumerate(langs) if x == n][:each]]
    model = Model([sets[i] for i in chosen], np.zeros((len(chosen), len(names)), np.float32), names)
    k = np.concatenate([model.kernel(sets[i:i + BATCH]) for i in range(0, len(sets), BATCH)]).astype(float)
    m = k[chosen]
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    left = k.T @ k + RIDGE * (m + m.T) / 2 + 1e-6 * np.eye(len(chosen))
    model.weights = np.linalg.solve(left, k.T @ y).astype(np.float32)
    return model


def _sample_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [grams(t) for t in batch.column(0).to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["g", "lang", "h"])


def train(labelled: DataFrame) -> Model | None:
    """Fit on (doc_id, text, lang): at most ``PER_LANG`` rows a language, of which only n-gram numbers go to the driver."""
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sample = bounded_sample(rows, "lang", PER_LANG, ["doc_id", "text"]).select("text", "lang", "_h")
    got = [r for r in arrow_rows(sample, _sample_grams, "g array<int>, lang string, h long").collect() if r.g]
    got.sort(key=lambda r: (r.lang, r.h, r.g))
    return fit([np.array(r.g, np.int32) for r in got], [r.lang for r in got])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text of (doc_id, text)."""
    def work(batch: pa.RecordBatch, model: Model | None) -> pa.RecordBatch:
        sets = [grams(t) if model else None for t in batch.column(1).to_pylist()]
        lang, score, real = ["und"] * len(sets), np.zeros(len(sets)), [i for i, s in enumerate(sets) if s is not None]
        if real:
            values = model.scores([sets[i] for i in real])
            for i, best, value in zip(real, values.argmax(1), values.max(1), strict=True):
                lang[i], score[i] = model.langs[best], min(1.0, max(0.0, (float(value) + 1) / 2))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double", model)


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.filter(~is_held_out()))
    return predict(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
