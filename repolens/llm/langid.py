"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features: the character 1-, 2- and 3-grams of the whole lower-cased text, hashed to ``DIM`` cells,
weighted (1 + ln tf) * idf and scaled to length 1.  Training: follow the regularised leader with
elastic-net penalties (per-coordinate steps; L1 keeps weights sparse), over at most ``ROWS``
labelled rows, the same number for each language as far as there are so many, chosen by a hash of
the id.  A fifth of them is held back to fit one temperature, which calibrates the probabilities.
Only the executors see texts; the driver sees the sample's sparse counts.

Defined cases: null text, or a text without a letter, is ``und`` with score 0 (no language is
claimed); rows with null language are never learnt from; with no usable training row every text is
``und``; ties go to the first language in alphabetical order; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_bucket, lean, small_batches, widened

#: Training rows at most, cells of the hashed feature space, passes, rows of a step.
ROWS, DIM, PASSES, STEP = 3_000, 1 << 15, 6, 16
#: Step size and penalties of the leader.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-5
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def has_letter(text: str) -> bool:
    """Is a character of a category L* in the text (``isalpha`` of one character says so)?"""
    return any(map(str.isalpha, text))


def cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of the n-grams of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    grams, h = [], np.zeros(len(c), dtype=np.uint64)
    for n in range(3):
        if len(c) <= n:
            break
        h = h[: len(c) - n] + c[n:] * _MIX[n]
        grams.append((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 15))
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    count = np.bincount(np.concatenate(grams).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(count)
    return at, count[at]


class Model:
    """Weights, idf, languages and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[at]
        return w / max(np.sqrt((w * w).sum()), 1e-12)

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(at, count) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        z = self.logits(*cells(text)) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(z))
        return self.langs[best], float(p[best] / p.sum())


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> Model:
    """Fit on (language, cells, counts)."""
    langs = sorted({r[0] for r in rows})
    df = np.zeros(DIM)
    for _, at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    k = len(langs)
    model = Model(langs, idf, np.zeros((DIM, k)), np.zeros(k), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    if k < 2:
        return model
    own = [(at, model.vector(at, c), langs.index(l)) for l, at, c in rows]
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    weights = np.zeros((DIM + 1, k))
    for _ in range(PASSES):
        fit = rng.permutation(fit)  # a pass takes every row once
        for s in range(0, len(fit), STEP):
            part = [own[i] for i in fit[s : s + STEP]]
            grad = np.zeros((DIM + 1, k))
            for at, x, y in part:
                logit = x @ weights[at] + weights[DIM]
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[y] -= 1
                grad[at] += x[:, None] * p
                grad[DIM] += p
            grad /= len(part)
            touched = np.flatnonzero(np.abs(grad).sum(axis=1))
            g = grad[touched]
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / ALPHA
            z[touched] += g - sigma * weights[touched]
            n[touched] += g * g
            zt = z[touched]
            weights[touched] = np.where(np.abs(zt) <= L1, 0.0, -(zt - np.sign(zt) * L1) / ((BETA + np.sqrt(n[touched])) / ALPHA + L2))
    model.weights, model.bias = weights[:DIM].astype(np.float32), weights[DIM]
    logits = [(model.logits(rows[i][1], rows[i][2]), langs.index(rows[i][0])) for i in held]
    if logits:
        grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))

        def loss(t: float) -> float:
            return sum(float(np.log(np.exp((x - x.max()) / t).sum()) - (x[y] - x.max()) / t) for x, y in logits)

        model.temperature = float(min(grid, key=loss))
    return model


def fit(docs: DataFrame, allowed, rows: int = ROWS) -> Model:
    """Train on ``docs`` (doc_id, text, lang) where ``allowed`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros(DIM), np.zeros((DIM, 0)), np.zeros(0), 1.0)
    quota = max(1, rows // len(counts))
    share = F.element_at(F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1 << 20, int(quota / n * (1 << 20)) + 1))]), F.col("lang"))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, at, count = [], [], []
            for l, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if has_letter(t):
                    a, c = cells(t)
                    lang.append(l)
                    at.append(a.astype("<u2").tobytes())
                    count.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.binary()), pa.array(count, pa.binary())], names=["lang", "at", "n"])

    got = sample.mapInArrow(lean(run), "lang string, at binary, n binary").collect()
    if not got:
        return Model([], np.zeros(DIM), np.zeros((DIM, 0)), np.zeros(0), 1.0)
    got.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.n)))
    return train([(r.lang, np.frombuffer(bytes(r.at), "<u2").astype(np.int64), np.frombuffer(bytes(r.n), "<u4").astype(np.int64)) for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred string and score double; a column of these names is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = widened(kept, lang_pred="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [model.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(lean(run), schema)


def language(docs: DataFrame, held_out_of: int = 3, held_out: int = 1, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out boolean, lang_pred string, score double of every document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = fit(own, crc_bucket("doc_id", held_out_of) != held_out, rows)
    return identify(own.select("doc_id", (crc_bucket("doc_id", held_out_of) == held_out).alias("held_out"), "text"), model).drop("text")
