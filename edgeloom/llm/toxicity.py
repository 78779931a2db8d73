"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 leave a short list of weights, which is broadcast as a dense table of ``DIMS`` floats
(4 MB).  The fit streams a bounded sample of labelled rows through one task, which first compares ``SETTINGS`` on rows of the
sample that it keeps aside, calibrates the scores on them and then learns from all; scoring is a map over all texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import crc_of_id, small_batches

DIMS = 1 << 20
#: Labelled rows that the fit reads, in expectation (a hash of the id selects them).
MAX_ROWS = 16_000
THRESHOLD = 0.7
#: (alpha, l1) among which a fit chooses by the log-loss on the rows kept aside, the first of equal ones: a plain grid around the
#: values of an earlier version, fixed before its own scores were looked at.
SETTINGS = ((0.5, 2.0), (2.0, 2.0), (0.5, 8.0), (2.0, 8.0))
#: One text in so many of the sample is kept aside (a hash of the text decides, so copies stay together).
ASIDE = 5
#: Passes over the rows of a fit, and of each trial of a setting.
PASSES, TRIAL_PASSES = 6, 3

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - DIMS.bit_length() + 1)
_PIECE = 1 << 16


def features(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Distinct buckets of the words, of neighbours and of pairs that skip one word, over the whole lower-cased text.

    ``known`` caches word hashes and is emptied when it has grown large.
    """
    found, tail = [np.zeros(0, dtype=np.int64)], np.zeros(0, dtype=np.uint64)

    def take(part: list[int]) -> None:
        nonlocal tail
        new = np.array(part, dtype=np.uint64)
        h, had = np.concatenate([tail, new]), len(tail)
        codes = [new * _A, (h[:-1] * _A + _B) ^ (h[1:] * _C), (h[:-2] * _B + _A) ^ (h[2:] * _A)]
        if had > 1:
            codes[1] = codes[1][1:]  # the pair of the two carried words was taken before
        found.append(np.unique(np.concatenate([(c * _A) >> _SHIFT for c in codes]).astype(np.int64)))
        tail = h[-2:]

    part: list[int] = []
    for word in _WORD.finditer((text or "").lower()):
        w = word[0]
        x = known.get(w)
        if x is None:
            if len(known) > 500_000:
                known.clear()
            x = known[w] = xxhash.xxh64_intdigest(w)
        part.append(x)
        if len(part) == _PIECE:
            take(part)
            part = []
    if part:
        take(part)
    return found[-1] if len(found) == 2 else np.unique(np.concatenate(found))


@dataclass
class Ftrl:
    """McMahan and others (2013): w_i = 0 while abs(z_i) <= l1, else -(z_i - sign(z_i) l1) / ((beta + sqrt(n_i)) / alpha + l2)."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0

    def __post_init__(self):
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)  # the last is the intercept

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(i == DIMS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, i: np.ndarray, label: int) -> None:
        i = np.append(i, DIMS)
        w = self.weights(i)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - step * w
        self.n[i] += g * g


def log_loss(w: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> float:
    s = np.clip([w[i].sum() + w[-1] for i, _ in rows], -35, 35)
    return float(np.mean(np.logaddexp(0, np.where([y for _, y in rows], -s, s))))


def learnt(rows: list[tuple[np.ndarray, int]], alpha: float, l1: float, passes: int) -> np.ndarray:
    model = Ftrl(alpha=alpha, l1=l1)
    for _ in range(passes):
        for i, y in rows:
            model.learn(i.astype(np.int64), y)
    return model.weights(np.arange(DIMS + 1))


def calibration(scores: np.ndarray, labels: np.ndarray, prior: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of the logistic curve that fits ``labels`` best (Platt), drawn towards 1 and 0 by ``prior`` rows' worth.

    Newton's method; without both labels 1 and 0."""
    if not 0 < labels.sum() < len(labels):
        return 1.0, 0.0
    t, x = np.array([1.0, 0.0]), np.stack([np.clip(scores, -35, 35), np.ones(len(scores))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -35, 35)))
        g = x.T @ (p - labels) + prior * (t - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(2), g)
        t = t - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return (float(t[0]), float(t[1])) if t[0] > 0 else (1.0, 0.0)


def fit(labelled: DataFrame, passes: int = PASSES) -> np.ndarray:
    """Weights (``DIMS`` + 1 floats, intercept last) learnt from ``labelled`` (doc_id, text, toxic), labels null are no labels.

    All rows go through one task, so ``labelled`` should come from ``labelled_sample``.  The order of learning is a hash of
    the id, so the weights do not depend on partitions.  Rows kept aside choose the setting and then set the slope and
    intercept of the scores, so that a score is a probability; the weights learnt from all rows are scaled by them.  Null and
    empty texts teach the intercept.  No rows: all zero.
    """
    aside = (F.pmod(F.xxhash64("text"), F.lit(ASIDE)) == 0).alias("aside")
    sample = labelled.filter(F.col("toxic").isNotNull()).select(F.xxhash64("doc_id").alias("h"), "text", F.col("toxic").cast("int").alias("y"), aside)

    def run(batches):
        known, rows, kept = {}, [], []
        for batch in batches:
            rows += [(features(text.as_py(), known).astype(np.int32), y) for text, y in zip(batch.column(1), batch.column(2).to_pylist())]
            kept += batch.column(3).to_pylist()
        test = [r for r, k in zip(rows, kept) if k]
        rest = [r for r, k in zip(rows, kept) if not k]
        best, slope, shift = SETTINGS[0], 1.0, 0.0
        if test and rest:
            best = min(SETTINGS, key=lambda s: log_loss(learnt(rest, *s, min(passes, TRIAL_PASSES)), test))
            w = learnt(rest, *best, passes)
            slope, shift = calibration(np.array([w[i].sum() + w[-1] for i, _ in test]), np.array([y for _, y in test]))
        w = slope * learnt(rows, *best, passes)
        w[-1] += shift if rows else 0
        every = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(every.astype(np.int32)), pa.array(w[every])], names=["i", "w"])

    # one task by design: online learning of about MAX_ROWS rows
    rows = small_batches(sample.repartition(1).sortWithinPartitions("h", "y", "text")).mapInArrow(run, "i int, w double").toArrow()
    out = np.zeros(DIMS + 1, dtype=np.float32)
    out[rows["i"].to_numpy()] = rows["w"].to_numpy()
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """About ``max_rows`` (at most all) labelled ids with their texts: as many *different* (id, label) rows, however often ``labels``
    repeats them.  The sampled labels are few enough to broadcast.  An id gives one row for each label it has, however often
    it occurs; of several texts the least one is taken (null if it has no other).  Null ids and labels are left out."""
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    share = min(1.0, max_rows / max(1, labels.count()))
    picked = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; only the text is read.  Null, empty and word-free texts get the
    intercept's score.  Repeated rows are kept; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        w, known = shared.value, {}
        for batch in batches:
            s = np.array([w[features(t.as_py(), known)].sum(dtype=np.float64) for t in batch.column(1)]) + float(w[-1])
            p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_of_id(id_col) % 3 == 1
