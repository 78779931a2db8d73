"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting runs on the executors and is summed by (language, bucket); the log-probability matrix, at most ``MATRIX_BYTES``,
is broadcast; scoring gathers its rows for the n-grams of a batch and adds them up by text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import crc_of_id, small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled rows of each language that the fit reads, in expectation (a hash of the id selects them).
ROWS_PER_LANG = 8_000
#: Languages that a model knows at most: those with most rows (ties: first in alphabetical order).
MAX_LANGS = 4_096
#: Bytes of the matrix: with many languages it has fewer buckets.
MATRIX_BYTES = 64 << 20
#: Characters handled at a time.
CHUNK = 1 << 18
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (buckets, languages)
    prior: np.ndarray


def buckets_for(langs: int) -> int:
    """Buckets of a model: ``BUCKETS``, or the power of two that keeps the matrix within ``MATRIX_BYTES``."""
    return min(BUCKETS, 1 << ((MATRIX_BYTES // (8 * max(1, langs))).bit_length() - 1))


def ngrams(text: str, buckets: int = BUCKETS):
    """Buckets of all n-grams of the whole lower-cased text, chunk by chunk; ASCII characters other than letters are blanks."""
    longest, shift = max(ORDERS), np.uint64(64 - buckets.bit_length() + 1)
    text = text.lower()  # as a whole: some letters become two, and some depend on their neighbours
    for at in range(0, len(text), CHUNK):
        reach = text[max(0, at - longest + 1) : at + CHUNK]
        skip = min(at, longest - 1)
        c = np.frombuffer(reach.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c).astype(np.uint64)
        c = np.concatenate([np.array([32], dtype=np.uint64), c]) if not at else c
        code = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, longest + 1):  # code[i]: of the n characters that end at i
            code = np.concatenate([np.zeros(1, dtype=np.uint64), code[:-1]]) * np.uint64(0x100000001B3) + c + np.uint64(n)
            if n in ORDERS:
                from_ = max(n - 1, skip) if at else n - 1
                yield ((code[from_:] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def fit(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG, smoothing: float = 0.5) -> Model:
    """Model of ``labelled`` (doc_id, text, lang); rows whose lang or text is null teach nothing.  No rows: a model of no language.

    With more than ``MAX_LANGS`` languages the rarest teach nothing; repeated rows count each time."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGS).collect()}
    langs, buckets = sorted(sizes), buckets_for(len(sizes))
    if not langs:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    shares = F.broadcast(labelled.sparkSession.createDataFrame([(k, i, min(1.0, rows_per_lang / sizes[k])) for i, k in enumerate(langs)], "lang string, place int, share double"))
    picked = labelled.join(shares, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches):
        sums = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                for b in ngrams(text.as_py(), buckets):
                    own += np.bincount(b, minlength=buckets)
                if len(sums) > 64:  # a task's counts stay small; they are summed after it
                    yield from told(sums)
                    sums = {}
        yield from told(sums)

    def told(sums):
        for lang, own in sums.items():
            b = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), lang, dtype=np.int32)), pa.array(b.astype(np.int32)), pa.array(own[b])], names=["l", "b", "n"])

    rows = small_batches(picked.select("place", "text")).mapInArrow(count, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((buckets, len(langs)), smoothing)
    counts[rows["b"].to_numpy(), rows["l"].to_numpy()] += rows["n"].to_numpy()
    total = sum(sizes.values())
    return Model(langs, np.log(counts / counts.sum(axis=0)), np.log([sizes[k] / total for k in langs]))


def _totals(texts: list[str], model: Model) -> np.ndarray:
    """(texts, languages) sums of log-probabilities; buckets of several texts are gathered together, a few 100,000 at a time."""
    out = np.zeros((len(texts), len(model.langs)))
    limit = max(1 << 14, (1 << 21) // max(1, len(model.langs)))
    held, owner, size = [], [], 0

    def flush():
        nonlocal held, owner, size
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(out, owner, np.add.reduceat(model.logp[np.concatenate(held)], starts, axis=0))
        held, owner, size = [], [], 0

    for i, text in enumerate(texts):
        for b in ngrams(text, len(model.logp)):
            for at in range(0, len(b), limit):
                held.append(b[at : at + limit])
                owner.append(i)
                size += len(held[-1])
                if size >= limit:
                    flush()
    flush()
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; only the text is read.

    ``score`` is the posterior of the predicted language.  A text that is null or has no letter, and any text if the model
    knows no language, gets ``und`` and 0.  Ties go to the first language in alphabetical order.  Repeated rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None and m.langs and _LETTER.search(t)]
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if known:
                s = _totals([texts[i] for i in known], m) + m.prior
                best = s.argmax(axis=1)
                p = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                for i, j, q in zip(known, best.tolist(), p.tolist()):
                    langs[i], scores[i] = m.langs[j], q
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` (all columns, whatever their names) whose language is identified with a score of ``least`` or more.

    Null, empty and letter-free texts go, whatever their length; repeated rows stay or go together; an empty table gives an
    empty result, and a model of no language keeps nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        m, texts = shared.value, column.to_pylist()
        out = np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t is not None and m.langs and _LETTER.search(t)]
        if known:
            s = _totals([texts[i] for i in known], m) + m.prior
            out[known] = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
        return pa.array(out)

    return small_batches(docs).filter(score(F.col("text")) >= least)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_of_id(id_col) % 4 == 2
