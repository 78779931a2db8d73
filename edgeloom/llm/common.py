"""Helpers shared by the training-data operators: anti-joins that shuffle few texts, small batches; the rest is the library's."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.keyfilter import maybe_among  # noqa: F401
from edgeloom.functions.work import checked_broadcast, made, materialise, release, salted_left_join, work_dir  # noqa: F401

#: Bytes of an Arrow batch of texts.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python in batches of ``BATCH_BYTES`` unless the session says otherwise: some texts are very long, and
    what a worker and its JVM hold grows with a batch."""
    if _BATCH not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return df


def without(docs: DataFrame, columns: list[Column], keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``columns`` equal a row of ``keys`` (null equals null); other columns may have any names.

    Few keys are broadcast.  Many are joined, but only rows that pass a filter of the keys are shuffled with their texts.
    """
    keys = keys.toDF(*[f"__key{i}" for i in range(len(columns))]).distinct()
    marked, own, row = _marked(docs, columns)  # a column is computed once, however often the join's condition names it
    same = reduce(and_, [c.eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(own)])
    few = checked_broadcast(keys)
    if few is not keys:
        return marked.join(few, same, "left_anti").select(f"{row}.*")
    kept = maybe_among(marked, own, keys).join(keys, same, "left_anti").unionByName(maybe_among(marked, own, keys, negate=True))
    return kept.select(f"{row}.*")


def one_each(docs: DataFrame, columns: list[Column], keys: DataFrame) -> DataFrame:
    """``docs`` with one row, whichever, of those whose ``columns`` equal a row of ``keys``; all other rows stay."""
    if keys.isEmpty():
        return docs
    marked, own, row = _marked(docs, columns)
    keys = keys.toDF(*[f"__key{i}" for i in range(len(columns))]).distinct()
    same = reduce(and_, [c.eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(own)])
    repeated = maybe_among(marked, own, keys).join(keys, same, "left_semi")
    one = repeated.groupBy(*own).agg(F.first(row).alias(row)).select(f"{row}.*")  # pre-aggregated: a hot row is no hot task
    return without(docs, columns, keys).unionByName(one)


def _marked(docs: DataFrame, columns: list[Column]) -> tuple[DataFrame, list[Column], str]:
    row = "__row"
    return docs.select(F.struct("*").alias(row), *[c.alias(f"__own{i}") for i, c in enumerate(columns)]), [F.col(f"__own{i}") for i in range(len(columns))], row


def crc_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))
