"""Exact dedup with a heavy-hitter split (DataFrame functions only).

A Misra-Gries pass (``freqItems``, the Karp-Schenker-Papadimitriou form of it) names every digest that may hold more than
``support`` of the rows.  Exact counts verify them; the winners of the verified ones, fewer than ``1 / support`` rows, are
broadcast, and their copies are resolved on the map side without a shuffle.  All other digests are counted with partial sums
before the shuffle; none of those groups can hold more than ``support`` of the rows, and the join that brings a group's winner
back to its rows spreads them over several tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import materialise, one_each, salted_left_join, without

SUPPORT = 1 / 1024


def normalised(text_col: str = "text"):
    """The text without ``[\\x20\\x09-\\x0D]``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _groups(docs: DataFrame, support: float) -> DataFrame:
    """``exact_groups`` with ``n_points`` (code points of the original text) and ``best``: as long and with the same id as the row that stays."""
    rows = materialise(
        docs.select(
            "doc_id",
            F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"),
            F.sha2(normalised().cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),  # fixed by the table; it only tells repeated rows apart
        )
    )
    order = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    spark = docs.sparkSession
    total = rows.count()
    # bounded: Misra-Gries keeps at most 1 / support candidates
    found = rows.stat.freqItems(["text_sha256"], support).first()[0] if total else []
    candidates = spark.createDataFrame([(x,) for x in found], "text_sha256 string")
    heavy = (
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
        .filter(F.col("group_size") >= max(2, math.ceil(total * support)))
    )
    heavy = materialise(heavy)
    winners = F.broadcast(heavy)  # fewer than 1 / support rows by the verified count
    columns = ["doc_id", "n_points", "row", "first", "group_size", "text_sha256"]
    frequent = rows.join(winners, "text_sha256", "inner").select(*columns)
    others = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    several = others.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first")).filter("group_size > 1")
    others = salted_left_join(others, several, "text_sha256", F.col("row"))
    others = others.withColumn("first", F.coalesce("first", order)).withColumn("group_size", F.coalesce("group_size", F.lit(1))).select(*columns)
    best = (F.col("n_points") == -F.col("first.a")) & F.col("doc_id").eqNullSafe(F.col("first.c"))
    return frequent.unionByName(others).select(
        "doc_id", F.col("first.c").alias("keep_id"), "group_size", (F.col("row") == F.col("first.d")).alias("kept"), "text_sha256", "n_points", best.alias("best")
    )


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal: same text after white space is deleted; null counts as empty.  The row with the most code points in its original
    text stays, then the smallest ``doc_id`` (null last); of rows that repeat both, one (whichever) is kept, so a group has
    exactly one kept row.  An empty table gives an empty result.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    return _groups(docs, support).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs`` (all columns, whatever their names) with the one row of every group that ``exact_groups`` keeps.

    A row is known by ``doc_id`` (null is a value), text and length, so of rows that share an id but not a text each is judged
    by its own text, and rows that repeat all three collapse to one.  An empty table gives an empty result.
    """
    groups = materialise(_groups(docs, support).filter("group_size > 1").select("doc_id", "text_sha256", "n_points", "best", "kept"))
    own = [F.col("doc_id"), F.sha2(normalised().cast("binary"), 256), F.char_length(F.coalesce("text", F.lit("")))]
    key = ["doc_id", "text_sha256", "n_points"]
    tied = groups.filter("best").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    return without(one_each(docs, own, materialise(tied)), own, materialise(groups.filter("NOT best").select(*key).distinct()))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
