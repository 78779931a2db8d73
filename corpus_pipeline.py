"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import bpe, common, exact_dedup, langid, mixing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: null, empty and letter-free texts, and those scored below 0.5.

    The model learns from the rows' own ``lang`` (null teaches nothing; if all are null, no document is identified)."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, model)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays, the longest, then that with the smallest id (null last).

    Null counts as empty, so one of null, empty and blank texts stays; exactly repeated rows collapse to one."""
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, a similarity of 0.8: one document of each group stays, that with the smallest id (null last).

    Texts without words are one group; ties between texts of one id go to the least digest."""
    return simhash.drop_near_copies(docs, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is drawn once at least; documents of small sources up to twice.  Null is a source of its own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and their digests, with ``doc_id, lang`` and ``source``; null and empty texts have none.

    A document that was drawn twice has two equal rows."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, keep=["lang", "source"], ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL cannot express a fitted classifier, a fingerprint of hashes, or byte-pair merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what only its stage needed is deleted.

    An empty table gives an empty result at every stage; other columns are carried through all but the last."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.made()
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
        common.release(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
