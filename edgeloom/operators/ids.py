"""Dictionary encoding of nodes and relations.

New ids follow the order of the MD5 digest of the raw id: a random permutation that any engine can repeat and that cuts into
even buckets, so ids are dense without a single-task sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.ranking import HASH_BUCKETS, by_digest, number_rows


def distinct_values(df: DataFrame, columns: list[str], name: str = "raw_id") -> DataFrame:
    """Distinct non-null values of several columns as strings: one pass over the table."""
    values = F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias(name)
    return df.select(values).filter(F.col(name).isNotNull()).distinct()


def encode(values: DataFrame, first: Column | None = None) -> DataFrame:
    """``raw_id`` (distinct) -> ``raw_id, mapped_id``.  Rows with ``first`` true get the lowest ids."""
    rank = F.lit(0) if first is None else F.when(first, 0).otherwise(1)
    rows = values.withColumn("digest", F.md5(F.col("raw_id").cast("binary"))).withColumn("later", rank)
    bucket = F.concat(F.col("later").cast("string"), by_digest("digest", HASH_BUCKETS))
    return number_rows(rows, bucket, ["later", "digest", "raw_id"], "mapped_id").select("raw_id", "mapped_id")


def encode_nodes(edges: DataFrame, columns: tuple[str, ...] = ("src", "dst"), known: DataFrame | None = None) -> DataFrame:
    values = distinct_values(edges, list(columns))
    return encode(values if known is None else values.union(known.select(F.col("raw_id").cast("string"))).distinct())


def encode_relations(edges: DataFrame, columns: tuple[str, ...] = ("rel",)) -> DataFrame:
    """Relations and qualifier relations share one namespace."""
    return encode(distinct_values(edges, list(columns)))


def apply_mapping(edges: DataFrame, mapping: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Replace raw ids by mapped ones, a join per column; ids that the mapping lacks become null."""
    for c in columns:
        m = mapping.select(F.col("raw_id").alias("__raw"), F.col("mapped_id").alias("__new"))
        edges = edges.join(m, F.col(c).cast("string") == F.col("__raw"), "left").withColumn(c, F.col("__new")).drop("__raw", "__new")
    return edges


def sequential_train_ids(edges: DataFrame, train: DataFrame) -> DataFrame:
    """Nodes of ``train`` (raw_id) get the lowest ids."""
    values = distinct_values(edges, ["src", "dst"])
    marked = values.join(train.select(F.col("raw_id").cast("string")).distinct().withColumn("known", F.lit(True)), "raw_id", "left")
    return encode(marked, F.coalesce("known", F.lit(False)))


def top_degree(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest in + out degree (ties: smallest raw id): ``raw_id, degree``."""
    ends = edges.select(F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("raw_id"))
    return ends.groupBy("raw_id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.col("degree").desc(), "raw_id").limit(k)


def remap_nodes(table: DataFrame, mapping: DataFrame, label: str | None = None) -> DataFrame:
    """Node table (raw_id, ...) under the new ids; nodes without a row keep nulls, their label is -1."""
    out = mapping.join(table.withColumn("raw_id", F.col("raw_id").cast("string")), "raw_id", "left").drop("raw_id")
    return out.withColumn(label, F.coalesce(label, F.lit(-1))) if label else out


def local_ids(batch: DataFrame, columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Batch-local ids: the rank of each distinct node of a batch.  A batch is small by construction."""
    from pyspark.sql.window import Window

    nodes = batch.select("batch_id", F.explode(F.array(*columns)).alias("node_id")).distinct()
    return nodes.withColumn("local_id", (F.row_number().over(Window.partitionBy("batch_id").orderBy("node_id")) - 1).cast("bigint"))
