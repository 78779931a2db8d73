"""Datasets, mappings, reports and checkpoints on disk, through Spark's writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.partition import bucket_sizes, partition_of, with_buckets


#: Edge ids whose rows of one bucket go to one file.
BUCKET_FILE_ROWS = 1 << 24


def write_dataset(path: str, splits: dict[str, DataFrame], num_nodes: int, parts: int, mappings: dict[str, DataFrame] | None = None) -> None:
    """``edges_<split>`` partitioned by (src_part, dst_part), bucket sizes with zeros, mappings, and a statistics row."""
    spark, stats = next(iter(splits.values())).sparkSession, {"num_nodes": num_nodes, "num_partitions": parts}
    for name, edges in splits.items():
        rows = with_buckets(edges, num_nodes, parts)
        # rows of a bucket go to several tasks where it is large, so a hot bucket is no single task (and has several files)
        part = F.floor(F.col("edge_id") / BUCKET_FILE_ROWS) if "edge_id" in rows.columns else F.pmod(F.xxhash64("src", "dst"), F.lit(8))
        rows.repartition("src_part", "dst_part", part).sortWithinPartitions("src_part", "dst_part", "src", "dst").write.mode("overwrite").partitionBy("src_part", "dst_part").parquet(f"{path}/edges_{name}")
        sizes = bucket_sizes(edges, num_nodes, parts)
        sizes.write.mode("overwrite").parquet(f"{path}/bucket_sizes_{name}")
        stats[f"num_{name}"] = sizes.agg(F.sum("edges")).first()[0]
    for name, m in (mappings or {}).items():
        m.write.mode("overwrite").parquet(f"{path}/{name}_mapping")
    spark.createDataFrame([(json.dumps(stats),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/statistics")


def read_bucket(spark: SparkSession, path: str, split: str, src_part: int, dst_part: int) -> DataFrame:
    return spark.read.parquet(f"{path}/edges_{split}").filter((F.col("src_part") == src_part) & (F.col("dst_part") == dst_part))


def write_partitions(table: DataFrame, path: str) -> None:
    """Node table by partition_id; only the partitions that occur are replaced."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_id").parquet(path)


def write_scores(rows: DataFrame, path: str) -> None:
    """CSV of src,[rel,]dst[,rank][,score] with header."""
    names = [c for c in ("src", "rel", "dst", "rank", "score") if c in rows.columns]
    rows.select(*names).write.mode("overwrite").option("header", True).csv(path)


def write_labels(rows: DataFrame, path: str) -> None:
    rows.select("id", "y_pred", "y_true").write.mode("overwrite").option("header", True).csv(path)


def write_checkpoint(path: str, number: int, tables: dict[str, DataFrame], meta: dict) -> str:
    """All tables of a checkpoint under a temporary name, then a rename, so a reader never sees half of it.

    A checkpoint of the same number is renamed first and deleted last: at every moment one of the two is whole, and
    ``read_checkpoint`` finds it."""
    spark = next(iter(tables.values())).sparkSession
    tmp, final = f"{path}/checkpoint_{number}_tmp", f"{path}/checkpoint_{number}"
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{tmp}/{name}")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp}/meta")
    fs, at = _files(spark, path)
    if fs.exists(at(final)):
        fs.delete(at(f"{final}_old"), True)
        if not fs.rename(at(final), at(f"{final}_old")):
            raise OSError(f"{final} could not be renamed")
    if not fs.rename(at(tmp), at(final)):
        raise OSError(f"{tmp} could not be renamed")
    fs.delete(at(f"{final}_old"), True)
    return final


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_checkpoint(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    fs, at = _files(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(f"{path}_old")):  # a writer stopped between its two renames
        path = f"{path}_old"
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, json.loads(spark.read.text(f"{path}/meta").first()[0])


def write_mapping_csv(mapping: DataFrame, path: str) -> None:
    """A node or relation mapping (raw_id, mapped_id) as CSV without header, in the order of the new ids."""
    mapping.select("raw_id", "mapped_id").repartitionByRange("mapped_id").sortWithinPartitions("mapped_id").write.mode("overwrite").csv(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds rows to a stored table; files that are there stay as they are."""
    rows.write.mode("append").parquet(path)


def write_encoded(encoded: DataFrame, path: str, num_nodes: int, parts: int) -> None:
    """Encoded nodes (node_id, x) by partition, so that a partition can be read alone."""
    write_partitions(encoded.withColumn("partition_id", partition_of("node_id", num_nodes, parts)), path)
