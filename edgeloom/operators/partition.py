"""Partitioning, bucketing, splitting, shuffling and batching of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.functions.hashing import h
from edgeloom.functions.ranking import HASH_BUCKETS, buckets_for, by_hash, by_value, number_in_groups, number_rows


def partition_size(num_nodes: int, parts: int) -> int:
    return -(-num_nodes // parts)


def partition_of(node: str | Column, num_nodes: int, parts: int) -> Column:
    c = F.col(node) if isinstance(node, str) else node
    return F.floor(c / partition_size(num_nodes, parts)).cast("int")


def with_buckets(edges: DataFrame, num_nodes: int, parts: int) -> DataFrame:
    """Adds ``src_part, dst_part``; every arity is bucketed by src and dst."""
    return edges.withColumn("src_part", partition_of("src", num_nodes, parts)).withColumn("dst_part", partition_of("dst", num_nodes, parts))


def bucket_sizes(edges: DataFrame, num_nodes: int, parts: int) -> DataFrame:
    """``src_part, dst_part, edges`` for all parts x parts buckets, empty ones included."""
    spark = edges.sparkSession
    grid = spark.range(parts * parts).select(F.floor(F.col("id") / parts).cast("int").alias("src_part"), (F.col("id") % parts).cast("int").alias("dst_part"))
    counts = with_buckets(edges, num_nodes, parts).groupBy("src_part", "dst_part").agg(F.count(F.lit(1)).alias("edges"))
    return grid.join(counts, ["src_part", "dst_part"], "left").na.fill(0, ["edges"])


def order_by_bucket(edges: DataFrame, num_nodes: int, parts: int, seed: int | None = None) -> DataFrame:
    """Edges range-partitioned and sorted by bucket; with a seed shuffled inside each bucket."""
    rows = with_buckets(edges, num_nodes, parts)
    keys = ["src_part", "dst_part"] + ([h(seed, "edge_id")] if seed is not None else [])
    return rows.repartitionByRange("src_part", "dst_part").sortWithinPartitions(*keys)


def permuted(edges: DataFrame, permutation: DataFrame) -> DataFrame:
    """Edges under a permutation (node_id, new_id)."""
    for c in ("src", "dst"):
        edges = edges.join(permutation.select(F.col("node_id").alias(c), F.col("new_id").alias("__new")), c).withColumn(c, F.col("__new")).drop("__new")
    return edges


def shuffled_rank(edges: DataFrame, seed: int, name: str = "place", rows: int | None = None) -> DataFrame:
    """Place of every edge in a full shuffle; ``rows`` is their number, if it is known."""
    buckets = HASH_BUCKETS if rows is None else buckets_for(rows)
    return number_rows(edges.withColumn("__h", h(seed, "edge_id")), by_hash(F.col("__h"), buckets), ["__h", "edge_id"], name).drop("__h")


def split(edges: DataFrame, fractions: tuple[float, ...], seed: int = 1) -> DataFrame:
    """Adds ``split``: train / valid / test for three fractions, train / test for two, with exact counts.

    The last part ends at the sum of the fractions of all rows, so it takes what rounding down leaves over; rows beyond that sum
    are in no split and are left out."""
    total = edges.count()
    names = ("train", "valid", "test") if len(fractions) == 3 else ("train", "test")
    label, end = None, 0
    for name, f in zip(names, fractions):
        # rounded: a sum of fractions may lie just below 1
        end = end + int(total * f) if name != "test" else int(round(sum(fractions), 9) * total)
        label = F.when(F.col("__at") < end, name) if label is None else label.when(F.col("__at") < end, name)
    return shuffled_rank(edges, seed, "__at", total).withColumn("split", label).drop("__at").filter(F.col("split").isNotNull())


def hold_out(edges: DataFrame, k: int, seed: int = 12345) -> DataFrame:
    """Adds ``held_out``: true for the k edges that come first in a shuffle."""
    return shuffled_rank(edges, seed, "__at").withColumn("held_out", F.col("__at") < k).drop("__at")


def batches(edges: DataFrame, size: int, row_id: str = "edge_id") -> DataFrame:
    return edges.withColumn("batch_id", F.floor(F.col(row_id) / size))


def bucket_slices(edges: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds ``slice`` (number inside the bucket) and ``slice_order`` (hash by which slices are streamed)."""
    rows = _numbered_in_bucket(edges, "__at").withColumn("slice", F.floor(F.col("__at") / block)).drop("__at")
    return rows.withColumn("slice_order", h(seed, F.col("src_part") * 65536 + F.col("dst_part"), "slice"))


#: Row ids of a bucket that are numbered together.
SLICE_ROWS = 1 << 18
BUCKET = ["src_part", "dst_part"]
#: Slices of a bucket that is shuffled.
SHUFFLE_SLICES = 256


def _numbered_in_bucket(edges: DataFrame, name: str) -> DataFrame:
    return number_in_groups(edges, BUCKET, {"ids": F.floor(F.col("edge_id") / SLICE_ROWS)}, ["edge_id"], name)


def active_edges(edges: DataFrame, state_buckets: DataFrame) -> DataFrame:
    """Edges of the given buckets: a semi-join on the partition columns, so only their files are read.  A schedule has at most
    parts x parts buckets, hence the broadcast."""
    return edges.join(F.broadcast(state_buckets.select("src_part", "dst_part").distinct()), ["src_part", "dst_part"], "left_semi")


def resident_slot(node: Column, slots: Column, size: int, num_nodes: int, parts: int) -> Column:
    """Slot x size + offset of a resident node; ``slots`` maps a partition to its slot, others raise an error."""
    part = partition_of(node, num_nodes, parts)
    slot = F.element_at(slots, part)
    return F.when(slot.isNull(), F.raise_error(F.lit("partition is not resident"))).otherwise(slot * size + node - part * size)


def row_range(edges: DataFrame, first: int, count: int, row_id: str = "edge_id") -> DataFrame:
    """A contiguous slice; the bounds reach the scan, and files that were written in row order are skipped by their statistics."""
    return edges.filter(F.col(row_id).between(first, first + count - 1))


def ordered_in_bucket(edges: DataFrame, by: str) -> DataFrame:
    """Adds ``place``: position of an edge in its bucket when the bucket is sorted by ``by`` (ties: edge_id)."""
    return number_in_groups(edges, BUCKET, {"end": F.col(by), "ids": F.floor(F.col("edge_id") / SLICE_ROWS)}, [by, "edge_id"], "place")


def shuffled_in_bucket(edges: DataFrame, seed: int) -> DataFrame:
    """Adds ``place``: position of an edge in a shuffle of its bucket."""
    rows = edges.withColumn("__h", h(seed, "edge_id"))
    return number_in_groups(rows, BUCKET, {"hash": by_hash(F.col("__h"), SHUFFLE_SLICES)}, ["__h", "edge_id"], "place").drop("__h")


def merge_sorted(base: DataFrame, delta: DataFrame, by: str) -> DataFrame:
    """Base and delta edges as one table with ``place`` along ``by``, then base before delta, then edge_id.

    Buckets follow ``by``; a bucket is numbered in slices of (by, added, range of ids), so a hub's edges are not one task."""
    both = base.withColumn("added", F.lit(0)).unionByName(delta.withColumn("added", F.lit(1)))
    both = both.withColumn("__range", by_value(both, by))
    rows = number_in_groups(both, ["__range"], {"end": F.col(by), "added": F.col("added"), "ids": F.floor(F.col("edge_id") / SLICE_ROWS)}, [by, "added", "edge_id"], "__at")
    sizes = both.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rows = rows.join(F.broadcast(starts), F.col("__range").eqNullSafe(F.col("__r")))
    return rows.withColumn("place", F.col("__start") + F.col("__at")).drop("__range", "__r", "__start", "__at")


def every_nth(edges: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th edge of each bucket, in order of edge_id."""
    return _numbered_in_bucket(edges, "__at").filter(F.col("__at") % stride == 0).drop("__at")
