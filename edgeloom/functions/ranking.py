"""Gapless row numbers without sorting everything in one task.

Rows are cut into buckets that follow the order (a leading expression), bucket counts give the offsets, and only a bucket is
sorted at a time.  The offsets table has at most as many rows as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.functions.hashing import M

#: Buckets at least, and rows that a bucket holds on average in larger tables.
BUCKETS, BUCKET_ROWS = 2048, 1 << 18
#: Buckets of a hash or digest where the row count is not known: even ones, of 15 million rows in a table of 10**12.
HASH_BUCKETS = 1 << 16


def buckets_for(rows: int) -> int:
    """Buckets for a table of this many rows: a task sorts about ``BUCKET_ROWS`` of them, whatever the table's size."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def number_rows(df: DataFrame, bucket: Column, order: list, name: str = "row_id") -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``name`` along ``order``; ``bucket`` must not fall along that order, nulls first."""
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__bucket").orderBy(*order)
    rows = rows.withColumn("__place", F.row_number().over(own))
    joined = rows.join(F.broadcast(starts), F.col("__bucket").eqNullSafe(F.col("__b")))
    return joined.withColumn(name, (F.col("__start") + F.col("__place") - 1).cast("bigint")).drop("__bucket", "__b", "__start", "__place")


def by_hash(hashed: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a value of functions.hashing.h."""
    return F.floor(hashed / (M // buckets + 1))


def by_value(df: DataFrame, column: str) -> Column:
    """Buckets of equal width between the least and the greatest value of a numeric column; their number follows the count."""
    low, high, rows = df.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    if low is None:
        return F.lit(0)
    return F.floor((F.col(column) - F.lit(low)) * buckets_for(rows) / F.lit(high - low + 1))


def by_digest(digest: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a hexadecimal digest column: as many first digits (three at least) as give this many buckets."""
    return F.substring(digest, 1, max(3, -(-(buckets - 1).bit_length() // 4)))


def number_in_groups(df: DataFrame, group: list[str], slices: dict[str, Column], order: list, name: str) -> DataFrame:
    """``df`` with 0, 1, 2, ... along ``order`` inside each ``group`` in ``name``, without sorting a whole group in one task.

    ``slices`` are columns that cut a group and, taken together, do not fall along ``order``: only a slice is sorted at a
    time, and the counts of slices give the offsets."""
    cut = [f"__{s}" for s in slices]
    rows = df.withColumns({f"__{s}": c for s, c in slices.items()})
    sizes = rows.groupBy(*group, *cut).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"__of_{c}") for c in [*group, *cut]], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(*group, *cut).orderBy(*order)
    rows = rows.withColumn("__place", F.row_number().over(own))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*group, *cut]]
    return rows.join(starts, same).withColumn(name, (F.col("__start") + F.col("__place") - 1).cast("bigint")).select(*df.columns, name)
