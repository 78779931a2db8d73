"""Work tables in the shared folder, checked broadcasts, salted joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with narrow rows may be broadcast (about 10 MB); larger sides are shuffled.
BROADCAST_ROWS = 100_000


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the cluster shares.

    Only a local session without that setting gets a temporary folder; a cluster without it falls back to the
    warehouse, which is shared too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = tempfile.mkdtemp(prefix="edgeloom-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/edgeloom-{uuid.uuid4().hex}"


_made: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors.

    The table goes when the driver ends (a lazy result may read it until then) or with ``release``."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    p, fs = _path(df.sparkSession, path)
    fs.deleteOnExit(p)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def made() -> int:
    """Work tables so far, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int) -> None:
    """Delete the work tables made after the first ``since``, but for the last one: nothing else of them is read any more."""
    for path in _made[since:-1]:
        p, fs = _path(spark, path)
        fs.delete(p, True)
    _made[since:] = _made[since:][-1:]


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (counted), else unchanged: then the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: Column, salts: int = 16) -> DataFrame:
    """Left join on ``key``; the rows of a hot key are spread over ``salts`` tasks.

    ``right`` has one row a key and is repeated ``salts`` times, so it should hold only keys that occur more than once.
    Nulls of ``key`` match nothing.
    """
    salt = "__salt"
    spread = left.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [key, salt], "left").drop(salt)
