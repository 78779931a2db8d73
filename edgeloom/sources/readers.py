"""Edge sources: delimited files, in-memory arrays, dataset presets, log files."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAMES = {2: ["src", "dst"], 3: ["src", "rel", "dst"], 4: ["src", "rel", "dst", "qval"], 5: ["src", "rel", "dst", "qrel", "qval"]}


def read_edges(spark: SparkSession, path: str | list[str], columns: list[int], sep: str = "\t", header_lines: int = 0) -> DataFrame:
    """Edges as strings.  ``columns`` are positions in the file in the order src, [rel,] dst[, [qrel,] qval]; so [0, 2, 1] reads a
    file of src, dst, rel.  Quote signs are ordinary characters.  gz and bz2 are read as they are.

    With several header lines, those of each file are looked at first and left out wherever they occur in it."""
    if len(columns) not in NAMES:
        raise ValueError("two to five columns are supported")
    width = max(columns) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    if header_lines <= 1:
        rows = spark.read.schema(schema).option("sep", sep).option("quote", "").option("header", header_lines == 1).option("enforceSchema", True).csv(path)
    else:
        rows = None
        for file in spark.read.text(path).inputFiles():
            lines = spark.read.text(file)
            own = lines.filter(~F.col("value").isin([r[0] for r in lines.take(header_lines)]))
            rows = own if rows is None else rows.unionByName(own)
        rows = spark.createDataFrame([], "value string") if rows is None else rows
        parts = _split("value", sep)
        rows = rows.filter(F.trim("value") != "").select(*[F.get(parts, i).alias(f"c{i}") for i in range(width)])
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in zip(columns, NAMES[len(columns)])])


def _split(column: str, sep: str):
    return F.split(F.col(column), rf"\Q{sep}\E")


def read_splits(spark: SparkSession, paths: str | list[str], columns: list[int], sep: str = "\t", header_lines: int = 0) -> DataFrame:
    """Edges of one file, or of three (train, valid, test) with their names in ``split``; one file has null there."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if len(paths) not in (1, 3):
        raise ValueError("a dataset is one file, or three: train, valid and test")
    names = [None] if len(paths) == 1 else ["train", "valid", "test"]
    parts = [read_edges(spark, p, columns, sep, header_lines).withColumn("split", F.lit(n).cast("string")) for p, n in zip(paths, names)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).unionByName(parts[2])


def in_memory(table: DataFrame) -> DataFrame:
    """``table`` kept in the executors' memory, on their disks where it does not fit; ``unpersist()`` frees it."""
    from pyspark import StorageLevel

    return table.persist(StorageLevel.MEMORY_AND_DISK)


def from_arrays(spark: SparkSession, edges: np.ndarray) -> DataFrame:
    """(n, 2..5) integer array."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(np.asarray(edges), columns=NAMES[edges.shape[1]]))


@dataclass
class Preset:
    """Shape of a public dataset's edge files (no download)."""

    columns: list[int] = field(default_factory=lambda: [0, 1])
    sep: str = "\t"
    header_lines: int = 0
    split: tuple[float, ...] | None = None
    node_task: bool = False


#: Column order, separator and split of public datasets.
PRESETS = {
    "fb15k": Preset([0, 1, 2]),
    "fb15k_237": Preset([0, 1, 2]),
    "freebase86m": Preset([0, 2, 1]),
    "friendster": Preset([0, 1]),
    "livejournal": Preset([0, 1], split=(0.9, 0.05, 0.05)),
    "twitter": Preset([0, 1], " ", split=(0.9, 0.05, 0.05)),
    "wikidata5m": Preset([0, 1, 2]),
    "ogbl_citation2": Preset([0, 1]),
    "ogbl_ppa": Preset([0, 1]),
    "ogbl_wikikg2": Preset([0, 1, 2]),
    "ogb_wikikg90mv2": Preset([0, 1, 2]),
    "ogbn_arxiv": Preset([0, 1], ",", node_task=True),
    "ogbn_products": Preset([0, 1], ",", node_task=True),
    "ogbn_papers100m": Preset([0, 1], ",", node_task=True),
    "ogb_mag240m": Preset([0, 1], ",", node_task=True),
}


def read_preset(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    p = PRESETS[name]
    return read_edges(spark, path, p.columns, p.sep, p.header_lines)


def read_epoch_log(spark: SparkSession, path: str, first: int = 5) -> DataFrame:
    """Average of the first epoch runtimes of each log file: lines ``Epoch runtime: <n>ms``."""
    rows = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("ms", F.expr(r"try_cast(regexp_extract(value, 'Epoch runtime: ([0-9.]+) ?ms', 1) AS double)")).filter("ms IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    return rows.withColumn("n", n).filter(F.col("n") <= first).groupBy("file").agg(F.avg("ms").alias("epoch_ms"), F.count(F.lit(1)).alias("epochs"))


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, mrr, hits`` of the last evaluation in each log file: a line with ``MRR: <x>`` and one with ``Hits@10: <x>``."""
    rows = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    number = lambda name: F.expr(rf"try_cast(regexp_extract(value, '{name}: ([0-9.]+)', 1) AS double)")
    rows = rows.withColumn("mrr", number("MRR")).withColumn("hits", number("Hits@10")).filter("mrr IS NOT NULL OR hits IS NOT NULL")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return rows.groupBy("file").agg(last("mrr").alias("mrr"), last("hits").alias("hits"))


def read_node_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``raw_id, features, label`` from a file of id, label and features; a label that is missing or not a number is -1."""
    parts = _split("value", sep)
    rows = spark.read.text(path).withColumn("p", parts)
    label = F.expr("coalesce(try_cast(try_cast(get(p, 1) AS double) AS int), -1)")
    features = F.expr("transform(slice(p, 3, greatest(size(p) - 2, 0)), v -> try_cast(v AS float))")
    return rows.select(F.expr("get(p, 0)").alias("raw_id"), features.alias("features"), label.alias("label"))


def read_schedule_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, epoch, round, place, parts, edges, batches, buckets`` of the states that a training log reports, a line each:
    ``[perf][epoch <e>][gpu <g>][state <round>] phase=<name> state_idx=<i> resident_partitions=<a,b,...> active_buckets=<n> active_edges=<n> batches=<n>``.

    States of a round are in the order of their partitions; other lines are left out."""
    line = r"\[perf\]\[epoch (\d+)\]\[gpu \d+\]\[state (\d+)\] phase=\w+ state_idx=\d+ resident_partitions=([0-9,]+) active_buckets=(\d+) active_edges=(\d+) batches=(\d+)"
    rows = spark.read.text(path).withColumn("file", F.input_file_name()).filter(F.col("value").rlike(line))
    at = lambda k: F.regexp_extract("value", line, k)
    parts = F.transform(F.filter(F.split(at(3), ","), lambda x: x != ""), lambda x: x.cast("int"))
    rows = rows.select("file", at(1).cast("int").alias("epoch"), at(2).cast("int").alias("round"), parts.alias("parts"), *[at(k).cast("bigint").alias(n) for k, n in ((5, "edges"), (6, "batches"), (4, "buckets"))])
    place = F.row_number().over(Window.partitionBy("file", "epoch", "round").orderBy("parts")) - 1  # a round has a state a device
    return rows.withColumn("place", place).select("file", "epoch", "round", "place", "parts", "edges", "batches", "buckets")
