"""A data source for flat binary edge files: rows of two to five little-endian integers, as embedding trainers store them.

``register(spark)`` makes the format known; then ``spark.read.format("edge_bytes").option("columns", 3).load(folder)`` reads all
files of a folder that the executors mount, in parallel by ranges of rows, and ``df.write.format("edge_bytes")`` writes a file a task.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from edgeloom.sources.readers import NAMES

#: Rows of an input partition and of an Arrow batch.
RANGE_ROWS, BATCH_ROWS = 1 << 22, 1 << 16


def _kind(options) -> np.dtype:
    if options.get("type", "int32") not in ("int32", "int64"):
        raise ValueError("type must be int32 or int64")
    return np.dtype(options.get("type", "int32")).newbyteorder("<")


class Range(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        self.path, self.first, self.rows = path, first, rows


class EdgeReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], kind: np.dtype):
        self.path, self.names, self.kind = path, names, kind

    def partitions(self) -> list[Range]:
        files = [self.path] if os.path.isfile(self.path) else sorted(f"{self.path}/{f}" for f in os.listdir(self.path) if f[0] not in "._")
        out, width = [], self.kind.itemsize * len(self.names)
        for f in files:
            size = os.path.getsize(f)
            if size % width:
                raise ValueError(f"{f}: {size} bytes are no whole number of rows of {width} bytes")
            out += [Range(f, at, min(RANGE_ROWS, size // width - at)) for at in range(0, size // width, RANGE_ROWS)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        width = len(self.names)
        if not partition.rows:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.first * width * self.kind.itemsize)
            left = partition.rows
            while left:
                n = min(left, BATCH_ROWS)
                rows = np.frombuffer(f.read(n * width * self.kind.itemsize), dtype=self.kind).reshape(n, width).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(width)], names=self.names)
                left -= n


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class EdgeWriter(DataSourceArrowWriter):
    """A task writes a hidden file of its own; the files get their names when all tasks are done."""

    def __init__(self, path: str, names: list[str], kind: np.dtype, overwrite: bool):
        self.path, self.names, self.kind, self.overwrite = path, names, kind, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        target = f"{self.path}/.part-{uuid.uuid4().hex}"
        limits = np.iinfo(self.kind)
        with open(target, "wb") as f:
            for batch in batches:
                rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in self.names], axis=1)
                if len(rows) and (rows.min() < limits.min or rows.max() > limits.max):
                    raise ValueError(f"an id does not fit {self.kind}")
                f.write(rows.astype(self.kind).tobytes())
        return Written(target)

    def commit(self, messages: list[Written | None]) -> None:
        old = [f for f in os.listdir(self.path) if f[0] not in "._"] if self.overwrite else []
        for m in messages:
            if m:
                os.rename(m.path, f"{self.path}/{os.path.basename(m.path)[1:]}.bin")
        for f in old:
            os.remove(f"{self.path}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class EdgeBytes(DataSource):
    """Options: ``path``, ``columns`` (2 to 5, default 3: src, rel, dst), ``type`` (int32 or int64)."""

    @classmethod
    def name(cls) -> str:
        return "edge_bytes"

    def _names(self) -> list[str]:
        return NAMES[int(self.options.get("columns", 3))]

    def schema(self) -> str:
        return ", ".join(f"{n} bigint" for n in self._names())

    def reader(self, schema) -> EdgeReader:
        return EdgeReader(self.options["path"], self._names(), _kind(self.options))

    def writer(self, schema, overwrite: bool) -> EdgeWriter:
        names = self._names()
        if missing := [n for n in names if n not in schema.names]:
            raise ValueError(f"missing columns: {missing}")
        return EdgeWriter(self.options["path"], names, _kind(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EdgeBytes)
