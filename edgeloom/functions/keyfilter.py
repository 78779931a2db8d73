"""Filters of keys: a bounded set of bits tells rows that cannot match from those that may, so that an exact join shuffles few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Bits of a key filter: 262,144 words of 64 bits at most, whatever the number of keys (about 6 MB as broadcast).
FILTER_BITS = 1 << 24


def _alike(rows: DataFrame, columns: list[Column], keys: DataFrame) -> tuple[list[Column], list[Column]]:
    """Both sides' columns in one type each, as hashes of an int and of a bigint differ."""
    ours, theirs = [], []
    for c, a, b in zip(columns, rows.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).schema, keys.schema):
        both = isinstance(a.dataType, IntegralType) and isinstance(b.dataType, IntegralType)
        if not both and a.dataType.simpleString() != b.dataType.simpleString():
            raise ValueError(f"{b.name}: {a.dataType.simpleString()} and {b.dataType.simpleString()} can't be compared")
        ours.append(c.cast("bigint") if both else c)
        theirs.append(F.col(f"`{b.name}`").cast("bigint") if both else F.col(f"`{b.name}`"))
    return ours, theirs


def with_maybe(rows: DataFrame, columns: list[Column], keys: DataFrame, name: str = "maybe", bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``name``: false where no row of ``keys`` (its columns in the same order) equals the row's ``columns``, null being a value.

    The keys' hashes set bits of at most ``bits``, which are broadcast.  With very many keys more rows are told true; what
    follows must be exact all the same."""
    ours, theirs = _alike(rows, columns, keys)
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(bits)).cast("bigint")
    word = lambda h: F.shiftright(h, 6)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), (h % 64).cast("int"))
    marks = keys.select(place(theirs).alias("h"))
    maps = F.broadcast(marks.groupBy(word(F.col("h")).alias("__word")).agg(F.bit_or(bit(F.col("h"))).alias("__bits")))
    joined = rows.join(maps, word(place(ours)) == F.col("__word"), "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit(place(ours))) != 0, F.lit(False))
    return joined.withColumn(name, hit).drop("__word", "__bits")


def maybe_among(rows: DataFrame, columns: list[Column], keys: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose ``columns`` may equal a row of ``keys``: no such row is lost, few others pass.  ``negate``: the other rows, none of
    which is among ``keys``."""
    flagged = with_maybe(rows, columns, keys, "__maybe")
    return flagged.filter(~F.col("__maybe") if negate else F.col("__maybe")).drop("__maybe")


#: Bits of a filter for Arrow functions at most (64 MB), bits a key, and the slices in which it is put together.
WIDE_BITS, BITS_A_KEY, WIDE_SLICES = 1 << 29, 16, 32


def _mixed(columns: list[np.ndarray], seed: int) -> np.ndarray:
    """64-bit hashes of the rows of integer columns."""
    x = np.full(len(columns[0]), seed, dtype=np.uint64)
    for c in columns:
        x = (x ^ c.astype(np.int64, copy=False).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def wide_places(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The two bits of each row in a filter of ``bits`` (a power of two)."""
    return [_mixed(columns, seed) & np.uint64(bits - 1) for seed in (1, 2)]


def wide_filter(keys: DataFrame) -> np.ndarray:
    """The bits, as bytes, that the rows of ``keys`` (bigint columns without nulls) set.  ``WIDE_BITS`` at most, whatever their number; a task
    sends the places of its keys once to those that put together a slice each."""
    bits = min(WIDE_BITS, max(1 << 16, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    own = bits // WIDE_SLICES

    def places(batches):
        for batch in batches:
            every = np.unique(np.concatenate(wide_places([c.to_numpy() for c in batch.columns], bits)))
            cuts = np.searchsorted(every, np.arange(WIDE_SLICES + 1, dtype=np.uint64) * np.uint64(own))
            parts = [(every[a:b] - np.uint64(k * own)).astype(np.uint32).tobytes() for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(range(WIDE_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "data"])

    def together(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.frombuffer(data, dtype=np.uint32)
                np.bitwise_or.at(held.setdefault(k, np.zeros(own // 8, dtype=np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k, data in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["slice", "data"])

    kind = "slice int, data binary"
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in keys.mapInArrow(places, kind).repartition(WIDE_SLICES, "slice").mapInArrow(together, kind).toLocalIterator():
        out[r["slice"] * own // 8 : (r["slice"] + 1) * own // 8] = np.frombuffer(bytes(r["data"]), dtype=np.uint8)
    return out


def wide_maybe(held: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """False for rows of ``columns`` that are certainly not among the keys of ``held``."""
    hit = np.ones(len(columns[0]), dtype=bool)
    for at in wide_places(columns, len(held) * 8):
        hit &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit
