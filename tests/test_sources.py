"""Readers and data sources on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import analyze, negatives
from edgeloom.sources import binary, readers


def test_quotes_headers_and_separators(spark, tmp_path):
    f = tmp_path / "q.tsv"
    f.write_text('"a\tr\tb"c\nd"\tr\te\n')
    assert [tuple(r) for r in readers.read_edges(spark, str(f), [0, 1, 2]).collect()] == [('"a', "r", 'b"c'), ('d"', "r", "e")]
    (tmp_path / "h").mkdir()
    for k in range(2):  # each file has its own header
        (tmp_path / "h" / f"{k}.txt").write_text(f"# file {k}\n# src.rel.dst\n" + "".join(f"{k}{i}.r.{i}\n" for i in range(5)))
    got = sorted(tuple(r) for r in readers.read_edges(spark, str(tmp_path / "h"), [0, 1, 2], sep=".", header_lines=2).collect())
    assert got == sorted((f"{k}{i}", "r", str(i)) for k in range(2) for i in range(5))
    assert readers.in_memory(spark.range(3)).count() == 3


def test_schedule_log(spark, tmp_path):
    line = "[info] [perf][epoch {e}][gpu 1][state {r}] phase=train state_idx=3 resident_partitions={p} active_buckets=16 active_edges={n} batches=7"
    (tmp_path / "a.log").write_text("noise\n" + "\n".join(line.format(e=1, r=r, p=p, n=n) for r, p, n in ((0, "4,5", 50), (0, "0,12", 10), (1, "2,3", 7))) + "\n[perf][epoch x]\n")
    rows = readers.read_schedule_log(spark, str(tmp_path / "a.log")).orderBy("round", "place").collect()
    assert [(r.epoch, r["round"], r.place, r.parts, r.edges, r.batches, r.buckets) for r in rows] == [(1, 0, 0, [0, 12], 10, 7, 16), (1, 0, 1, [4, 5], 50, 7, 16), (1, 1, 0, [2, 3], 7, 7, 16)]


@pytest.mark.parametrize("kind", ["int32", "int64"])
def test_flat_binary_edges(spark, tmp_path, monkeypatch, kind):
    binary.register(spark)
    rows = np.arange(3000).reshape(1000, 3) * (1 if kind == "int32" else 1 << 33)
    (tmp_path / "in").mkdir()
    rows[:600].astype(f"<{kind[0]}{int(kind[3:]) // 8}").tofile(tmp_path / "in" / "a.bin")
    rows[600:].astype(f"<{kind[0]}{int(kind[3:]) // 8}").tofile(tmp_path / "in" / "b.bin")
    read = lambda p: spark.read.format("edge_bytes").option("type", kind).load(str(p))
    assert sorted(tuple(r) for r in read(tmp_path / "in").collect()) == [tuple(map(int, r)) for r in rows]
    e = read(tmp_path / "in").withColumn("more", F.lit(1))
    e.repartition(3).write.format("edge_bytes").option("type", kind).mode("append").save(str(tmp_path / "out"))
    assert sorted(map(tuple, read(tmp_path / "out").collect())) == [tuple(map(int, r)) for r in rows]
    e.limit(0).write.format("edge_bytes").option("type", kind).mode("overwrite").save(str(tmp_path / "out"))
    assert read(tmp_path / "out").count() == 0
    (tmp_path / "in" / "a.bin").write_bytes(b"12345")
    with pytest.raises(Exception):
        read(tmp_path / "in").count()


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", v) for v in (5.0, 1.0, 4.0, None)] + [("b", None)], "k string, v double")
    got = {(r.k, r.p): (r.nearest, r.interpolated) for r in analyze.percentiles(rows, "v", (0.5, 0.9), ("k",)).collect()}
    assert got == {("a", 0.5): (4.0, 4.0), ("a", 0.9): (5.0, pytest.approx(4.8)), ("b", 0.5): (None, None), ("b", 0.9): (None, None)}


def test_pooled_negatives(spark):
    e = negatives.chunk_edges(spark.range(100).select(F.col("id").alias("edge_id")), 10, 2)
    got = {}
    for r in negatives.pooled(e, 4, 1000, 3).collect():
        got.setdefault((r.batch_id, r.chunk), {})[r.pos] = r.neg
    assert got[(0, 0)] == got[(1, 0)] == got[(2, 0)] != got[(3, 0)] and got[(0, 0)] != got[(0, 1)] and len(got) == 20
