import json
from dataclasses import replace

import pytest

from edgeloom.plans import runs
from edgeloom.sources import sinks


def lines(n, first=0):
    return "".join(f"n{i % 40}\tr{i % 3}\tn{(i * 7 + 1) % 40}\n" for i in range(first, first + n))


@pytest.mark.parametrize("more", [{}, {"decoder": "transe", "loss": "ranking", "reduction": "mean", "strategy": "dns", "dense_optimizer": "adam"}, {"decoder": "complex", "strategy": "gan", "loss": "bce_logits"}])
def test_preprocess_train_evaluate(spark, tmp_path, more):
    f = tmp_path / "edges.tsv"
    f.write_text(lines(300))
    c = runs.Config(dataset=str(tmp_path / "set"), edges=str(f), partitions=4, dim=8, batch=50, chunks=2, negatives=6, epochs=2, **more)
    assert runs.preprocess(spark, c) == {"num_nodes": 40, "num_relations": 3}
    assert spark.read.parquet(f"{c.dataset}/edges_train").count() == 270
    path = runs.train(spark, c)
    got = runs.evaluate(spark, c, path).first()
    assert 0 < got.mrr <= 1 and got.n == 15
    tables, meta = sinks.read_checkpoint(spark, path, ["nodes", "relations"])
    before, _ = sinks.read_checkpoint(spark, f"{c.dataset}/checkpoint_0", ["relations"])
    x = lambda t: {r.rel: r.x for r in t.collect()}
    assert all(a != b for a, b in zip(x(tables["relations"]).values(), x(before["relations"]).values()))  # relations learn too
    assert meta["epoch"] == 2 and meta["loss"] == meta["loss"]


def test_three_files_and_given_ids(spark, tmp_path):
    files = []
    for k, (name, n) in enumerate((("train", 60), ("valid", 20), ("test", 10))):
        files.append(str(tmp_path / f"{name}.txt"))
        (tmp_path / f"{name}.txt").write_text("".join(f"{i % 9} {i % 2} {(i + k) % 9}\n" for i in range(n)))
    c = runs.Config(dataset=str(tmp_path / "set"), edges=files, sep=" ", partitions=2, remap_ids=False, num_nodes=12, num_relations=2)
    assert runs.preprocess(spark, c) == {"num_nodes": 12, "num_relations": 2}
    sizes = {n: spark.read.parquet(f"{c.dataset}/edges_{n}").count() for n in ("train", "valid", "test")}
    assert sizes == {"train": 60, "valid": 20, "test": 10}
    got = sorted((r.src, r.rel, r.dst) for r in spark.read.parquet(f"{c.dataset}/edges_test").collect())
    assert got == sorted((i % 9, i % 2, (i + 2) % 9) for i in range(10))
    with pytest.raises(ValueError):
        runs.preprocess(spark, replace(c, num_nodes=5))
    with pytest.raises(ValueError):
        runs.Config(remap_ids=False)
    first = replace(c, remap_ids=True, train_nodes_first=True, dataset=str(tmp_path / "other"))
    (tmp_path / "test.txt").write_text("0 0 new\n")
    runs.preprocess(spark, first)
    ids = {r.raw_id: r.mapped_id for r in spark.read.parquet(f"{first.dataset}/node_mapping").collect()}
    assert ids["new"] == 9 and len(ids) == 10
    sinks.write_mapping_csv(spark.read.parquet(f"{first.dataset}/node_mapping"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv")).count() == 10
    with pytest.raises(ValueError):
        runs.preprocess(spark, replace(c, edges=files[:2]))


def test_a_checkpoint_is_never_lost(spark, tmp_path):
    t = spark.range(3)
    path = sinks.write_checkpoint(str(tmp_path), 4, {"x": t}, {"v": 1})
    assert sinks.write_checkpoint(str(tmp_path), 4, {"x": t.limit(1)}, {"v": 2}) == path
    assert sinks.read_checkpoint(spark, path, ["x"])[1] == {"v": 2}
    (tmp_path / "checkpoint_4").rename(tmp_path / "checkpoint_4_old")  # as if the writer had stopped
    tables, meta = sinks.read_checkpoint(spark, path, ["x"])
    assert meta == {"v": 2} and tables["x"].count() == 1
    sinks.write_checkpoint(str(tmp_path), 4, {"x": t}, {"v": 3})
    assert sinks.read_checkpoint(spark, path, ["x"])[1] == {"v": 3}


def test_config():
    assert runs.Config(**json.loads(runs.template())) == runs.Config()
    for bad in ({"columns": [0]}, {"loss": "x"}, {"strategy": "x"}, {"remap_ids": False, "num_nodes": 1, "num_relations": 1, "top_degree_first": 3}):
        with pytest.raises(ValueError):
            replace(runs.Config(), **bad)


def test_presets():
    c = runs.Config.of_preset("twitter", "t.txt", "out", dim=16)
    assert (c.columns, c.sep, c.split, c.dim) == ([0, 1], " ", [0.9, 0.05, 0.05], 16)
    assert runs.Config.of_preset("freebase86m", ["a", "b", "c"], "out").columns == [0, 2, 1]
