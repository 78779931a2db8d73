"""Configured runs: preprocess an edge file, train, evaluate.  ``python -m edgeloom.plans.runs preprocess|train|eval config.json``."""

from __future__ import annotations

import json
import sys
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.ranking import buckets_for, by_digest, number_rows
from edgeloom.functions.work import materialise
from edgeloom.operators import checks, ids, negatives, optim, partition, scoring, training
from edgeloom.sources import readers, sinks


STRATEGIES = ("rns", "dns", "gan")


@dataclass
class Config:
    """What a run reads and does; ``template()`` prints one with defaults."""

    dataset: str = "dataset"
    edges: str | list[str] = "edges.tsv"  # one file, or three: train, valid, test
    columns: list[int] = field(default_factory=lambda: [0, 1, 2])
    sep: str = "\t"
    header_lines: int = 0
    split: list[float] = field(default_factory=lambda: [0.9, 0.05, 0.05])
    remap_ids: bool = True  # False: ids are integers already, below num_nodes and num_relations
    num_nodes: int | None = None
    num_relations: int | None = None
    train_nodes_first: bool = False
    top_degree_first: int = 0
    partitions: int = 16
    dim: int = 64
    decoder: str = "distmult"
    loss: str = "softmax_ce"
    reduction: str = "sum"
    margin: float = 0.1
    rate: float = 0.1
    dense_optimizer: str = "adagrad"
    dense_rate: float = 0.1
    batch: int = 1000
    chunks: int = 10
    negatives: int = 10
    degree_fraction: float = 0.5
    filtered: bool = True  # training leaves out candidates that are training edges
    strategy: str = "rns"  # rns: all candidates; dns: the best by score; gan: the best by the generator's score
    selected: float = 0.5  # share of the candidates that dns and gan select
    epochs: int = 1
    seed: int = 1

    def __post_init__(self):
        if len(self.columns) not in readers.NAMES or len(self.split) not in (2, 3) or sum(self.split) > 1 + 1e-9:
            raise ValueError("columns must be two to five positions, split two or three fractions of at most 1 in total")
        for value, known in ((self.decoder, scoring.DECODERS), (self.loss, training.LOSSES), (self.strategy, STRATEGIES), (self.reduction, ("sum", "mean")), (self.dense_optimizer, ("sgd", "adagrad", "adam"))):
            if value not in known:
                raise ValueError(f"unknown choice {value}")
        if not self.remap_ids and (self.num_nodes is None or len(self.columns) > 2 and self.num_relations is None):
            raise ValueError("without new ids the numbers of nodes and relations must be given")
        if not self.remap_ids and (self.train_nodes_first or self.top_degree_first):
            raise ValueError("ids can be put in order only if they are made anew")

    @classmethod
    def of_preset(cls, name: str, edges: str | list[str], dataset: str, **more) -> "Config":
        """Settings of a public dataset whose files are at ``edges``: its columns, separator, header and split (three files bring theirs)."""
        p = readers.PRESETS[name]
        own = {"columns": p.columns, "sep": p.sep, "header_lines": p.header_lines} | ({"split": list(p.split)} if p.split else {})
        return cls(dataset=dataset, edges=edges, **(own | more))

    @classmethod
    def load(cls, path: str) -> "Config":
        with open(path) as f:
            return cls(**json.load(f))


def template() -> str:
    return json.dumps(asdict(Config()), indent=2)


def _node_ids(raw: DataFrame, c: Config) -> DataFrame:
    if c.train_nodes_first:
        return ids.sequential_train_ids(raw, ids.distinct_values(raw.filter("split = 'train'"), ["src", "dst"]))
    if c.top_degree_first:
        return ids.sequential_train_ids(raw, ids.top_degree(raw, c.top_degree_first))
    return ids.encode_nodes(raw)


def preprocess(spark: SparkSession, c: Config) -> dict:
    """Encode ids (or take them as they are), number and split the edges, write the bucketed dataset with its mappings.

    Three files keep their splits; one is split by ``split``.  Edges of two columns have relation 0; qualifiers are not kept."""
    raw = readers.read_splits(spark, c.edges, c.columns, c.sep, c.header_lines)
    raw = raw if "rel" in raw.columns else raw.withColumn("rel", F.lit("0"))
    given = not isinstance(c.edges, str) and len(c.edges) == 3
    if c.remap_ids:
        nodes, relations = materialise(_node_ids(raw, c)), materialise(ids.encode_relations(raw))
        edges = ids.apply_mapping(ids.apply_mapping(raw, nodes, ("src", "dst")), relations, ("rel",))
        count, kinds = nodes.count(), relations.count()
    else:
        count, kinds = c.num_nodes, c.num_relations or 1
        edges = raw.select(*[F.col(n).cast("bigint").alias(n) for n in ("src", "rel", "dst")], "split")
        checks.require(edges, {n: F.col(n).isNull() | checks.in_range(n, 0, kinds if n == "rel" else count) for n in ("src", "rel", "dst")})
        same = lambda n: spark.range(n).select(F.col("id").cast("string").alias("raw_id"), F.col("id").alias("mapped_id"))
        nodes, relations = same(count), same(kinds)
    edges = edges.select("src", F.col("rel").cast("int").alias("rel"), "dst", "split")
    key = F.md5(F.concat_ws(",", "src", "rel", "dst").cast("binary"))
    edges = edges.withColumn("key", key)
    edges = materialise(number_rows(edges, by_digest("key", buckets_for(edges.count())), ["key", "src", "rel", "dst", "split"], "edge_id").drop("key"))
    marked = edges if given else partition.split(edges.drop("split"), tuple(c.split), c.seed)
    names = ("train", "valid", "test") if given or len(c.split) == 3 else ("train", "test")
    sinks.write_dataset(c.dataset, {n: marked.filter(F.col("split") == n).drop("split") for n in names}, count, c.partitions, {"node": nodes, "relation": relations})
    return {"num_nodes": count, "num_relations": kinds}


def _split(spark: SparkSession, c: Config, name: str) -> DataFrame:
    return spark.read.parquet(f"{c.dataset}/edges_{name}").select("edge_id", "src", "rel", "dst")


def _splits(c: Config) -> tuple[str, ...]:
    three = len(c.split) == 3 or not isinstance(c.edges, str) and len(c.edges) == 3
    return ("train", "valid", "test") if three else ("train", "test")


def _negatives(edges: DataFrame, c: Config, n: int) -> tuple[DataFrame, DataFrame]:
    e = negatives.chunk_edges(edges, c.batch, c.chunks)
    return e, negatives.mixed(e, c.negatives, c.degree_fraction, n)


def _pairs(e: DataFrame, neg: DataFrame, c: Config, tables: dict[str, DataFrame]) -> DataFrame:
    """``edge_id, neg`` of the candidates that training uses."""
    pairs = negatives.corrupt(e, neg)
    if c.filtered:
        pairs = negatives.filter_known(pairs, e)
    if c.strategy != "rns":
        own = e.select("edge_id", "batch_id", "chunk", "src", "rel", "dst")
        vectors = lambda t, key: t.select(F.col(key).alias("vec_id"), F.col("x").alias("embedding"))
        by = c.decoder if c.strategy == "dns" else scoring.DECODERS[c.decoder][1]  # the generator compares without the relation
        table = tables["nodes" if c.strategy == "dns" else "generator"]
        scored = scoring.score_negatives(own, neg.select("batch_id", "chunk", "pos", "neg"), vectors(table, "node_id"), vectors(tables["relations"], "rel"), by)
        best = scoring.top_k(negatives.mask_known(scored, e) if c.filtered else scored, max(1, int(c.negatives * c.selected)))
        pairs = pairs.join(best.select("edge_id", "pos"), ["edge_id", "pos"], "left_semi")
    return pairs.select("edge_id", "neg")


def train(spark: SparkSession, c: Config) -> str:
    """Synchronous epochs of the configured decoder and loss: every epoch updates nodes, relations and, for ``gan``, the generator, and
    becomes a checkpoint, so a lost executor costs one epoch at most."""
    nodes = spark.read.parquet(f"{c.dataset}/node_mapping").select(F.col("mapped_id").alias("node_id"))
    relations = spark.read.parquet(f"{c.dataset}/relation_mapping").select(F.col("mapped_id").alias("rel"))
    n, rule = nodes.count(), optim.DenseRule(c.dense_optimizer, c.dense_rate)
    fresh = lambda seed: nodes.select("node_id", optim.initialise("glorot_uniform", c.dim, rows=n, seed=seed).alias("x"), F.array_repeat(F.lit(0.0), c.dim).alias("state"))
    rel = rule.start(relations.select("rel", optim.initialise("zeros" if c.decoder == "transe" else "ones", c.dim, "rel").alias("x")))
    state = {"nodes": fresh(c.seed), "relations": rel} | ({"generator": fresh(c.seed + 1000)} if c.strategy == "gan" else {})
    path = sinks.write_checkpoint(c.dataset, 0, state, {"epoch": 0})
    for epoch in range(1, c.epochs + 1):
        tables, _ = sinks.read_checkpoint(spark, path, list(state))
        # each epoch draws its own negatives
        e = negatives.chunk_edges(_split(spark, c, "train"), c.batch, c.chunks)
        neg = negatives.mixed(e, c.negatives, c.degree_fraction, n, seed=c.seed * 1009 + epoch * 101)
        pairs, own = materialise(_pairs(e, neg, c, tables)), e.select("edge_id", "src", "rel", "dst")
        new = {}
        new["nodes"], new["relations"], loss = training.step(own, pairs, tables["nodes"], tables["relations"], c.decoder, c.loss, c.margin, c.reduction, c.rate, rule, epoch)
        if c.strategy == "gan":
            new["generator"], _ = training.generator_step(own, pairs, tables["nodes"], tables["relations"], tables["generator"], c.decoder, c.rate)
        path = sinks.write_checkpoint(c.dataset, epoch, new, {"epoch": epoch, "loss": loss})
    return path


def evaluate(spark: SparkSession, c: Config, checkpoint: str) -> DataFrame:
    """MRR, mean rank and Hits@k of the test edges against sampled negatives that are no known edges; writes the ranks as CSV."""
    tables, _ = sinks.read_checkpoint(spark, checkpoint, ["nodes", "relations"])
    emb = tables["nodes"].select(F.col("node_id").alias("vec_id"), F.col("x").alias("embedding"))
    rel = tables["relations"].select(F.col("rel").alias("vec_id"), F.col("x").alias("embedding"))
    e, neg = _negatives(_split(spark, c, "test"), c, emb.count())
    scored = scoring.score_negatives(e.select("edge_id", "batch_id", "chunk", "src", "rel", "dst"), neg, emb, rel, c.decoder)
    known = reduce(DataFrame.unionByName, [_split(spark, c, name) for name in _splits(c)])
    ranks = scoring.filtered_rank(scored, known)
    sinks.write_scores(e.join(ranks, "edge_id"), f"{c.dataset}/ranks")
    return scoring.metrics(ranks)


def main(args: list[str]) -> None:
    if args[:1] == ["template"]:
        print(template())
        return
    spark, c = SparkSession.builder.getOrCreate(), Config.load(args[1])
    if args[0] == "preprocess":
        print(json.dumps(preprocess(spark, c)))
    elif args[0] == "train":
        print(train(spark, c))
    elif args[0] == "eval":
        print(json.dumps(evaluate(spark, c, args[2]).first().asDict()))
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
