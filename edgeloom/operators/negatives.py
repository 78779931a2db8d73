"""Negative samples and the filters of false negatives.  ``edges`` have edge_id, src, rel, dst and chunk (and batch_row)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.functions.hashing import draw, h
from edgeloom.functions.keyfilter import with_maybe


#: Chunks of a batch at most, so that a batch and a chunk make one integer key.
CHUNKS = 1 << 20


def chunk_edges(edges: DataFrame, batch: int, chunks: int) -> DataFrame:
    """Adds ``batch_id``, ``batch_row`` and ``chunk``; the last chunk may be short and is never padded."""
    if not 0 < chunks <= CHUNKS:
        raise ValueError(f"1 to {CHUNKS} chunks")
    per = -(-batch // chunks)
    rows = edges.withColumn("batch_id", F.floor(F.col("edge_id") / batch)).withColumn("batch_row", F.col("edge_id") % batch)
    return rows.withColumn("chunk", F.floor(F.col("batch_row") / per))


def _plan(edges: DataFrame, count: int) -> DataFrame:
    """A row for every (batch, chunk, pos)."""
    return edges.select("batch_id", "chunk").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def _key():
    return F.col("batch_id") * CHUNKS + F.col("chunk")


def uniform(edges: DataFrame, count: int, num_nodes: int, seed: int = 11) -> DataFrame:
    """``batch_id, chunk, pos, neg``: uniform nodes with replacement, shared by the edges of a chunk (and by both sides)."""
    return _plan(edges, count).withColumn("neg", draw(seed, _key(), "pos", num_nodes))


def degree_in_batch(edges: DataFrame, count: int, side: str = "dst", seed: int = 12, exclude_chunk: bool = False) -> DataFrame:
    """Endpoints of random edges of the batch, so nodes are drawn by degree; with ``sampled_row`` for the local filter.

    ``exclude_chunk`` draws only rows outside the own chunk (if the batch has others).
    """
    sizes = edges.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))
    spans = edges.groupBy("batch_id", "chunk").agg(F.min("batch_row").alias("start"), F.count(F.lit(1)).alias("length"))
    plan = _plan(edges, count).join(spans, ["batch_id", "chunk"]).join(sizes, "batch_id")
    below = lambda n: draw(seed + (side == "src"), _key(), "pos", n)
    if exclude_chunk:
        other = F.col("rows") - F.col("length")
        p = below(F.greatest(other, F.lit(1)))
        row = F.when(other > 0, p + F.when(p >= F.col("start"), F.col("length")).otherwise(0)).otherwise(below(F.col("rows")))
    else:
        row = below(F.col("rows"))
    plan = plan.withColumn("sampled_row", row).select("batch_id", "chunk", "pos", "sampled_row")
    rows = edges.select("batch_id", F.col("batch_row").alias("sampled_row"), F.col(side).alias("neg"))
    return plan.join(rows, ["batch_id", "sampled_row"])


def degree_global(edges: DataFrame, degrees: DataFrame, count: int, seed: int = 13) -> DataFrame:
    """Nodes by total degree over the whole graph: a draw below the sum of degrees is looked up in running sums.

    The lookup is an equi-join on coarse cells of the running sum, not a range join over all nodes.
    """
    from edgeloom.functions.ranking import by_value

    d = degrees.select("node_id", (F.col("out_degree") + F.col("in_degree")).alias("d")).filter("d > 0")
    bucket = by_value(d, "node_id")
    rows = d.withColumn("b", bucket)
    sums = rows.groupBy("b").agg(F.sum("d").alias("n"))
    starts = sums.select(F.col("b").alias("bb"), F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    own = Window.partitionBy("b").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumn("up", F.sum("d").over(own)).join(F.broadcast(starts), F.col("b") == F.col("bb"))
    cum = cum.select("node_id", (F.col("start") + F.col("up") - F.col("d")).alias("low"), (F.col("start") + F.col("up")).alias("high"))
    total, nodes = cum.agg(F.max("high"), F.count(F.lit(1))).first()
    width = max(1, (total or 1) // max(1, nodes or 1))
    cells = cum.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    draws = _plan(edges, count).withColumn("u", draw(seed, _key(), "pos", total or 1)).withColumn("cell", F.floor(F.col("u") / width))
    return draws.join(cells, "cell").filter("u >= low AND u < high").select("batch_id", "chunk", "pos", F.col("node_id").alias("neg"))


def mixed(edges: DataFrame, count: int, degree_fraction: float, num_nodes: int, side: str = "dst", seed: int = 0) -> DataFrame:
    """``int(count x fraction)`` degree samples first, then uniform ones.  A chunk of a batch has its own draws."""
    k = int(count * degree_fraction)
    parts = []
    if k:
        parts.append(degree_in_batch(edges, k, side, seed=12 + seed).select("batch_id", "chunk", "pos", "neg"))
    if count > k:
        parts.append(uniform(edges, count - k, num_nodes, seed=11 + seed).withColumn("pos", F.col("pos") + k))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pooled(edges: DataFrame, count: int, num_nodes: int, reuse: int, seed: int = 11) -> DataFrame:
    """Uniform negatives as ``uniform``, drawn once for ``reuse`` batches that follow each other: fewer different nodes to look up, the
    same distribution for each batch.  ``batch_id, chunk, pos, neg``."""
    plan = _plan(edges, count)
    return plan.withColumn("neg", draw(seed, F.floor(F.col("batch_id") / reuse) * CHUNKS + F.col("chunk"), "pos", num_nodes))


def corrupt(edges: DataFrame, negatives: DataFrame) -> DataFrame:
    """Every edge with the negatives of its chunk: an equi-join on the chunk, not a product."""
    return edges.join(negatives, ["batch_id", "chunk"])


#: Bytes of the negatives of all chunks up to which they are broadcast to the edges.
GATHER_BYTES = 64 << 20


def gathered(edges: DataFrame, negatives: DataFrame) -> DataFrame:
    """Every edge once, with ``neg``: the negatives of its chunk along ``pos`` as an array (null ones left out).

    The arrays of all chunks are broadcast if they take at most ``GATHER_BYTES`` (counted): then no edge is shuffled."""
    each = F.array_sort(F.collect_list(F.struct("pos", F.col("neg").cast("bigint").alias("neg"))))
    together = negatives.filter("neg IS NOT NULL").groupBy("batch_id", "chunk").agg(each.alias("n")).select("batch_id", "chunk", F.col("n.neg").alias("neg"))
    chunks, ids = together.agg(F.count(F.lit(1)), F.sum(F.size("neg"))).first()
    small = 40 * chunks + 8 * (ids or 0) <= GATHER_BYTES
    rows = edges.join(F.broadcast(together) if small else together, ["batch_id", "chunk"], "left")
    return rows.withColumn("neg", F.coalesce("neg", F.array().cast("array<bigint>")))


def corrupt_relations(edges: DataFrame, count: int, num_relations: int, seed: int = 14) -> DataFrame:
    return edges.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("neg_rel", draw(seed, "edge_id", "pos", num_relations))


def filter_degree_local(pairs: DataFrame) -> DataFrame:
    """Drop the pair of an edge and the sample that was drawn from that very edge (degree samples, ``sampled_row``)."""
    return pairs.filter(F.col("sampled_row") != F.col("batch_row"))


def _facts(known: DataFrame, side: str, same_batch: bool, qualifiers: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    fixed = "src" if side == "dst" else "dst"
    keys = [fixed, "rel", "neg", *qualifiers, *["batch_id"] * same_batch]
    return known.withColumnRenamed(side, "neg").select(*keys).distinct(), keys


def filter_known(pairs: DataFrame, known: DataFrame, side: str = "dst", same_batch: bool = False, qualifiers: tuple[str, ...] = ()) -> DataFrame:
    """Drop candidates that form an edge of ``known`` (all splits; with ``same_batch`` an edge of the own batch).

    Edges of arity 4 or 5 name their further columns in ``qualifiers`` (qval, or qrel and qval): a candidate is known only if
    those agree too.  An edge all of whose candidates are known has no row left; use ``mask_known`` before ranks and losses."""
    facts, keys = _facts(known, side, same_batch, qualifiers)
    return pairs.join(facts, keys, "left_anti")


def unknown_counts(scored: DataFrame, known: DataFrame, side: str = "dst", key: str = "edge_id") -> DataFrame:
    """``key, better``: of each edge the candidates that score at least as its positive and form no edge of ``known``; and ``bad``, its scores
    that are not finite.

    Candidates are counted where they are scored; only those that a filter of the known edges cannot rule out are shuffled
    for the exact comparison."""
    facts, keys = _facts(known, side, False, ())
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    rows = with_maybe(scored, [F.col(c) for c in keys], known.withColumnRenamed(side, "neg").select(*keys))
    reaches = F.col("score") >= F.col("pos_score")
    own = rows.groupBy(key).agg(
        F.count_if(reaches & ~F.col("maybe")).alias("sure"),
        F.collect_list(F.when(reaches & F.col("maybe"), F.struct(*keys))).alias("open"),
        F.count_if(odd("score") | odd("pos_score")).alias("bad"),
    )
    rows = own.select(key, "sure", "bad", F.explode_outer("open").alias("o"))
    # most edges have no open candidate: a number of their own keeps their rows apart in the join
    spread = F.coalesce(F.col(f"o.{keys[0]}").cast("bigint"), -1 - F.pmod(F.xxhash64(key), F.lit(1 << 31)))
    rows = rows.select(key, "sure", "bad", spread.alias(keys[0]), *[F.col(f"o.{c}").alias(c) for c in keys[1:]])
    rows = rows.join(facts.withColumn("__known", F.lit(True)), keys, "left")
    more = F.count_if(F.col("neg").isNotNull() & F.col("__known").isNull())
    return rows.groupBy(key).agg((F.max("sure") + more).alias("better"), F.max("bad").alias("bad"))


def mask_known(scored: DataFrame, known: DataFrame, side: str = "dst", same_batch: bool = False, qualifiers: tuple[str, ...] = ()) -> DataFrame:
    """``scored`` with a null score where ``filter_known`` drops the row: such a candidate never counts, and its edge remains."""
    facts, keys = _facts(known, side, same_batch, qualifiers)
    rows = scored.join(facts.withColumn("__known", F.lit(True)), keys, "left")
    return rows.withColumn("score", F.when(F.col("__known").isNull(), F.col("score"))).drop("__known")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Edges seen from their other end: source corruption of an edge is destination corruption of the reversed one."""
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def batch_sample(edges: DataFrame, count: int, seed: int = 15) -> DataFrame:
    """``batch_id, pos, edge_id, node``: ``count`` random endpoints of a batch with the edges they were taken from."""
    sizes = edges.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))
    plan = sizes.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    plan = plan.withColumn("batch_row", draw(seed, "batch_id", "pos", F.col("rows"))).drop("rows")
    end = F.when(h(seed + 1, "batch_id", "pos") % 2 == 0, F.col("src")).otherwise(F.col("dst"))
    return plan.join(edges.select("batch_id", "batch_row", "edge_id", "src", "dst"), ["batch_id", "batch_row"]).select("batch_id", "pos", "edge_id", end.alias("node"))
