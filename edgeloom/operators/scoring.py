"""Decoders, negative selection, losses, ranks and metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StructField, StructType
from pyspark.sql.window import Window

from edgeloom.functions import vectors as V
from edgeloom.functions.keyfilter import maybe_among, wide_filter, wide_maybe
from edgeloom.functions.work import materialise

#: Bytes of a node table up to which it is broadcast as one matrix; a larger one is joined.
MATRIX_BYTES = 64 << 20
#: Such matrices up to which scores by ids broadcast a larger table, in blocks of a quarter, and the rows that meet the blocks together.
BLOCKS, BLOCK_ROWS = 8, 1 << 16
#: Bytes of the nodes, and queries, that one task of a ranking against all nodes holds.
BLOCK_BYTES, BLOCK_QUERIES = 64 << 20, 1 << 16


def lookup(edges: DataFrame, table: DataFrame, key: str, name: str, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Adds the vector (as doubles) of a node or relation; left to the planner to broadcast or shuffle."""
    return edges.join(table.select(F.col(id_col).alias(key), V.doubles(vector).alias(name)), key)


#: decoder -> (relation operator, comparator, sign): a greater score is always better.
DECODERS = {"distmult": ("hadamard", "dot", 1), "transe": ("translation", "l2", -1), "complex": ("complex_hadamard", "dot", 1), "dot": ("noop", "dot", 1), "l2": ("noop", "l2", -1), "cosine": ("noop", "cosine", 1)}


def score(decoder: str, src: Column, rel: Column, dst: Column, qualifier: Column | None = None) -> Column:
    op, compare, sign = DECODERS[decoder]
    x = V.OPERATORS[op](src, rel)
    x = V.hadamard(x, qualifier) if qualifier is not None else x
    return V.COMPARATORS[compare](x, dst) * sign


def regular(nodes: DataFrame, relations: DataFrame, vector: str = "embedding", id_col: str = "vec_id", blocks: int = 1) -> bool:
    """True if both tables may be broadcast as matrices: at most ``blocks`` times ``MATRIX_BYTES`` each as doubles, integer ids that occur
    once, vectors of one length without nulls.  Any other table is joined."""
    lengths = set()
    for t in (nodes, relations):
        if not isinstance(t.schema[id_col].dataType, IntegralType):
            return False
        x, size = F.col(vector), F.size(vector)
        odd = x.isNull() | F.col(id_col).isNull() | F.exists(x, lambda v: v.isNull())
        n, low, high, bad, ids = t.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.count_if(odd), F.count_distinct(id_col)).first()
        if not n or bad or ids != n or n * high * 8 > MATRIX_BYTES * blocks:
            return False
        lengths |= {low, high}
    return len(lengths) == 1


def place(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``keys`` among the sorted ``ids``, and which of them are there."""
    at = np.minimum(np.searchsorted(ids, keys), max(0, len(ids) - 1))
    return at, ids[at] == keys if len(ids) else np.zeros(len(keys), dtype=bool)


def placed(ids: np.ndarray, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``place`` of a column, whose nulls are nowhere."""
    at, has = place(ids, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
    return at, has & keys.is_valid().to_numpy(zero_copy_only=False)


def blocks_of(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> list:
    """A ``regular`` table as one broadcast matrix or, above ``MATRIX_BYTES``, as blocks of about a quarter of that, cut by ranges of ids; one
    at a time passes the driver.  Floats stay floats: they take half the space, and become doubles where they are used."""
    n, dim = table.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    parts = -(-n * dim * 8 * 4 // MATRIX_BYTES) if n * dim * 8 > MATRIX_BYTES else 1
    cuts = sorted({int(c) for c in table.approxQuantile(id_col, [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    own, out = F.col(id_col), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        block = table if low is None else table.filter(own >= low)
        ids, m = matrix_of(block if high is None else block.filter(own < high), id_col, vector, floats=True)
        if len(ids):
            out.append(table.sparkSession.sparkContext.broadcast((ids, m)))
        del ids, m
        pa.default_memory_pool().release_unused()
    return out


def _looked_up(blocks: list, ends: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of the (keys, valid) of each end, and which keys have one.  Of several blocks one is held at a time."""
    out, found = [None] * len(ends), [np.zeros(len(keys), dtype=bool) for keys, _ in ends]
    for block in blocks:
        ids, m = block.value
        for i, (keys, valid) in enumerate(ends):
            if out[i] is None:
                out[i] = np.zeros((len(keys), m.shape[1]), dtype=m.dtype)
            near = np.flatnonzero(valid & (keys >= ids[0]) & (keys <= ids[-1]))
            at, has = place(ids, keys[near])
            out[i][near[has]], found[i][near[has]] = m[at[has]], True
        if len(blocks) > 1:
            del ids, m
            vars(block).pop("_value", None)  # a worker would keep every block; the file stays with its executor
    return list(zip(out, found))


def _together(batches, rows: int):
    """Batches of at least this many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def score_by_ids(rows: DataFrame, ends: dict[str, str], nodes: DataFrame, relations: DataFrame, by_matrix: Callable, by_columns: Callable) -> DataFrame:
    """``rows`` with ``score``, a function of the vectors of several ids of a row; ``ends``: id column -> "node" or "relation".

    If the tables are ``regular``, they are broadcast, large ones in blocks, and ``by_matrix`` scores a batch (one matrix for each end):
    rows are not shuffled.  Else each vector is joined and ``by_columns`` is an expression of them.  Rows without a vector are left out."""
    tables = {"node": nodes, "relation": relations}
    if not (all(isinstance(rows.schema[c].dataType, IntegralType) for c in ends) and regular(nodes, relations, blocks=BLOCKS)):
        names = [f"__v{i}" for i in range(len(ends))]
        found = rows
        for (c, kind), name in zip(ends.items(), names):
            found = lookup(found, tables[kind], c, name)
        return found.select(*rows.columns, by_columns(*map(F.col, names)).alias("score"))
    shared = {kind: blocks_of(t) for kind, t in tables.items()}
    columns, keys = rows.columns, [(rows.columns.index(c), kind) for c, kind in ends.items()]
    together = BLOCK_ROWS if any(len(b) > 1 for b in shared.values()) else 0

    def run(batches):
        for batch in _together(batches, together):
            for start in range(0, len(batch), together or 2048):
                part = batch.slice(start, together or 2048)
                found = [None] * len(keys)
                for kind, blocks in shared.items():
                    own = [i for i, (_, k) in enumerate(keys) if k == kind]
                    asked = [part.column(keys[i][0]) for i in own]
                    asked = [(c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False), c.is_valid().to_numpy(zero_copy_only=False)) for c in asked]
                    for i, x in zip(own, _looked_up(blocks, asked)):
                        found[i] = x
                has = np.logical_and.reduce([h for _, h in found])
                if has.any():
                    at = np.flatnonzero(has)
                    score = [by_matrix(*(x[at[i : i + 2048]].astype(np.float64, copy=False) for x, _ in found)) for i in range(0, len(at), 2048)]
                    yield pa.RecordBatch.from_arrays([*part.filter(pa.array(has)).columns, pa.array(np.concatenate(score))], names=[*columns, "score"])

    # no filter of nulls here: Spark would evaluate the ids' expressions once more
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def edge_scores(edges: DataFrame, nodes: DataFrame, relations: DataFrame, decoder: str = "distmult", rel: str = "rel", qualifier: str | None = None) -> DataFrame:
    """``edges`` (src, ``rel``, dst) with their score; ``qualifier`` is the column of a node whose vector scales the combination."""
    op, compare, sign = DECODERS[decoder]
    ends = {"src": "node", rel: "relation", "dst": "node"} | ({qualifier: "node"} if qualifier else {})

    def by_matrix(s, r, t, u=None):
        q = _NUMPY[op](s, r)
        return _NUMPY[compare](q if u is None else q * u, t) * sign

    return score_by_ids(edges, ends, nodes, relations, by_matrix, lambda s, r, t, u=None: score(decoder, s, r, t, u))


def _closed(core: np.ndarray, *inside: np.ndarray) -> np.ndarray:
    """The core summed over its closed modes, a row for each row of the vectors ``inside``: its open mode r is left."""
    return np.einsum("pqrst,bp,bq,bs,bt->br" if core.ndim == 5 else "pqrs,bp,bq,bs->br", core, *inside, optimize=True)


def tucker_qualified(rows: DataFrame, core: np.ndarray, entity: np.ndarray, relation: np.ndarray) -> DataFrame:
    """Adds ``score`` of whole vectors (src_e, rel_e, [qrel_e,] qval_e, dst_e): TuckER3 for a core p q r s, TuckER4 for p q r s t.

    ``entity`` (A_e) and ``relation`` (A_r) project into the core; the open mode r is projected back by A_e^T and dotted with dst."""
    four = core.ndim == 5
    names = ["src_e", "rel_e", *["qrel_e"] * four, "qval_e", "dst_e"]
    shared = rows.sparkSession.sparkContext.broadcast((core, entity, relation))

    @F.pandas_udf("double")
    def run(*cols):
        import pandas as pd

        w, e, r = shared.value
        *given, dst = [np.array(c.tolist(), dtype=np.float64) for c in cols]
        inside = [x @ m for x, m in zip(given, [e, r, r, e] if four else [e, r, e])]
        return pd.Series(((_closed(w, *inside) @ e.T) * dst).sum(axis=1))

    return rows.withColumn("score", run(*names))


def tucker_edges(edges: DataFrame, nodes: DataFrame, relations: DataFrame, core: np.ndarray, entity: np.ndarray, relation: np.ndarray) -> DataFrame:
    """``edges`` (src, rel, [qrel,] qval, dst) with the ``score`` that ``tucker_qualified`` gives their whole vectors.

    Projecting the open mode back and a dot with dst is a dot with dst's own projection, so every node and relation is projected
    into the core once, and edges meet vectors of the core's size only."""
    from edgeloom.operators.gnn import matmul

    ends = {"src": "node", "rel": "relation"} | ({"qrel": "relation"} if core.ndim == 5 else {}) | {"qval": "node", "dst": "node"}
    inside = lambda t, m: t.select("vec_id", matmul(V.doubles("embedding"), m.T).alias("embedding"))

    def by_matrix(*given):
        return _rows_dot(_closed(core, *given[:-1]), given[-1])

    @F.pandas_udf("double")
    def by_columns(*cols):
        import pandas as pd

        return pd.Series(by_matrix(*(np.array(c.tolist(), dtype=np.float64).reshape(len(c), -1) for c in cols)))

    return score_by_ids(edges, ends, inside(nodes, entity), inside(relations, relation), by_matrix, by_columns)


def score_negatives(edges: DataFrame, negatives: DataFrame, nodes: DataFrame, relations: DataFrame, decoder: str = "distmult") -> DataFrame:
    """``edge_id, src, rel, pos, neg, pos_score, score`` of every edge (edge_id, batch_id, chunk, src, rel, dst) and each negative of its
    chunk (batch_id, chunk, pos, neg).

    Edges and negatives without a vector (unknown or null ids) are left out.  A node table of at most ``MATRIX_BYTES`` is
    broadcast as a matrix and scored by numpy: then edges move without vectors.  A larger one is joined: a chunk's negatives
    are looked up and gathered once (their number is a parameter), so an edge's own vector is shuffled once and not once for
    each negative.  Both ways give the same rows.
    """
    first = nodes.select("embedding").first()
    fits = first is not None and nodes.count() * len(first[0]) * 8 <= MATRIX_BYTES and relations.count() * len(first[0]) * 8 <= MATRIX_BYTES
    return (_by_matrix if fits else _by_join)(edges, negatives, nodes, relations, decoder)


def _by_join(edges, negatives, nodes, relations, decoder) -> DataFrame:
    rows = lookup(lookup(lookup(edges, nodes, "src", "s"), relations, "rel", "r"), nodes, "dst", "t")
    rows = rows.select("edge_id", "src", "rel", "batch_id", "chunk", "s", "r", score(decoder, F.col("s"), F.col("r"), F.col("t")).alias("pos_score"))
    found = lookup(negatives, nodes, "neg", "v").select("batch_id", "chunk", F.struct("pos", "neg", "v").alias("n"))
    rows = rows.join(found.groupBy("batch_id", "chunk").agg(F.collect_list("n").alias("ns")), ["batch_id", "chunk"])
    one = lambda n: F.struct(n["pos"].alias("pos"), n["neg"].alias("neg"), score(decoder, F.col("s"), F.col("r"), n["v"]).alias("score"))
    return rows.select("edge_id", "src", "rel", "pos_score", F.explode(F.transform("ns", one)).alias("n")).select("edge_id", "src", "rel", "n.pos", "n.neg", "pos_score", "n.score")


def matrix_of(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", floats: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and the matrix of their vectors, as doubles unless the table's own ``floats`` may stay; the caller has checked the size.
    Rows without an id are left out."""
    v = F.col(vector) if floats and dict(table.dtypes)[vector] == "array<float>" else V.doubles(vector)
    t = table.filter(F.col(id_col).isNotNull()).select(id_col, v.alias("v")).toArrow().combine_chunks()
    ids, order = t[id_col].to_numpy(), np.argsort(t[id_col].to_numpy(), kind="stable")
    flat = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
    return ids[order], flat.flatten().to_numpy().reshape(len(ids), -1 if len(ids) else 0)[order]


def _by_matrix(edges, negatives, nodes, relations, decoder) -> DataFrame:
    shared = edges.sparkSession.sparkContext.broadcast((*matrix_of(nodes), *matrix_of(relations)))
    op, compare, sign = DECODERS[decoder]

    def run(batches):
        ids, m, rel_ids, rels = shared.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                (src, has_src), (rel, has_rel), (dst, has_dst) = (place(i, part.column(c).to_numpy()) for i, c in ((ids, 1), (rel_ids, 2), (ids, 3)))
                part = part.filter(pa.array(has_src & has_rel & has_dst))
                if not len(part):
                    continue
                src, rel, dst = (x[has_src & has_rel & has_dst] for x in (src, rel, dst))
                owner = np.repeat(np.arange(len(part)), np.diff(part.column(5).offsets.to_numpy()))
                neg, has_neg = place(ids, part.column(5).flatten().to_numpy())
                q = _NUMPY[op](m[src], rels[rel])
                own = _NUMPY[compare](q, m[dst]) * sign
                neg, owner = neg[has_neg], owner[has_neg]
                s = _NUMPY[compare](q[owner], m[neg]) * sign
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(part)))]).astype(np.int32))
                kept = [pa.ListArray.from_arrays(offsets, part.column(c).flatten().filter(pa.array(has_neg))) for c in (4, 5)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *kept, pa.array(own), pa.ListArray.from_arrays(offsets, pa.array(s))], names=names)

    names = ["edge_id", "src", "rel", "pos", "neg", "pos_score", "score"]
    kind = {**dict(edges.dtypes), **{c: f"array<{t}>" for c, t in negatives.dtypes if c in ("pos", "neg")}, "pos_score": "double", "score": "array<double>"}
    together = negatives.filter("neg IS NOT NULL").groupBy("batch_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "neg"))).alias("n"))
    together = together.select("batch_id", "chunk", F.col("n.pos").alias("pos"), F.col("n.neg").alias("neg"))
    whole = F.col("src").isNotNull() & F.col("rel").isNotNull() & F.col("dst").isNotNull()
    rows = edges.filter(whole).join(together, ["batch_id", "chunk"]).select("edge_id", "src", "rel", "dst", "pos", "neg")
    out = rows.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in names))
    return out.select("edge_id", "src", "rel", "pos_score", F.explode(F.arrays_zip("pos", "neg", "score")).alias("n")).select("edge_id", "src", "rel", "n.pos", "n.neg", "pos_score", "n.score")


def _halves(x: np.ndarray) -> np.ndarray:
    k = x.shape[1] // 2
    return x[:, :k] + 1j * x[:, k:]


def _complex(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    z = _halves(x) * _halves(r)
    return np.concatenate([z.real, z.imag], axis=1)


def _rows_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


_NUMPY = {
    "hadamard": np.multiply,
    "translation": np.add,
    "noop": lambda x, r: x,
    "complex_hadamard": _complex,
    "dot": _rows_dot,
    "l2": lambda x, y: np.sqrt(np.maximum(_rows_dot(x - y, x - y), 1e-8)),
    "cosine": lambda x, y: _rows_dot(x, y) / np.maximum(np.sqrt(_rows_dot(x, x) * _rows_dot(y, y)), 1e-300),
}


def top_k(scored: DataFrame, k: int, key: str = "edge_id") -> DataFrame:
    """The k best negatives of each edge (ties: first position); masked ones (null score) never count."""
    own = Window.partitionBy(key).orderBy(F.col("score").desc(), "pos")
    return scored.filter("score IS NOT NULL").withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= k).drop("__n")


def tournament(scored: DataFrame, n: int, k: int, key: str = "edge_id") -> DataFrame:
    """The best of each of k contiguous groups of the n negatives if k divides n, else the k best; ``key, grp, pos, score``."""
    if n % k:
        return top_k(scored, k, key)
    best = F.max(F.struct("score", (-F.col("pos")).alias("p")))
    return scored.filter("score IS NOT NULL").groupBy(key, F.floor(F.col("pos") / (n // k)).alias("grp")).agg(best.alias("b")).select(key, "grp", (-F.col("b.p")).alias("pos"), F.col("b.score").alias("score"))


def rank(scored: DataFrame, key: str = "edge_id") -> DataFrame:
    """``key, rank`` = 1 + negatives that score at least as the positive: ties count against it.

    Masked negatives (null score) do not count; an edge that has no other ranks first.  A score that is not finite raises."""
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    bad = F.count_if(F.coalesce(odd("score"), F.lit(False)) | F.coalesce(odd("pos_score"), F.lit(True)))
    ranks = scored.groupBy(key).agg((F.count_if(F.col("score") >= F.col("pos_score")) + 1).alias("rank"), bad.alias("__bad"))
    return ranks.withColumn("rank", F.when(F.col("__bad") > 0, F.raise_error(F.lit("score is not finite"))).otherwise(F.col("rank"))).drop("__bad")


def filtered_rank(scored: DataFrame, known: DataFrame, key: str = "edge_id") -> DataFrame:
    """``key, rank`` as ``rank`` gives for candidates masked by ``known``, without shuffling all of them."""
    from edgeloom.operators.negatives import unknown_counts

    counts = unknown_counts(scored, known, key=key)
    return counts.select(key, F.when(F.col("bad") > 0, F.raise_error(F.lit("score is not finite"))).otherwise(F.col("better") + 1).alias("rank"))


HITS = (1, 3, 5, 10, 50, 100)


def metrics(ranks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """MRR, mean rank and Hits@k."""
    hits = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hits_{k}") for k in HITS]
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.round(F.avg("rank"), 6).alias("mean_rank"), *hits)


def all_node_ranks(edges: DataFrame, nodes: DataFrame, relations: DataFrame, decoder: str = "distmult") -> DataFrame:
    """``edge_id, rank_raw`` of dst against all other nodes under any decoder, without materialising scores (ties count against it).

    Nodes are dealt into blocks of ``BLOCK_BYTES``, queries into blocks of at most ``BLOCK_QUERIES``; a task scores one with the
    other and returns counts, which are added.  Nothing passes the driver but two counts; edges without a vector are left out.
    """
    head = nodes.first()
    dim = len(head["embedding"]) if head else 1
    spread = edges.sparkSession.sparkContext.defaultParallelism
    own_blocks = max(1, -(-nodes.count() * dim * 8 // BLOCK_BYTES))
    queries = edges.count()
    query_blocks = max(1, -(-queries // BLOCK_QUERIES), min(spread // own_blocks, queries // 1024))
    ready = lookup(lookup(lookup(edges.select("edge_id", "src", "rel", "dst"), nodes, "src", "src_e"), relations, "rel", "rel_e"), nodes, "dst", "dst_e")
    op, compare, sign = DECODERS[decoder]
    q = V.OPERATORS[op](F.col("src_e"), F.col("rel_e"))
    ready = ready.select("edge_id", q.alias("q"), (V.COMPARATORS[compare](q, F.col("dst_e")) * sign).alias("own"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ready = ready.withColumn("qb", F.pmod(F.xxhash64("edge_id"), F.lit(query_blocks)).cast("int")).withColumn("nb", every(own_blocks))
    held = nodes.select("vec_id", V.doubles("embedding").alias("e")).withColumn("nb", F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)).cast("int")).withColumn("qb", every(query_blocks))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"edge_id": left["edge_id"], "n": pa.array(np.zeros(left.num_rows, dtype=np.int64))})
        flat = lambda c: pa.concat_arrays(c.chunks).flatten().to_numpy()
        q, m = flat(left["q"]).reshape(left.num_rows, -1), flat(right["e"]).reshape(right.num_rows, -1)
        own, counts = left["own"].to_numpy(), np.zeros(left.num_rows, dtype=np.int64)
        least = own - 1e-9 * np.maximum(1, np.abs(own))  # equal vectors must tie although sums are ordered differently
        for at in range(0, left.num_rows, 1024):
            counts[at : at + 1024] = (_against_all(compare, q[at : at + 1024], m) * sign >= least[at : at + 1024, None]).sum(axis=1)
        return pa.table({"edge_id": left["edge_id"], "n": pa.array(counts)})

    kind = dict(edges.dtypes)["edge_id"]
    counts = ready.groupBy("nb", "qb").cogroup(held.groupBy("nb", "qb")).applyInArrow(count, f"edge_id {kind}, n bigint")
    return counts.groupBy("edge_id").agg(F.sum("n").alias("rank_raw"))  # dst itself is one of the nodes that reach its score


def _against_all(compare: str, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    if compare == "dot":
        return q @ m.T
    if compare == "cosine":
        return (q @ m.T) / np.maximum(np.sqrt(_rows_dot(q, q))[:, None] * np.sqrt(_rows_dot(m, m))[None, :], 1e-300)
    return np.sqrt(np.maximum(_rows_dot(q, q)[:, None] + _rows_dot(m, m)[None, :] - 2 * (q @ m.T), 1e-8))


#: The logarithms of a loss after a sigmoid are bounded, as is usual, so that a saturated score costs this much.
LOG_BOUND = 100.0


def losses(scored: DataFrame, margin: float = 0.1) -> DataFrame:
    """Per edge: ``softmax_ce, ranking`` and the sums over positive and negatives of ``bce_logits, bce_sigmoid, mse, softplus``; ``n``
    scores took part.

    ``scored``: edge_id, pos_score, score (one row a negative); masked negatives (null score) add nothing.  No exponential is
    taken of a large number, so saturated scores lose no term.
    """
    p, s = F.col("pos_score"), F.col("score")
    log1pexp = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    bounded = lambda x: F.least(log1pexp(x), F.lit(LOG_BOUND))
    sums = {"ranking": F.greatest(F.lit(0.0), s - p + margin), "neg_bce": log1pexp(s), "neg_mse": s * s, "neg_sig": bounded(s)}
    zero = lambda c: F.coalesce(F.sum(F.when(s.isNotNull(), c)), F.lit(0.0))
    top = scored.groupBy("edge_id", "pos_score").agg(F.max("score").alias("m"), F.count("score").alias("k"), F.collect_list("score").alias("all"), *[zero(f).alias(n) for n, f in sums.items()])
    big = F.greatest("m", "pos_score")
    lse = big + F.log(F.exp(p - big) + F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - big)))
    return top.select("edge_id", (lse - p).alias("softmax_ce"), "ranking", (F.col("neg_bce") + log1pexp(-p)).alias("bce_logits"), (F.col("neg_sig") + bounded(-p)).alias("bce_sigmoid"), (F.col("neg_mse") + (p - 1) * (p - 1)).alias("mse"), (F.col("neg_bce") + log1pexp(-p)).alias("softplus"), (F.col("k") + 1).alias("n"))


def cross_entropy(predictions: DataFrame) -> DataFrame:
    """``predictions`` (logits, label) with ``loss``: log-sum-exp of the logits minus that of the label; null if the label is no position."""
    top = F.array_max("logits")
    lse = top + F.log(F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return predictions.withColumn("loss", lse - F.get("logits", F.col("label").cast("int")))


#: Losses that take every score as a term of its own; the others have one term an edge.
BY_SCORE = ("bce_logits", "bce_sigmoid", "mse", "softplus", "ranking")


def reduced(rows: DataFrame, name: str, reduction: str = "sum") -> DataFrame:
    """``loss`` over all edges of ``losses`` by ``sum`` or ``mean``: the mean is over edges for softmax, over negatives for ranking and
    over scores for the others."""
    if reduction not in ("sum", "mean"):
        raise ValueError(f"unknown reduction {reduction}")
    terms = F.lit(1) if name not in BY_SCORE else F.col("n") - (1 if name == "ranking" else 0)
    total = F.sum(name)
    return rows.agg((total if reduction == "sum" else total / F.sum(terms)).alias("loss"))


def gan_rewards(scored: DataFrame) -> DataFrame:
    """Reward 2 (sigmoid(s) - 0.5), softmax within the edge, and the generator's loss -mean(log_softmax x reward x softmax).
    Masked negatives (null score) are left out."""
    own = Window.partitionBy("edge_id")
    rows = scored.filter("score IS NOT NULL").withColumn("m", F.max("score").over(own)).withColumn("z", F.sum(F.exp(F.col("score") - F.col("m"))).over(own))
    rows = rows.withColumn("log_p", F.col("score") - F.col("m") - F.log("z")).withColumn("reward", 2 * (1 / (1 + F.exp(-F.col("score"))) - 0.5))
    return rows.groupBy("edge_id").agg((-F.avg(F.col("log_p") * F.col("reward") * F.exp("log_p"))).alias("loss"), F.avg("reward").alias("reward"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """100 x share of rows whose largest logit (first one of equals) is at the label."""
    best = F.array_position("logits", F.array_max("logits")) - 1
    return predictions.agg(F.round(100 * F.avg((best == F.col("label")).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def both_sides(edges: DataFrame, negatives: DataFrame, nodes: DataFrame, relations: DataFrame, inverse: DataFrame, decoder: str = "distmult", known: DataFrame | None = None) -> DataFrame:
    """Scores of dst and src corruption: those of ``score_negatives`` with ``side``.

    The same negatives serve both sides; a source is corrupted by scoring the reversed edge under its inverse relation.
    Candidates that form an edge of ``known`` on their side are masked.
    """
    from edgeloom.operators.negatives import mask_known, reversed_edges

    own = edges.select("edge_id", "batch_id", "chunk", "src", "rel", "dst")
    dst = score_negatives(own, negatives, nodes, relations, decoder).withColumn("side", F.lit("dst"))
    src = score_negatives(reversed_edges(own).select(*own.columns), negatives, nodes, inverse, decoder).withColumn("side", F.lit("src"))
    if known is not None:
        dst, src = mask_known(dst, known), mask_known(src, reversed_edges(known))
    return dst.unionByName(src)


def pooled_metrics(scored: DataFrame) -> DataFrame:
    """Metrics of the ranks of both sides in one list."""
    return metrics(rank(scored.withColumn("edge_id", F.struct("edge_id", "side"))))


def both_side_ranks(edges: DataFrame, negatives: DataFrame, nodes: DataFrame, relations: DataFrame, inverse: DataFrame, known: DataFrame, decoder: str = "distmult") -> DataFrame:
    """``edge_id, side, rank``: what ``rank`` gives of ``both_sides``.  Edge ids occur once.

    With ``regular`` tables an edge is scored once for both sides, where it is, and only counts leave the task.  A filter of the known edges
    tells most candidates that reach the positive to be unknown; the few others are compared with the known edges exactly."""
    from edgeloom.operators.negatives import gathered

    if not (all(regular(nodes, r) for r in (relations, inverse)) and all(isinstance(t.schema[c].dataType, IntegralType) for t in (edges, known) for c in ("src", "rel", "dst"))):
        scored = both_sides(edges, negatives, nodes, relations, inverse, decoder, known)
        return rank(scored.withColumn("edge_id", F.struct("edge_id", "side"))).select("edge_id.edge_id", "edge_id.side", "rank")
    triple = ["src", "rel", "dst"]
    facts = known.select(*[F.col(c).cast("bigint").alias(c) for c in triple]).na.drop()
    shared = edges.sparkSession.sparkContext.broadcast((*matrix_of(nodes), matrix_of(relations), matrix_of(inverse), wide_filter(facts)))
    op, compare, sign = DECODERS[decoder]
    places = lambda n, owner: pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32))

    def run(batches):
        ids, m, forward, backward, facts = shared.value
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                n = len(part)
                (src, has_src), (dst, has_dst) = placed(ids, part.column(1)), placed(ids, part.column(3))
                names = [part.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (1, 2, 3)]
                owner = np.repeat(np.arange(n), np.diff(part.column(4).offsets.to_numpy()))
                neg, there = placed(ids, part.column(4).flatten())
                neg, owner = neg[there], owner[there]
                vectors, candidates = m[neg], ids[neg]
                out = [part.column(c) for c in range(4)]
                for (own, other), (rel_ids, rels), changed in (((src, dst), forward, 2), ((dst, src), backward, 0)):
                    rel, has_rel = placed(rel_ids, part.column(2))
                    q = _NUMPY[op](m[own], rels[rel])
                    pos, score = _NUMPY[compare](q, m[other]) * sign, _NUMPY[compare](q[owner], vectors) * sign
                    counted = has_src & has_rel & has_dst & (np.bincount(owner, minlength=n) > 0)
                    bad = ~np.isfinite(pos) | (np.bincount(owner, weights=~np.isfinite(score), minlength=n) > 0)
                    at = np.flatnonzero(counted[owner] & (score >= pos[owner]))
                    asked = [candidates[at] if c == changed else x[owner[at]] for c, x in enumerate(names)]
                    maybe = wide_maybe(facts, asked)
                    sure = np.bincount(owner[at[~maybe]], minlength=n)
                    open_ = pa.ListArray.from_arrays(places(n, owner[at[maybe]]), pa.array(candidates[at[maybe]]))
                    out += [pa.array(sure, pa.int32(), mask=~counted), open_, pa.array(bad)]
                yield pa.RecordBatch.from_arrays(out, names=names_out)

    names_out = ["edge_id", *triple, *[f"{side}_{c}" for side in ("dst", "src") for c in ("sure", "open", "bad")]]
    kinds = dict(edges.dtypes)
    kind = ", ".join([*[f"{c} {kinds[c]}" for c in ("edge_id", *triple)], *[f"{side}_sure int, {side}_open array<bigint>, {side}_bad boolean" for side in ("dst", "src")]])
    rows = gathered(edges.select("edge_id", *triple, "batch_id", "chunk"), negatives).select("edge_id", *triple, "neg").mapInArrow(run, kind)
    some = (F.size("dst_open") > 0) | (F.size("src_open") > 0)
    rows = materialise(rows.select("edge_id", *[F.when(some, F.col(c).cast("bigint")).alias(c) for c in triple], *names_out[4:]))
    side = lambda s: F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in ("sure", "open", "bad")])
    sides = rows.select("edge_id", *triple, F.explode(F.array(side("dst"), side("src"))).alias("s")).select("edge_id", *triple, "s.*").filter("sure IS NOT NULL")
    sure = F.when(F.col("bad"), F.raise_error(F.lit("score is not finite"))).otherwise(F.col("sure"))
    settled = sides.filter(F.size("open") == 0).select("edge_id", "side", (sure.cast("bigint") + 1).alias("rank"))
    asked = sides.filter(F.size("open") > 0).select("edge_id", "side", sure.cast("bigint").alias("sure"), *triple, F.explode("open").alias("neg"))
    at = lambda c, s: F.when(F.col("side") == s, F.col("neg")).otherwise(F.col(c)).alias(c)
    asked = asked.select("edge_id", "side", "sure", at("src", "src"), "rel", at("dst", "dst"))
    known_here = maybe_among(facts, [F.col(c) for c in triple], asked.select(*triple)).distinct().withColumn("__known", F.lit(True))
    open_ = asked.join(known_here, triple, "left").groupBy("edge_id", "side").agg((F.max("sure") + F.count_if(F.col("__known").isNull()) + 1).alias("rank"))
    return settled.unionByName(open_)


def relation_scores(edges: DataFrame, nodes: DataFrame, relations: DataFrame, decoder: str = "distmult") -> DataFrame:
    """``edge_id, pos, neg_rel, score`` of edges whose relation was replaced (edge_id, src, dst, pos, neg_rel)."""
    return edge_scores(edges.select("edge_id", "src", "dst", "pos", "neg_rel"), nodes, relations, decoder, rel="neg_rel").select("edge_id", "pos", "neg_rel", "score")


def norms(table: DataFrame, vector: str = "embedding", coefficient: float = 1.0, p: int = 2) -> DataFrame:
    """``n, penalty, mean_norm``: coefficient / 2 x the sum of the vectors' p-norms, and their mean."""
    x = V.doubles(vector)
    norm = F.sqrt(V.dot(x, x)) if p == 2 else F.pow(V.total(F.transform(x, lambda v: F.pow(F.abs(v), F.lit(float(p))))), F.lit(1.0 / p))
    return table.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(norm) * (coefficient / 2), 6).alias("penalty"), F.round(F.avg(norm), 6).alias("mean_norm"))


def selection_scores(edges: DataFrame, negatives: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_id, pos, neg, score`` = minus the squared distance of src and candidate: orders candidates as L2 does, without a root.

    A chunk's candidates are gathered once (their number is a parameter), so an edge's vector is shuffled once.
    """
    found = lookup(negatives, nodes, "neg", "v").groupBy("batch_id", "chunk").agg(F.collect_list(F.struct("pos", "neg", "v")).alias("ns"))
    rows = lookup(edges.select("edge_id", "batch_id", "chunk", "src"), nodes, "src", "s").join(found, ["batch_id", "chunk"])
    one = lambda n: F.struct(n["pos"].alias("pos"), n["neg"].alias("neg"), (-V.squared_l2(F.col("s"), n["v"])).alias("score"))
    return rows.select("edge_id", F.explode(F.transform("ns", one)).alias("n")).select("edge_id", "n.*")
