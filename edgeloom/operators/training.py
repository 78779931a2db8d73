"""One synchronous training step for every decoder and loss: gradients of nodes, relations and the generator, and their updates.

Tables of at most ``scoring.MATRIX_BYTES`` are broadcast as matrices: a task scores its edges by ids, takes the gradients by hand,
adds them up in a matrix of the same size, and emits one vector for each id it met; there are as many tasks as cores, so what is
shuffled does not grow with the edges.  Larger tables are joined, once for each end; then sums are by batch.  Ordinary aggregates
add these up (with partial sums before the shuffle), so neither a hub nor a relation that all edges share is one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from edgeloom.functions import vectors as V
from edgeloom.functions.work import materialise
from edgeloom.operators import optim
from edgeloom.operators.gnn import vector_sum
from edgeloom.operators.scoring import BY_SCORE, DECODERS, LOG_BOUND, _complex, _NUMPY, _rows_dot, matrix_of, placed, regular

#: Losses by name; ``softplus`` and ``bce_logits`` have the same value for these labels.
LOSSES = ("softmax_ce", "ranking", "bce_logits", "bce_sigmoid", "mse", "softplus")
NODE, RELATION, LOSS = 0, 1, 2


def _conjugate(x: np.ndarray) -> np.ndarray:
    k = x.shape[1] // 2
    return np.concatenate([x[:, :k], -x[:, k:]], axis=1)


def operator_back(op: str, s: np.ndarray, r: np.ndarray, dq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of source and relation, given that of their combination."""
    if op == "hadamard":
        return dq * r, dq * s
    if op == "translation":
        return dq, dq
    if op == "noop":
        return dq, np.zeros_like(r)
    return _complex(dq, _conjugate(r)), _complex(dq, _conjugate(s))


def comparator_back(compare: str, q: np.ndarray, t: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of q and t row by row; ``d`` is the loss's derivative by the score (a distance scores its negative)."""
    d = d[:, None]
    if compare == "dot":
        return d * t, d * q
    if compare == "l2":
        square = _rows_dot(q - t, q - t)[:, None]
        g = np.where(square > 1e-8, d * (t - q) / np.sqrt(np.maximum(square, 1e-8)), 0.0)
        return g, -g
    a, b = np.sqrt(_rows_dot(q, q))[:, None], np.sqrt(_rows_dot(t, t))[:, None]
    n = np.maximum(a * b, 1e-300)
    f = _rows_dot(q, t)[:, None] / n
    some = (a > 0) & (b > 0)
    return np.where(some, d * (t / n - f * q / np.maximum(a * a, 1e-300)), 0.0), np.where(some, d * (q / n - f * t / np.maximum(b * b, 1e-300)), 0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def loss_and_slopes(loss: str | Callable, pos: np.ndarray, neg: np.ndarray, owner: np.ndarray, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each edge and its derivatives by the positive (one an edge) and by the negatives (``owner``: their edges).

    ``loss`` may be a function of (pos, neg, owner) that returns the same three arrays."""
    if callable(loss):
        return loss(pos, neg, owner)
    n = len(pos)
    add = lambda x: np.bincount(owner, weights=x, minlength=n)
    if loss == "softmax_ce":
        top = pos.copy()
        np.maximum.at(top, owner, neg)
        e = np.exp(neg - top[owner])
        z = np.exp(pos - top) + add(e)
        return top + np.log(z) - pos, np.exp(pos - top) / z - 1, e / z[owner]
    if loss == "ranking":
        over = neg - pos[owner] + margin
        slope = (over > 0).astype(np.float64)
        return add(np.maximum(over, 0)), -add(slope), slope
    if loss == "mse":
        return add(neg * neg) + (pos - 1) ** 2, 2 * (pos - 1), 2 * neg
    if loss in ("bce_logits", "softplus", "bce_sigmoid"):
        bound = LOG_BOUND if loss == "bce_sigmoid" else np.inf
        of_pos, of_neg = np.logaddexp(0, -pos), np.logaddexp(0, neg)
        value = np.minimum(of_pos, bound) + add(np.minimum(of_neg, bound))
        return value, np.where(of_pos < bound, _sigmoid(pos) - 1, 0.0), np.where(of_neg < bound, _sigmoid(neg), 0.0)
    raise ValueError(f"unknown loss {loss}")


def generator_slopes(logits: np.ndarray, reward: np.ndarray, owner: np.ndarray, edges: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the generator's loss -log p x reward x p (p: softmax within an edge) and the derivatives of their sum by the logits."""
    top = np.full(edges, -np.inf)
    np.maximum.at(top, owner, logits)
    e = np.exp(logits - top[owner])
    z = np.bincount(owner, weights=e, minlength=edges)
    p = e / z[owner]
    log_p = logits - top[owner] - np.log(z[owner])
    inner = reward * p * (log_p + 1)
    return -log_p * reward * p, -(inner - p * np.bincount(owner, weights=inner, minlength=edges)[owner])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _told(kind: int, ids: np.ndarray, g: np.ndarray):
    """One summed vector for each id."""
    every, place = np.unique(ids, return_inverse=True)
    sums = np.zeros((len(every), g.shape[1]))
    np.add.at(sums, place, g)
    offsets = pa.array(np.arange(len(every) + 1, dtype=np.int32) * g.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(every), kind, dtype=np.int32)), pa.array(every.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["kind", "id", "g"])


def _gathered(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``edge_id, src, rel, dst, s, r, t, neg`` (ids) and ``v`` (vectors) of each edge; an edge's negatives are a bounded number."""
    at = lambda key, name: nodes.select(F.col("node_id").alias(key), F.col("x").alias(name))
    found = pairs.select("edge_id", "neg").join(at("neg", "v"), "neg").groupBy("edge_id").agg(F.collect_list(F.struct("neg", "v")).alias("n"))
    rows = edges.select("edge_id", "src", "rel", "dst").join(at("src", "s"), "src").join(at("dst", "t"), "dst").join(relations.select("rel", F.col("x").alias("r")), "rel")
    rows = rows.join(found, "edge_id", "left")
    none = F.array().cast(found.schema["n"].dataType)
    return rows.withColumn("n", F.coalesce("n", none)).select("edge_id", F.col("src").cast("bigint"), F.col("rel").cast("bigint"), F.col("dst").cast("bigint"), "s", "r", "t", F.col("n.neg").cast("array<bigint>").alias("neg"), F.flatten("n.v").alias("v"))


def _slopes(decoder: str, loss: str | Callable, margin: float, s: np.ndarray, r: np.ndarray, t: np.ndarray, v: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Losses of edges and the gradients of their sources, relations, destinations and negatives (``owner``: whose these are)."""
    op, compare, sign = DECODERS[decoder]
    q = _NUMPY[op](s, r)
    pos, other = _NUMPY[compare](q, t) * sign, _NUMPY[compare](q[owner], v) * sign
    value, d_pos, d_neg = loss_and_slopes(loss, pos, other, owner, margin)
    dq, dt = comparator_back(compare, q, t, d_pos)
    dq_neg, dv = comparator_back(compare, q[owner], v, d_neg)
    np.add.at(dq, owner, dq_neg)
    return value, *operator_back(op, s, r, dq), dt, dv


def gradients(edges: DataFrame, pairs: DataFrame | None, nodes: DataFrame, relations: DataFrame, decoder: str = "distmult", loss: str | Callable = "softmax_ce", margin: float = 0.1) -> DataFrame:
    """``kind, id, g``: parts of the gradients of nodes (kind 0) and relations (1), to be summed by id, and of the loss (2: its sum, the
    number of edges and of negatives).

    ``edges``: edge_id, src, rel, dst; ``pairs``: edge_id, neg (already filtered), or None if edges have an array ``neg`` themselves;
    ``nodes``: node_id, x; ``relations``: rel, x.  Edges and negatives without a vector take no part.  All gradients are of one version
    of the tables."""
    by_id = [t.select(F.col(key).alias("vec_id"), F.col("x").alias("embedding")) for t, key in ((nodes, "node_id"), (relations, "rel"))]
    if regular(*by_id) and all(isinstance(edges.schema[c].dataType, IntegralType) for c in ("src", "rel", "dst")):
        return _summed(edges, pairs, *by_id, decoder, loss, margin)
    if pairs is None:
        pairs = edges.select("edge_id", F.explode("neg").alias("neg"))
    op = DECODERS[decoder][0]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                src, rel, dst = (part.column(i).to_numpy() for i in (1, 2, 3))
                s, r, t = (_matrix(part.column(i)) for i in (4, 5, 6))
                owner = np.repeat(np.arange(len(part)), np.diff(part.column(7).offsets.to_numpy()))
                neg, v = part.column(7).flatten().to_numpy(), part.column(8).flatten().to_numpy().reshape(-1, s.shape[1])
                value, ds, dr, dt, dv = _slopes(decoder, loss, margin, s, r, t, v, owner)
                yield _told(NODE, np.concatenate([src, dst, neg]), np.concatenate([ds, dt, dv]))
                if op != "noop":
                    yield _told(RELATION, rel, dr)
                yield _told(LOSS, np.zeros(1, dtype=np.int64), np.array([[value.sum(), len(part), len(neg)]]))

    return _gathered(edges, pairs, nodes, relations).mapInArrow(run, "kind int, id bigint, g array<double>")


def _add(total: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """Adds the rows of ``g`` to the rows ``at`` of ``total``, which may repeat."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    if len(first):
        total[at[first]] += np.add.reduceat(g[order], first, axis=0)


def _summed(edges: DataFrame, pairs: DataFrame | None, nodes: DataFrame, relations: DataFrame, decoder: str, loss: str | Callable, margin: float) -> DataFrame:
    """``gradients`` by broadcast matrices: one vector a task for each id."""
    context = edges.sparkSession.sparkContext
    shared = context.broadcast((matrix_of(nodes), matrix_of(relations)))
    op = DECODERS[decoder][0]
    whole = F.col("src").isNotNull() & F.col("rel").isNotNull() & F.col("dst").isNotNull()
    rows = edges.filter(whole)
    if pairs is not None:
        found = pairs.filter("neg IS NOT NULL").groupBy("edge_id").agg(F.collect_list(F.col("neg").cast("bigint")).alias("neg"))
        rows = rows.select("edge_id", "src", "rel", "dst").join(found, "edge_id", "left").withColumn("neg", F.coalesce("neg", F.array().cast("array<bigint>")))

    def run(batches):
        (ids, m), (rel_ids, rels) = shared.value
        of_nodes, of_rels, totals = np.zeros_like(m), np.zeros_like(rels), np.zeros(3)
        met, met_rels = np.zeros(len(ids), dtype=bool), np.zeros(len(rel_ids), dtype=bool)
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                (src, has_src), (rel, has_rel), (dst, has_dst) = (placed(i, part.column(c)) for i, c in ((ids, 0), (rel_ids, 1), (ids, 2)))
                has = has_src & has_rel & has_dst
                part, src, rel, dst = part.filter(pa.array(has)), src[has], rel[has], dst[has]
                if not len(part):
                    continue
                owner = np.repeat(np.arange(len(part)), np.diff(part.column(3).offsets.to_numpy()))
                neg, there = placed(ids, part.column(3).flatten())
                neg, owner = neg[there], owner[there]
                value, ds, dr, dt, dv = _slopes(decoder, loss, margin, m[src], rels[rel], m[dst], m[neg], owner)
                every = np.concatenate([src, dst, neg])
                _add(of_nodes, every, np.concatenate([ds, dt, dv]))
                met[every] = True
                if op != "noop":
                    _add(of_rels, rel, dr)
                    met_rels[rel] = True
                totals += [value.sum(), len(part), len(neg)]
        for kind, keys, sums, seen in ((NODE, ids, of_nodes, met), (RELATION, rel_ids, of_rels, met_rels)):
            seen = np.flatnonzero(seen)
            for start in range(0, len(seen), 4096):
                yield _told(kind, keys[seen[start : start + 4096]], sums[seen[start : start + 4096]])
        yield _told(LOSS, np.zeros(1, dtype=np.int64), totals[None, :])

    # a task's sums take as much as the table, so there are no more tasks than cores
    return rows.select("src", "rel", "dst", F.col("neg").cast("array<bigint>").alias("neg")).coalesce(context.defaultParallelism).mapInArrow(run, "kind int, id bigint, g array<double>")


def generator_gradients(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, relations: DataFrame, generator: DataFrame, decoder: str = "distmult") -> DataFrame:
    """``kind, id, g`` of the generator's own node table (node_id, x): the discriminator rewards its candidates, 2 (sigmoid(score) - 0.5).

    The generator compares source and candidate without the relation; its loss is the mean over all candidates, so the caller
    divides by their number (the third element of kind 2)."""
    op, compare, sign = DECODERS[decoder]
    both = nodes.select("node_id", "x").join(generator.select("node_id", F.col("x").alias("y")), "node_id")
    half = F.expr("size(x)")
    both = both.select("node_id", F.concat("x", "y").alias("x"), half.alias("dim"))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                owner = np.repeat(np.arange(len(part)), np.diff(part.column(7).offsets.to_numpy()))
                if not len(owner):
                    continue
                src, neg = part.column(1).to_numpy(), part.column(7).flatten().to_numpy()
                s, r = _matrix(part.column(4)), _matrix(part.column(5))
                k = r.shape[1]
                v = part.column(8).flatten().to_numpy().reshape(-1, 2 * k)
                reward = 2 * (_sigmoid(_NUMPY[compare](_NUMPY[op](s[:, :k], r)[owner], v[:, :k]) * sign) - 0.5)
                mine, cand = s[:, k:], v[:, k:]
                terms, slopes = generator_slopes(_NUMPY[compare](mine[owner], cand) * sign, reward, owner, len(part))
                dq, dv = comparator_back(compare, mine[owner], cand, slopes)
                ds = np.zeros_like(mine)
                np.add.at(ds, owner, dq)
                yield _told(NODE, np.concatenate([src, neg]), np.concatenate([ds, dv]))
                yield _told(LOSS, np.zeros(1, dtype=np.int64), np.array([[terms.sum(), len(part), len(neg)]]))

    return _gathered(edges, pairs, both, relations).mapInArrow(run, "kind int, id bigint, g array<double>")


def resident_local(*parts: DataFrame) -> DataFrame:
    """Gradient lists of a resident state (sources, destinations, negatives of either side; node_id, g) as one list to be reduced."""
    out = parts[0].select("node_id", "g")
    for p in parts[1:]:
        out = out.unionByName(p.select("node_id", "g"))
    return out


def step(edges: DataFrame, pairs: DataFrame | None, nodes: DataFrame, relations: DataFrame, decoder: str = "distmult", loss: str | Callable = "softmax_ce", margin: float = 0.1,
         reduction: str = "sum", rate: float = 0.1, dense: optim.DenseRule | None = None, number: int = 1) -> tuple[DataFrame, DataFrame, float]:
    """One step over all edges: the new node table (node_id, x, state), the new relation table, and the loss.

    ``edges`` and ``pairs`` as in ``gradients``.  Nodes are updated by sparse Adagrad, relations by ``dense`` (all of them, as dense parameters are); ``number`` counts steps from
    1.  ``reduction`` as in ``scoring.reduced``.  The parts of the gradients are written to the work folder before they are summed."""
    dim = len(nodes.first()["x"])
    parts = materialise(gradients(edges, pairs, nodes, relations, decoder, loss, margin))
    total = parts.filter(F.col("kind") == LOSS).agg(*[F.sum(F.col("g")[i]) for i in range(3)]).first()
    value, n_edges, n_pairs = (x or 0.0 for x in total)
    terms = {"sum": 1.0, "mean": n_edges if loss not in BY_SCORE else n_pairs if loss == "ranking" else n_edges + n_pairs}[reduction] or 1.0
    scaled = parts.withColumn("g", V.scale(F.col("g"), F.lit(1.0 / terms)))
    of_nodes = scaled.filter(F.col("kind") == NODE).select(F.col("id").alias("node_id"), "g")
    of_relations = vector_sum(scaled.filter(F.col("kind") == RELATION), ["id"], "g", dim, "g").withColumnRenamed("id", "rel")
    rule = dense or optim.DenseRule()
    return optim.adagrad(nodes, of_nodes, dim, rate), rule.apply(relations, of_relations, "rel", number), value / terms


def generator_step(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, relations: DataFrame, generator: DataFrame, decoder: str = "distmult", rate: float = 0.1) -> tuple[DataFrame, float]:
    """The generator's new table (node_id, x, state) after one step, and its loss."""
    dim = len(generator.first()["x"])
    parts = materialise(generator_gradients(edges, pairs, nodes, relations, generator, decoder))
    value, count = (x or 0.0 for x in parts.filter(F.col("kind") == LOSS).agg(F.sum(F.col("g")[0]), F.sum(F.col("g")[2])).first())
    g = parts.filter(F.col("kind") == NODE).select(F.col("id").alias("node_id"), V.scale(F.col("g"), F.lit(1.0 / (count or 1.0))).alias("g"))
    return optim.adagrad(generator, g, dim, rate), value / (count or 1.0)
