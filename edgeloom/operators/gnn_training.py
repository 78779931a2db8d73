"""Backward passes of the graph layers, and training of a stack of them for node classification.

Nodes and their vectors stay tables: a layer's gradient by its input is one more aggregation over the edges, against their
direction.  Weights are small arrays on the driver; their gradients are sums of outer products that each task adds up before
anything moves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import vectors as V
from edgeloom.functions.work import materialise
from edgeloom.operators.gnn import attention, matmul, messages, vector_sum
from edgeloom.operators.optim import Dense


def _zero(dim: int) -> Column:
    return F.array(*[F.lit(0.0)] * dim)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def outer_sum(rows: DataFrame, g: str, x: str, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the outer products of two vector columns, shape (len(g), len(x)): a task sends one matrix."""
    out, width = shape

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += _vectors(batch.column(0), out).T @ _vectors(batch.column(1), width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out * width, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    sums = rows.select(g, x).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    result = np.zeros(out * width)
    result[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return result.reshape(shape)


@dataclass
class Layer:
    """Weights, bias and activation; ``forward`` gives (node_id, x) and what ``backward`` needs."""

    weights: dict[str, np.ndarray]
    bias: np.ndarray | None = None
    activation: str = "none"
    kept: dict = field(default_factory=dict)

    def linear(self, edges: DataFrame, x: DataFrame) -> DataFrame:
        """``node_id, y``, before bias and activation."""
        raise NotImplementedError

    def back(self, edges: DataFrame, x: DataFrame, g: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
        """``node_id, g`` of the input and the gradients of the weights, given ``g`` (node_id, g) of the linear output."""
        raise NotImplementedError

    def forward(self, edges: DataFrame, x: DataFrame) -> DataFrame:
        y = self.linear(edges, x)
        pre = F.col("y") if self.bias is None else V.add(F.col("y"), F.array(*[F.lit(float(b)) for b in self.bias]))
        out = {"none": pre, "relu": V.relu(pre), "sigmoid": V.sigmoid(pre)}[self.activation]
        self.kept = {"x": x, "out": materialise(y.select("node_id", out.alias("x")))}
        return self.kept["out"]

    def backward(self, edges: DataFrame, g: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
        """From the gradient (node_id, g) of the output; nodes without one have zero."""
        slope = {"none": lambda v: F.lit(1.0), "relu": lambda v: (v > 0).cast("double"), "sigmoid": lambda v: v * (1 - v)}[self.activation]
        rows = self.kept["out"].join(g, "node_id", "left").withColumn("g", F.coalesce("g", F.transform("x", lambda v: F.lit(0.0))))
        inner = materialise(rows.select("node_id", F.zip_with("g", F.transform("x", slope), lambda a, b: a * b).alias("g")))
        before, of = self.back(edges, self.kept["x"], inner)
        if self.bias is not None:
            of["bias"] = outer_sum(inner.withColumn("one", F.array(F.lit(1.0))), "g", "one", (len(self.bias), 1))[:, 0]
        return materialise(before), of


class Sage(Layer):
    """W1 x + W2 mean(in- and out-neighbours): weights ``self`` and ``nbr``."""

    @property
    def _dim(self) -> int:
        return self.weights["self"].shape[1]

    def _means(self, edges: DataFrame, x: DataFrame) -> DataFrame:
        both = messages(edges, x, True).unionByName(messages(edges, x, False))
        agg = vector_sum(both, ["node_id"], "x", self._dim, "a", mean=True)
        return x.join(agg, "node_id", "left").withColumn("a", F.coalesce("a", _zero(self._dim)))

    def linear(self, edges, x):
        return self._means(edges, x).select("node_id", V.add(matmul("x", self.weights["self"]), matmul("a", self.weights["nbr"])).alias("y"))

    def back(self, edges, x, g):
        rows = materialise(self._means(edges, x).join(g, "node_id"))
        shape = self.weights["self"].shape
        of = {"self": outer_sum(rows, "g", "x", shape), "nbr": outer_sum(rows, "g", "a", shape)}
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
        degree = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("d"))
        sent = g.join(degree, "node_id").select("node_id", V.scale(matmul("g", self.weights["nbr"].T), 1 / F.col("d")).alias("x"))
        back = messages(edges, sent, True).unionByName(messages(edges, sent, False))
        sums = vector_sum(back, ["node_id"], "x", self._dim, "s")
        own = rows.join(sums, "node_id", "left").withColumn("s", F.coalesce("s", _zero(self._dim)))
        return own.select("node_id", V.add(matmul("g", self.weights["self"].T), F.col("s")).alias("g")), of


class Gcn(Layer):
    """W times the normalised sum of the in-neighbours and the node itself: weight ``w``."""

    def _degrees(self, edges: DataFrame, x: DataFrame) -> DataFrame:
        d = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
        return x.select("node_id").join(d, "node_id", "left").select("node_id", F.sqrt(F.coalesce("d", F.lit(0)) + 1.0).alias("r"))

    def _spread(self, edges: DataFrame, x: DataFrame, incoming: bool) -> DataFrame:
        """The normalised sum of x (node_id, x) along the edges or against them: ``node_id, s``."""
        dim = self.weights["w"].shape[1]
        normed = x.join(self._degrees(edges, x), "node_id").withColumn("x", V.scale(F.col("x"), 1 / F.col("r")))
        sums = vector_sum(messages(edges, normed.select("node_id", "x"), incoming), ["node_id"], "x", dim, "s")
        rows = normed.join(sums, "node_id", "left").withColumn("s", F.coalesce("s", _zero(dim)))
        return rows.select("node_id", V.scale(V.add(F.col("s"), F.col("x")), 1 / F.col("r")).alias("s"))

    def linear(self, edges, x):
        return self._spread(edges, x, True).select("node_id", matmul("s", self.weights["w"]).alias("y"))

    def back(self, edges, x, g):
        rows = self._spread(edges, x, True).join(g, "node_id")
        of = {"w": outer_sum(rows, "g", "s", self.weights["w"].shape)}
        return self._spread(edges, g.select("node_id", matmul("g", self.weights["w"].T).alias("x")), False).withColumnRenamed("s", "g"), of


class Rgcn(Layer):
    """Mean over out-edges of W_rel x_nbr, plus W_self x: weights ``self`` and one of each relation's number (as text)."""

    def linear(self, edges, x):
        out = self.weights["self"].shape[0]
        rows = self._sums(edges, x)
        moved = rows.select("node_id", "n", self._by_relation("rel", "s", False).alias("y"))
        agg = vector_sum(moved, ["node_id"], "y", out, "a").join(moved.groupBy("node_id").agg(F.sum("n").alias("n")), "node_id")
        joined = x.join(agg, "node_id", "left").withColumn("a", F.coalesce(V.scale(F.col("a"), 1 / F.col("n")), _zero(out)))
        return joined.select("node_id", V.add(matmul("x", self.weights["self"]), F.col("a")).alias("y"))

    def _sums(self, edges: DataFrame, x: DataFrame) -> DataFrame:
        rows = messages(edges, x, False)
        return vector_sum(rows, ["node_id", "rel"], "x", self.weights["self"].shape[1], "s").join(rows.groupBy("node_id", "rel").agg(F.count(F.lit(1)).alias("n")), ["node_id", "rel"])

    def _by_relation(self, rel: str, vector: str, transposed: bool) -> Column:
        weights = {int(k): w.T if transposed else w for k, w in self.weights.items() if k != "self"}
        width, out = self.weights["self"].shape if transposed else self.weights["self"].shape[::-1]

        @F.arrow_udf("array<double>")
        def times(r: pa.Array, v: pa.Array) -> pa.Array:
            r, given = r.to_numpy(), _vectors(v, width)
            got = np.zeros((len(r), out))
            for k in np.unique(r):
                if int(k) not in weights:
                    raise ValueError(f"no weights for relation {k}")
                got[r == k] = given[r == k] @ weights[int(k)].T
            return pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * out), pa.array(got.ravel()))

        return times(rel, vector)

    def back(self, edges, x, g):
        shape = self.weights["self"].shape
        of = {"self": outer_sum(x.join(g, "node_id"), "g", "x", shape)}
        degree = edges.join(x.select(F.col("node_id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
        shared = materialise(g.join(degree, "node_id").select("node_id", V.scale(F.col("g"), 1 / F.col("d")).alias("g")))
        by = materialise(self._sums(edges, x).join(shared, "node_id"))
        for k in (k for k in self.weights if k != "self"):
            of[k] = outer_sum(by.filter(F.col("rel") == int(k)), "g", "s", shape)
        sent = messages(edges, shared.withColumnRenamed("g", "x"), True)  # from src to dst
        sums = vector_sum(sent, ["node_id", "rel"], "x", shape[0], "s").select("node_id", self._by_relation("rel", "s", True).alias("s"))
        sums = vector_sum(sums, ["node_id"], "s", shape[1], "s")
        own = g.join(sums, "node_id", "left")
        return own.select("node_id", V.add(matmul("g", self.weights["self"].T), F.coalesce("s", _zero(shape[1]))).alias("g")), of


class Gat(Layer):
    """One attention head over the in-neighbours and the node itself: weights ``w``, ``own`` and ``nbr`` (one row each)."""

    slope: float = 0.2

    def _weighed(self, edges: DataFrame, x: DataFrame) -> tuple[DataFrame, DataFrame]:
        """z = W x of the nodes, and ``node_id, nbr, x`` (z of the neighbour), ``raw, alpha`` of the edges and the nodes themselves."""
        lit = lambda a: F.array(*[F.lit(float(v)) for v in a])
        z = materialise(x.select("node_id", matmul("x", self.weights["w"]).alias("x")))
        rows = messages(edges, z).select("node_id", "nbr", "x").unionByName(z.select("node_id", F.col("node_id").alias("nbr"), "x"))
        rows = rows.join(z.select("node_id", V.dot(F.col("x"), lit(self.weights["own"][0])).alias("own")), "node_id")
        raw = F.col("own") + V.dot(F.col("x"), lit(self.weights["nbr"][0]))
        rows = rows.withColumn("raw", raw).withColumn("logit", F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.col("raw") * self.slope))
        return z, attention(rows)

    def linear(self, edges, x):
        _, rows = self._weighed(edges, x)
        return vector_sum(rows.withColumn("y", V.scale(F.col("x"), F.col("alpha"))), ["node_id"], "y", self.weights["w"].shape[0], "y")

    def back(self, edges, x, g):
        out = self.weights["w"].shape[0]
        lit = lambda a: F.array(*[F.lit(float(v)) for v in a])
        z, rows = self._weighed(edges, x)
        rows = materialise(rows.join(g, "node_id").withColumn("da", V.dot(F.col("g"), F.col("x"))))
        mean = rows.groupBy("node_id").agg(F.sum(F.col("alpha") * F.col("da")).alias("m"))
        rows = rows.join(mean, "node_id")
        rows = materialise(rows.withColumn("dr", F.col("alpha") * (F.col("da") - F.col("m")) * F.when(F.col("raw") > 0, 1.0).otherwise(self.slope)))
        of = {"nbr": outer_sum(rows.withColumn("d", F.array("dr")), "d", "x", (1, out))}
        at = rows.groupBy("node_id").agg(F.sum("dr").alias("dr"))
        of["own"] = outer_sum(z.join(at, "node_id").withColumn("d", F.array("dr")), "d", "x", (1, out))
        to_nbr = rows.select(F.col("nbr").alias("node_id"), V.add(V.scale(F.col("g"), F.col("alpha")), V.scale(lit(self.weights["nbr"][0]), F.col("dr"))).alias("x"))
        to_own = at.select("node_id", V.scale(lit(self.weights["own"][0]), F.col("dr")).alias("x"))
        dz = materialise(vector_sum(to_nbr.unionByName(to_own), ["node_id"], "x", out, "dz"))
        of["w"] = outer_sum(x.join(dz, "node_id"), "dz", "x", self.weights["w"].shape)
        moved = x.select("node_id").join(dz, "node_id", "left").withColumn("dz", F.coalesce("dz", _zero(out)))
        return moved.select("node_id", matmul("dz", self.weights["w"].T).alias("g")), of


def classification_gradient(logits: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``node_id, g`` of the mean cross-entropy over the labelled nodes (node_id, label), and that mean; a label that is null or no
    position of the logits is no label."""
    rows = logits.join(labels.select("node_id", F.col("label").cast("int").alias("label")), "node_id").filter("label >= 0 AND label < size(x)")
    top = F.array_max("x")
    rows = rows.withColumn("e", F.transform("x", lambda v: F.exp(v - top)))
    rows = rows.withColumn("z", V.total(F.col("e"))).withColumn("loss", F.log("z") + top - F.get("x", F.col("label")))
    count, loss = rows.agg(F.count(F.lit(1)), F.avg("loss")).first()
    g = F.transform("e", lambda v, i: (v / F.col("z") - (i == F.col("label")).cast("double")) / max(1, count))
    return rows.select("node_id", g.alias("g")), loss or 0.0


def gradients(edges: DataFrame, x: DataFrame, labels: DataFrame, layers: list[Layer]) -> tuple[list[dict[str, np.ndarray]], DataFrame, float]:
    """Gradients of every layer's weights, of the input vectors (node_id, g), and the loss."""
    at = x
    for layer in layers:
        at = layer.forward(edges, at)
    g, loss = classification_gradient(at, labels)
    found: list[dict[str, np.ndarray]] = []
    for layer in reversed(layers):
        g, of = layer.backward(edges, g)
        found.insert(0, of)
    return found, g, loss


def train(edges: DataFrame, x: DataFrame, labels: DataFrame, layers: list[Layer], epochs: int, kind: str = "adam", rate: float = 0.01) -> list[float]:
    """Losses of the epochs; the layers' weights and biases are updated in place.  All nodes take part in every epoch."""
    rules: dict[tuple[int, str], Dense] = {}
    losses = []
    for _ in range(epochs):
        found, _, loss = gradients(edges, x, labels, layers)
        losses.append(loss)
        for k, (layer, of) in enumerate(zip(layers, found)):
            for name, g in of.items():
                rule = rules.setdefault((k, name), Dense(kind, rate))
                if name == "bias":
                    layer.bias = rule.step(layer.bias, g)
                else:
                    layer.weights[name] = rule.step(layer.weights[name], g)
    return losses
