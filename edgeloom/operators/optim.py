"""Sparse and dense updates, initialisers, and one synchronous training epoch."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import vectors as V
from edgeloom.functions.hashing import M, h
from edgeloom.operators.gnn import vector_sum


def reduce_gradients(gradients: DataFrame, dim: int) -> DataFrame:
    """``node_id, g``: one summed gradient a node."""
    return vector_sum(gradients, ["node_id"], "g", dim, "g")


def scatter_add(table: DataFrame, delta: DataFrame, dim: int, vector: str = "x") -> DataFrame:
    """New version of ``table`` (node_id, x) with all rows of ``delta`` (node_id, g) added; duplicates accumulate."""
    rows = table.join(reduce_gradients(delta, dim), "node_id", "left")
    return rows.withColumn(vector, F.when(F.col("g").isNull(), F.col(vector)).otherwise(V.add(F.col(vector), F.col("g")))).drop("g")


def scatter_put(table: DataFrame, new: DataFrame, vector: str = "x") -> DataFrame:
    rows = table.join(new.select("node_id", F.col(vector).alias("__new")), "node_id", "left")
    return rows.withColumn(vector, F.coalesce("__new", vector)).drop("__new")


def adagrad(table: DataFrame, gradients: DataFrame, dim: int, rate: float, eps: float = 1e-10) -> DataFrame:
    """``node_id, x, state``: state += g^2, x -= rate g / (sqrt(state) + eps) for nodes with gradients."""
    rows = table.join(reduce_gradients(gradients, dim), "node_id", "left")
    state = F.zip_with("state", "g", lambda s, g: s + g * g)
    rows = rows.withColumn("state", F.when(F.col("g").isNull(), F.col("state")).otherwise(state))
    step = F.zip_with("g", "state", lambda g, s: g / (F.sqrt(s) + eps) * rate)
    return rows.withColumn("x", F.when(F.col("g").isNull(), F.col("x")).otherwise(F.zip_with("x", step, lambda a, b: a - b))).select("node_id", "x", "state")


class Dense:
    """SGD, Adagrad and Adam for small dense parameters on the driver."""

    def __init__(self, kind: str = "adagrad", rate: float = 0.1, betas: tuple = (0.9, 0.999), eps: float = 1e-8, amsgrad: bool = False, decay: float = 0.0):
        self.kind, self.rate, self.betas, self.eps, self.amsgrad, self.decay, self.t = kind, rate, betas, eps, amsgrad, decay, 0
        self.a = self.b = self.top = None

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        g = g + self.decay * w
        if self.a is None:
            self.a, self.b, self.top = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
        if self.kind == "sgd":
            return w - self.rate * g
        if self.kind == "adagrad":
            self.a = self.a + g * g
            return w - self.rate * g / (np.sqrt(self.a) + self.eps)
        m, v = self.betas
        self.a, self.b = m * self.a + (1 - m) * g, v * self.b + (1 - v) * g * g
        self.top = np.maximum(self.top, self.b)
        second = (self.top if self.amsgrad else self.b) / (1 - v**self.t)
        return w - self.rate * self.a / (1 - m**self.t) / (np.sqrt(second) + self.eps)


@dataclass(frozen=True)
class DenseRule:
    """SGD, Adagrad or Adam for a table of dense parameters, as expressions: every row takes part, those without a gradient with zero.

    The values are those of ``Dense``, which holds one array on the driver; a table needs no such bound."""

    kind: str = "adagrad"
    rate: float = 0.1
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    amsgrad: bool = False
    decay: float = 0.0

    def start(self, table: DataFrame) -> DataFrame:
        """``table`` (key, x) with the moments ``a, b, top``, all zero."""
        zero = F.transform("x", lambda v: F.lit(0.0))
        return table.select("*", zero.alias("a"), zero.alias("b"), zero.alias("top"))

    def apply(self, table: DataFrame, gradients: DataFrame, key: str, number: int) -> DataFrame:
        """The table (key, x, a, b, top) after step ``number`` (from 1) with summed ``gradients`` (key, g)."""
        rows = table.join(gradients.select(key, F.col("g").alias("__g")), key, "left")
        g = F.coalesce("__g", F.transform("x", lambda v: F.lit(0.0)))
        rows = rows.withColumn("__g", F.zip_with(g, "x", lambda d, v: d + self.decay * v))
        less = lambda step: F.zip_with("x", step, lambda v, d: v - d)
        if self.kind == "sgd":
            rows = rows.withColumn("x", less(F.transform("__g", lambda d: self.rate * d)))
        elif self.kind == "adagrad":
            rows = rows.withColumn("a", F.zip_with("a", "__g", lambda a, d: a + d * d))
            rows = rows.withColumn("x", less(F.zip_with("__g", "a", lambda d, a: self.rate * d / (F.sqrt(a) + self.eps))))
        elif self.kind == "adam":
            m, v = self.betas
            rows = rows.withColumn("a", F.zip_with("a", "__g", lambda a, d: m * a + (1 - m) * d)).withColumn("b", F.zip_with("b", "__g", lambda b, d: v * b + (1 - v) * d * d))
            rows = rows.withColumn("top", F.zip_with("top", "b", lambda a, b: F.greatest(a, b)))
            second = "top" if self.amsgrad else "b"
            rows = rows.withColumn("x", less(F.zip_with("a", second, lambda a, b: self.rate * a / (1 - m**number) / (F.sqrt(b / (1 - v**number)) + self.eps))))
        else:
            raise ValueError(f"unknown optimiser {self.kind}")
        return rows.select(key, "x", "a", "b", "top")


def initialise(kind: str, dim: int, node: str = "node_id", seed: int = 3, rows: int = 1, value: float = 0.0) -> Column:
    """Vector of a node by hash, so any partition can be made alone: zeros, ones, constant, uniform, normal, glorot_uniform,
    glorot_normal.  Fans are those of the full table (rows x dim)."""
    i = F.sequence(F.lit(0), F.lit(dim - 1))
    if kind in ("zeros", "ones", "constant"):
        return F.array_repeat(F.lit({"zeros": 0.0, "ones": 1.0}.get(kind, value)), dim)
    u = lambda s: lambda k: (h(s, F.col(node), k) + 0.5) / M
    if kind in ("uniform", "glorot_uniform"):
        limit = math.sqrt(6 / (rows + dim)) if kind == "glorot_uniform" else value or 1.0
        return F.transform(i, lambda k: (u(seed)(k) * 2 - 1) * limit)
    std = math.sqrt(2 / (rows + dim)) if kind == "glorot_normal" else value or 1.0
    return F.transform(i, lambda k: F.sqrt(-2 * F.log(u(seed)(k))) * F.cos(2 * math.pi * u(seed + 1)(k)) * std)
