"""Fitted forests as flat node arrays, walked for whole Arrow batches.

A stored forest is a table of nodes; its number is bounded by trees and depth, not by the data. As arrays it travels to each
executor once, and a batch walks all trees level by level. Votes are added in the order of the trees and classes are chosen by
votes, as the library's own transformer does. Nulls and NaN fail every comparison and go right.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.session import new_path, released

BLOCK = 4096  # rows walked at once: the places of a block in all trees stay in the processor's cache


@dataclasses.dataclass
class FlatForest:
    """Nodes of all trees. `child` holds left and right by turns; a leaf is its own child. `votes` are shares of classes."""

    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    votes: np.ndarray
    roots: np.ndarray
    depth: int

    @classmethod
    def of_nodes(cls, nodes) -> FlatForest:
        """From rows (tree, id, feature, limit, left, right, counts), ids from 0 in each tree; a leaf's feature is below 0."""
        nodes = sorted(nodes, key=lambda r: (r[0], r[1]))
        tree, feature = np.array([r[0] for r in nodes]), np.array([r[2] for r in nodes])
        roots = np.flatnonzero(np.diff(tree, prepend=-1))
        base = roots[np.cumsum(np.diff(tree, prepend=-1) != 0) - 1]
        here, inner = np.arange(len(nodes)), feature >= 0
        child = np.stack([np.where(inner, base + np.array([r[k] for r in nodes]), here) for k in (4, 5)], 1)
        counts = np.array([r[6] for r in nodes], np.float64)
        counts = np.pad(counts, ((0, 0), (0, max(0, 2 - counts.shape[1]))))  # trained on one class only: the other has no votes
        total = counts.sum(1, keepdims=True)
        votes = np.divide(counts, total, out=np.zeros_like(counts), where=total != 0)
        limit = np.where(inner, np.array([r[3] for r in nodes], np.float64), np.inf)
        depth, level = 0, roots[inner[roots]]
        while len(level):
            depth, level = depth + 1, child[level].ravel()
            level = level[inner[level]]
        return cls(np.maximum(feature, 0).astype(np.int64), limit, child.ravel(), votes, roots, depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' votes, per row and class."""
        out = np.empty((len(x), self.votes.shape[1]))
        for begin in range(0, len(x), BLOCK):
            part = np.ascontiguousarray(x[begin:begin + BLOCK])
            flat, row = part.ravel(), np.arange(len(part))[:, None] * part.shape[1]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                right = ~(flat.take(row + self.feature.take(at)) <= self.limit.take(at))
                at = self.child.take(2 * at + right)
            total = np.zeros((len(part), out.shape[1]))
            for tree in range(len(self.roots)):
                total += self.votes.take(at[:, tree], 0)
            out[begin:begin + BLOCK] = total
        return out

    def shares(self, raw: np.ndarray) -> np.ndarray:
        total = raw.sum(1, keepdims=True)
        return np.divide(raw, total, out=np.zeros_like(raw), where=total != 0)


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a stored forest: tree, id, feature, limit, left, right, counts. Features are numbers, so splits are limits."""
    at, split = F.col("nodeData"), F.col("nodeData.split")
    leaf = at.leftChild < 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), at.id.alias("id"), F.when(leaf, -1).otherwise(split.featureIndex).alias("feature"),
        F.when(~leaf, F.get(split.leftCategoriesOrThreshold, F.lit(0))).alias("limit"), at.leftChild.alias("left"), at.rightChild.alias("right"),
        at.impurityStats.alias("counts"))


def flat(model: PipelineModel, spark: SparkSession) -> tuple[list[str], object]:
    """(feature names, broadcast flat forest) of a fitted pipeline; made once for each model and application."""
    application = spark.sparkContext.applicationId
    have = getattr(model, "_flat", None)
    if have is None or have[0] != application:
        with released(spark):
            path = new_path(spark, "forest")
            model.stages[-1].write().save(path)
            forest = FlatForest.of_nodes(node_table(spark, path).collect())
        have = application, model.stages[0].getInputCols(), spark.sparkContext.broadcast(forest)
        model._flat = have
    return have[1], have[2]


def matrix(columns) -> np.ndarray:
    """Arrow columns as rows of doubles; a null is NaN."""
    return np.stack([np.asarray(c.cast(pa.float64(), safe=False).fill_null(np.nan)) for c in columns], 1)


def class_share(names: list[str], forest, kind: int = 1) -> Column:
    """Share of the votes for one class; `forest` is a broadcast flat forest over the columns `names`."""
    def run(*columns: pa.Array) -> pa.Array:
        own = forest.value
        return pa.array(own.shares(own.raw(matrix(columns)))[:, kind])

    return F.arrow_udf(run, "double")(*names)


def attack_probability(model: PipelineModel, spark: SparkSession) -> Column:
    return class_share(*flat(model, spark))


def verdict(detector: PipelineModel, classifier: PipelineModel, spark: SparkSession) -> Column:
    """Struct of both stages' verdicts in one pass: is_attack, stage1_confidence, stage2_confidence and class index.
    The second forest walks the detected rows of a batch only; other rows have confidence 0 and no class."""
    names, first = flat(detector, spark)
    others, second = flat(classifier, spark)
    inputs = list(dict.fromkeys([*names, *others]))
    one, two = [inputs.index(n) for n in names], [inputs.index(n) for n in others]

    def run(*columns: pa.Array) -> pa.Array:
        x = matrix(columns)
        raw = first.value.raw(x[:, one])
        hit, p = raw[:, 1] > raw[:, 0], first.value.shares(raw)
        confidence, kind = np.zeros(len(x)), np.full(len(x), -1, np.int32)
        if hit.any():
            raw = second.value.raw(x[hit][:, two])
            kind[hit] = best = raw.argmax(1)
            confidence[hit] = second.value.shares(raw)[np.arange(len(raw)), best]
        return pa.StructArray.from_arrays(
            [pa.array(hit), pa.array(np.where(hit, p[:, 1], p[:, 0])), pa.array(confidence), pa.array(kind, mask=~hit)],
            names=["is_attack", "stage1_confidence", "stage2_confidence", "kind"])

    return F.arrow_udf(run, "is_attack boolean, stage1_confidence double, stage2_confidence double, kind int")(*inputs)
