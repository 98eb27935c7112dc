"""Fitted Spark ML tree ensembles as plain trees, for scoring inside an expression or a task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Node(NamedTuple):
    """A leaf (feature -1) with its value, or a split: left if the feature is at most the threshold."""

    feature: int
    threshold: float
    value: float
    left: Node | None
    right: Node | None


def tree(fitted, value: Callable) -> Node:
    """The nodes of one tree model; `value` reads a leaf."""

    def walk(node) -> Node:
        if node.subtreeDepth() == 0:
            return Node(-1, 0.0, float(value(node)), None, None)
        split = node.split()
        return Node(split.featureIndex(), split.threshold(), 0.0, walk(node.leftChild()), walk(node.rightChild()))

    return walk(fitted._java_obj.rootNode())


def expression(node: Node, features: Column) -> Column:
    """The tree's value as a Column over an array of features."""
    if node.left is None:
        return F.lit(node.value)
    return F.when(features[node.feature] <= node.threshold, expression(node.left, features)).otherwise(
        expression(node.right, features)
    )


def leaf_value(node: Node, x: Sequence[float]) -> float:
    """The tree's value for one row. Few rows come at a time, so a walk costs far less than operations on arrays."""
    while node.left is not None:
        node = node.left if x[node.feature] <= node.threshold else node.right
    return node.value
