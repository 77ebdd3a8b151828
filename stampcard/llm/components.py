"""Connected components of a distributed graph of 64-bit nodes, and of small arrays of edges within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampcard.session import materialize

MAX_ROUNDS = 100


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of these edges: (member, smallest member), members other than the smallest."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != (deeper := new[new])).any():
            new = deeper
        if (new == label).all():
            break
        label = new
    members = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[members], nodes[label[members]]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs): root is the smallest node reachable.

    Large-star and small-star rounds: each node's larger neighbours, then its smaller ones, are linked to its smallest. Minima are
    combined before the shuffle, links of a busy node are rows of a join that adaptive execution may split, and each round is
    a written table. Rounds grow with the logarithm of the longest path.
    """
    links = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    for _ in range(MAX_ROUNDS):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.where("a > b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        new = materialize(small.select("e.*").where("a > b").distinct(), "small-star")
        sums = [
            d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for d in (links, new)
        ]
        links = new
        if tuple(sums[0]) == tuple(sums[1]):
            break
    else:
        raise RuntimeError(f"components: no end after {MAX_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
