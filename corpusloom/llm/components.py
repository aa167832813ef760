"""Connected components of a link table, without collecting it: alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of one batch by links to the least node that they connect."""
    for b in batches:
        a, c = (x.to_numpy() for x in b.columns)
        nodes, at = np.unique(np.r_[a, c], return_inverse=True)
        a, c = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[c])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[c], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        own = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b long) that is not the least of its component.

    Each round is two grouped minima over the remaining links and ends in a written table; the number of rounds grows
    with the logarithm of the longest path. Batches are contracted in their tasks first.
    """
    edges = links.select("a", "b").where("a <> b").mapInArrow(_forest, "a bigint, b bigint").distinct()
    edges = scratch.written(edges, "links")
    rows = edges.count()
    before = None
    while True:
        # Large star: every larger neighbour of a node is tied to the least node around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), rows).distinct()
        # Small star: a node and its smaller neighbours are tied to the least of them.
        low = few(large, rows).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        mins = low.groupBy("a").agg(F.min("b").alias("m"))
        small = few(low.join(mins, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), rows)
        edges = scratch.written(few(small.unionByName(few(mins.select("a", F.col("m").alias("b")), rows)).distinct(), rows), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
