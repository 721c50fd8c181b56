"""Connected components of an undirected link table, by alternating neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored, unstore

#: Ids hardly compress, and this codec needs no memory outside the heap.
_CODEC = "lz4_raw"


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node of its component.

    Each round every node takes the least label among its neighbours, then the label of its label. Tables are written
    between rounds; the driver only learns whether a label changed. Rounds grow with the logarithm of the longest path
    in practice, and hot nodes are plain rows of joins and partial aggregates."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links", _CODEC)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels", _CODEC)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_n")).agg(F.min("label").alias("_least"))
        lowered = labels.join(near, F.col("node") == F.col("_n")).select("node", F.least("label", "_least").alias("_l"), F.col("label").alias("_was"))
        # A node's label is a node of its component, so its own (old) label may be lower still.
        jump = labels.select(F.col("node").alias("_j"), F.col("label").alias("_up"))
        after = stored(lowered.join(jump, F.col("_l") == F.col("_j")).select("node", F.least("_l", "_up").alias("label"), "_was"), "labels", _CODEC)
        unstore(labels)
        changed = not after.filter("label <> _was").isEmpty()
        labels = after
        if not changed:
            unstore(both)
            return after.select("node", "label")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The components of labels, a table of ``components``, after more links (a, b): only their labels are linked."""
    of = lambda c: labels.select(F.col("node").alias(f"_{c}"), F.col("label").alias(f"l_{c}"))
    named = more.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    moved = components(named.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))).select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    known = labels.join(moved, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    fresh = moved.join(labels, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_l").alias("label"))
    return stored(known.unionByName(fresh), "labels", _CODEC)
