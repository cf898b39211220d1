"""Connected components by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b); root is the component's smallest node.

    Each round gives a node the least label of itself and its neighbours, and then that label's own label, so
    labels travel twice as far with every round. The links are written once and only read then. A node's
    neighbours are never gathered: the minimum is a grouped aggregate, and joins on a busy node are split by
    adaptive execution. Both sides of a join grow with the links, so none is sent through the driver. Links of a node to itself and repeated links count for nothing.
    """
    pairs = links.where("a <> b")
    edges = materialise(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")).distinct(), "edges")
    labels = materialise(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "label").hint("merge"), "v").groupBy("u").agg(F.min("label").alias("near"))
        nearer = labels.join(near.hint("merge"), "u").select("u", "label", F.least("label", "near").alias("via"))
        after = nearer.select(F.col("u").alias("via"), F.col("via").alias("new"))
        state = materialise(nearer.join(after.hint("merge"), "via").select("u", "label", "new"), "labels")
        labels = state.select("u", F.col("new").alias("label"))
        if state.where("label <> new").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("root"))
