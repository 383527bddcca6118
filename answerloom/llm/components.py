"""Connected components of a table of links, by rounds of hooking and shortcutting on stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.tables import stored


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a batch to one link from each node to the least node it hangs together with there."""
    for batch in batches:
        ends = np.column_stack([batch.column(k).to_numpy() for k in (0, 1)])
        nodes, number = np.unique(ends, return_inverse=True)
        a, b = number.reshape(-1, 2).T
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        other = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["a", "b"])


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of the links (a, b); label is the least node of its component.

    Links are first shortened within batches. A round gives each node the least label among its
    neighbours, hands it on to the node's old label, and follows labels once; rounds end when
    none changes, after about the logarithm of the longest path. All joins are between stored
    tables, so adaptive execution splits a node that very many links meet in. Nothing is
    collected but the number of changes. More than ``max_rounds`` rounds raise an error.
    """
    short = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").mapInArrow(_forest, "a long, b long")
    both = stored(short.union(short.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    for _ in range(max_rounds):
        heard = stored(both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low")))
        pulled = labels.join(heard, "node").select("node", F.least("label", "low").alias("low"), F.col("label").alias("old"))
        offers = pulled.select("node", "low").union(pulled.select(F.col("old").alias("node"), "low"))
        hooked = stored(offers.groupBy("node").agg(F.min("low").alias("label")))
        jumped = hooked.alias("l").join(hooked.alias("r"), F.col("l.label") == F.col("r.node")).select(F.col("l.node").alias("node"), F.col("r.label").alias("label"))
        before, labels = labels, stored(jumped)
        if not before.join(labels.withColumnRenamed("label", "now"), "node").filter("label <> now").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
