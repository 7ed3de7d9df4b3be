"""Connected components of a link table, by rounds of large-star and small-star.

Each round hangs the neighbours of a node on its smallest neighbour. Both halves take
a minimum by node, which is summed before it is shuffled, and join it back; nodes with
a good share of all links (a hub of near copies) are joined by broadcast, of which
there are a few hundred at most. No list of neighbours is ever formed. Rounds end when
the links no longer change; their number grows as the logarithm of the largest component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stage, hot_join

#: Links that one task thins at a time.
THINNED_LINKS = 1 << 19


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one of its component, without the loops."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _thin(batches):
    """A spanning forest of the links of a task, piece by piece."""
    a, b, held = [], [], 0

    def out():
        u, v = star_forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= THINNED_LINKS:
            yield out()
            a, b, held = [], [], 0
    if held:
        yield out()


def connected_components(links: DataFrame, stage: Stage) -> DataFrame:
    """node long, component long (the smallest node reachable), for nodes with links. links: u long, v long."""
    thin = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_thin, "u long, v long")
    now = stage.write(thin.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total, state = now.count(), None
    while total:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage.write(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"), F.count("*").alias("n")))
        # roots keep their links as they are: their low is themselves
        flipped = now.select(F.col("v").alias("u"), F.col("u").alias("far"))
        large = stage.write(hot_join(flipped, low, ["u"], total).select(F.col("far").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())
        # now every link goes from the larger to the smaller node
        least = stage.write(large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")))
        small = hot_join(large, least, ["u"], total).select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("x"))
        after = stage.write(small.select("x.u", "x.v").where("u <> v").distinct())
        for old in (now, low, large, least):
            stage.drop(old)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == state:
            break
        total, state = seen[0], seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
