"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins over the links; nothing is collected or broadcast.
Before the first round each task contracts the links it holds to a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, shuffled


def _forest(batches):
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def flush():
        kids = list(parent)
        tops = [find(k) for k in kids]
        keep = [(k, t) for k, t in zip(kids, tops) if k != t]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keep], pa.int64()), pa.array([t for _, t in keep], pa.int64())], names=["u", "v"]
        )

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                hi, lo = max(x, y), min(x, y)
                parent[hi] = lo
                parent.setdefault(lo, lo)
        if len(parent) > 1_000_000:
            yield flush()
            parent.clear()
    yield flush()


def components(links: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """links: two long columns. Returns (node, root): root is the smallest node reachable.

    Nodes without links do not appear. Self links, repeated links and an empty table are fine.
    """
    a, b = links.columns[:2]
    edges = (
        links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .mapInArrow(_forest, "u long, v long")
    )
    edges = scratch.table(edges.distinct(), f"{label}-links")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(shuffled(low2), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v"))
        )
        nxt = scratch.table(small.where("u <> v").distinct(), f"{label}-round")
        # a star forest: no node is both a leaf and a centre, and every leaf has one centre
        shape = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chain = nxt.select("u").join(shuffled(nxt.select(F.col("v").alias("u"))), "u", "left_semi").limit(1)
        done = not shape.unionByName(chain.select("u", F.lit(1).cast("long").alias("n"))).take(1)
        scratch.drop(edges)
        edges = nxt
        if done:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def local_components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n items over the index pairs x, y."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, root):
            break
        root = new
    return root
