"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import stage


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for links a-b between nodes 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` with long ends -> ``(node, root)`` for every node linked to another node.

    Nodes are ordered by XXH64 of their id (one-to-one on longs), so chains of
    ordered ids contract as fast as random ones. Each round points every node at
    its smallest neighbour and contracts the links; rounds grow with the
    logarithm of a component's size. Only aggregates with partial sums and
    equi-joins are used, so a hub's links are never gathered in one task.
    ``root`` is the same long for all nodes of a component and for no other.
    Links with a null end and self links are dropped; an empty table gives no rows.
    """
    links = stage(links.where("u <> v").select("u", "v").distinct())
    both = links.select(F.col("u").alias("id"), "v").union(links.select(F.col("v").alias("id"), F.col("u").alias("v")))
    near = both.select("id", F.xxhash64("id").alias("u"), F.xxhash64("v").alias("v"))
    parent = stage(near.groupBy("id", "u").agg(F.min("v").alias("m")).select("id", "u", F.least("u", "m").alias("p")))
    out = parent.select(F.col("id").alias("node"), F.col("p").alias("root"))
    links = links.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
    while True:
        to_u, to_v = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        links = stage(
            links.join(to_u, "u").join(to_v, "v").where("pu <> pv")
            .select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        )
        if links.isEmpty():
            return out
        both = links.union(links.select("v", "u"))
        parent = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        moved = parent.select(F.col("u").alias("root"), F.col("p").alias("to"))
        out = out.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
