"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import scratch


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links given and the smallest node that each reaches by them."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while True:  # pointer jumping
            far = root[root]
            if (far == root).all():
                break
            root = far


def _contract(batches):
    """Of each block of links, one link to the smallest node that each node reaches inside it."""
    for b in batches:
        if not b.num_rows:
            continue
        nodes, roots = local_roots(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
        on = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(roots[on])], names=["u", "v"])


def _passed(batches):
    """Links u - m and v - m of each row u, v, m, contracted."""
    for b in batches:
        u, v, m = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        yield from _contract([pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, v])), pa.array(np.concatenate([m, m]))], names=["u", "v"])])


def components(links: DataFrame, work: scratch.Work) -> DataFrame:
    """node, component_id (smallest node reachable) for every node of links (u, v: long); other nodes are their own.

    Links point to the smaller node. In a round each link is passed on to its target's smallest target, and then all
    targets of a node to the smallest of them, until only stars are left: a number of rounds that grows with the
    logarithm of the nodes. A node has one link a block at most, so no node gathers its followers in one task. Each
    round is a written table. Nulls and links of a node with itself are left out; repeated links count once. The result
    reads a table of work.
    """
    table = scratch.Table(links.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_contract, "u long, v long"), "links")
    while not _stars(table.read()):
        e = table.read()
        above = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("up"))
        jumped = e.join(above, "v", "left").select("u", F.coalesce("up", "v").alias("v"))
        least = jumped.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        after = scratch.Table(least.select("u", "v", "m").mapInArrow(_passed, "u long, v long"), "links")
        table.drop()
        table = after
    work.own.append(table)
    stars = table.read().distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether each node has links to one smaller node only, and that has none."""
    ends = links.select(F.col("u").alias("n"), "v").union(links.select("v", F.lit(None).cast("long")))
    of = ends.groupBy("n").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.col("v").isNull()).alias("aim"))
    return not of.agg(F.max((F.col("lo") < F.col("hi")) | (F.col("aim") & F.col("lo").isNotNull()))).first()[0]
