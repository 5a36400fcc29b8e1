"""Connected components of a large link table, by contraction rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.session import materialise


def join_local_links(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of ``a[i]`` and ``b[i]`` in ``labels``, in place; a label is the smallest index of its class."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            shorter = labels[labels]
            if np.array_equal(shorter, labels):
                break
            labels[:] = shorter


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id of the undirected ``links`` (a, b): the ids of a component share one root.

    Each round every node joins the neighbour (or itself) whose hash of that round is least, and links shrink to
    links between the joined nodes; the nodes that remain are a constant fraction on average, whatever the
    shape of the graph, so rounds grow with the logarithm of the largest component.  A node of very many links
    is a grouped minimum with map-side combine, never a collected list.  Empty links give an empty table.
    """
    links = materialise(links.filter("a <> b").select("a", "b").distinct(), "links")
    roots = materialise(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "roots")
    number = 0
    while not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("v"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.min(rank("a")).alias("self"))
        step = materialise(near.select(F.col("a").alias("old"), F.least("m", "self")["v"].alias("new")), "step")
        ends = links
        for end in ("a", "b"):
            ends = ends.join(step, ends[end] == step["old"]).drop("old", end).withColumnRenamed("new", end)
        roots = materialise(
            roots.join(step, roots["root"] == step["old"], "left").select("id", F.coalesce("new", "root").alias("root")), "roots"
        )
        links = materialise(ends.filter("a <> b").select("a", "b").distinct(), "links")
        number += 1
    return roots
