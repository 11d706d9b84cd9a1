"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written

#: Edges that a partition holds at least.
FEW = 50_000


def packed(edges: DataFrame) -> DataFrame:
    """The edges, written; where they are few, in few partitions."""
    edges = written(edges)
    return edges.coalesce(max(1, edges.count() // FEW))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node that it reaches.

    Large-star and small-star rounds: each links neighbours to the smallest one around, so that the number of
    edges never grows and stars of any width are done in one round. A round is written to the shared folder. The
    rounds end when every edge leads to a root: no node with a smaller neighbour is anyone's smallest.
    """
    now = packed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        parents = now.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        rooted = parents.where("n > 1").isEmpty() and now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        if rooted:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = packed(small.distinct())


#: Edges that a task contracts at once.
AT_ONCE = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but roots with the smallest node that it reaches by the edges (a, b): roots are hooked to smaller ones, then chains halved."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        low, now = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(now, label[i], low)
        np.minimum.at(now, label[j], low)
        while (now != now[now]).any():
            now = now[now]
        if (now == label).all():
            break
        label = now
    under = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[under], nodes[label[under]]


def contracted(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Fewer edges with the same components: those of one range of their smaller nodes that lie in one task become stars.

    Worth its shuffle where nodes that lie near each other by number are linked, as numbers given out group by group
    are: a component within a task is done. A task holds ``at_once`` edges; what it has too many goes in several stars.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def done() -> pa.RecordBatch:
            ends = [np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for batch in held]) for c in ("a", "b")]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*ends)], ["a", "b"])

        for batch in batches:
            if held and n + batch.num_rows > at_once:
                yield done()
                held, n = [], 0
            held, n = [*held, batch], n + batch.num_rows
        if held:
            yield done()

    apart = edges.where("a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b"))
    return apart.repartitionByRange("b").mapInArrow(local, "a bigint, b bigint")
