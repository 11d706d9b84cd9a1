"""Layers of a directed graph: what must come before what, with the members of cycles told, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written


def _chains(edges: DataFrame) -> DataFrame:
    """(node, head, steps) of nodes in chains, by pointer doubling; nodes of a ring without a way in are in none.

    A node whose only way in comes from one whose only way out it is follows that one. A chain of n is done in log n rounds.
    """
    ins, outs = edges.groupBy("b").agg(F.min("a").alias("a"), F.count("*").alias("n")).where("n = 1 AND a <> b"), edges.groupBy("a").agg(F.count("*").alias("m")).where("m = 1")
    now = written(ins.join(outs, "a").select(F.col("b").alias("node"), F.col("a").alias("head"), F.lit(1).cast("bigint").alias("steps")))
    moving = now.count()
    for _ in range(moving.bit_length() + 1):
        onward = now.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        if now.join(onward, "head", "left_semi").isEmpty():
            break
        now = written(now.join(onward, "head", "left").select("node", F.coalesce("_head", "head").alias("head"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
    return now.join(now.select(F.col("node").alias("head")), "head", "left_anti").select("node", "head", "steps")


def _on_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of all nodes that can reach themselves; cycle is the greatest node of those that reach each other.

    Each round gives every node the greatest node that reaches it, as a colour; the nodes that can be reached back from
    a colour's own node within the colour are a cycle's; they leave, and the rest goes on.
    """
    left, found = written(edges), None
    while not left.isEmpty():
        colour = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("c", F.col("node"))
        while True:  # forward: the greatest colour of all that lead here
            offered = left.join(colour, left["a"] == colour["node"]).groupBy("b").agg(F.max("c").alias("o")).withColumnRenamed("b", "node")
            new = written(colour.join(offered, "node", "left").select("node", F.greatest("c", F.coalesce("o", F.col("c"))).alias("c"), (F.coalesce("o", F.col("c")) > F.col("c")).alias("moved")))
            colour = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        inside = left.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c"))
        inside = written(inside)
        back = written(inside.where("b = c").select(F.col("a").alias("node"), "c").distinct())
        while True:  # backward from each colour's own node
            more = inside.join(back.withColumnRenamed("node", "b"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct().join(back, ["node", "c"], "left_anti")
            more = written(more)
            if more.isEmpty():
                break
            back = written(back.union(more))
        cycle = back.select("node", F.col("c").alias("cycle"))
        found = cycle if found is None else found.union(cycle)
        out = cycle.select("node").union(colour.where("node = c").select("node")).distinct()
        left = written(left.join(out.withColumnRenamed("node", "a"), "a", "left_anti").join(out.withColumnRenamed("node", "b"), "b", "left_anti"))
    return edges.sparkSession.createDataFrame([], "node bigint, cycle bigint") if found is None else written(found)


def _peeled(edges: DataFrame, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(node, layer) of every node that a walk from the starts reaches in whole, and the edges left over. Edges are a, b, w."""
    left, done, due = written(edges), None, None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        blocked = left.select(F.col("b").alias("a")).distinct()
        ready = left.join(blocked, "a", "left_anti")
        known = ready.select("a").distinct() if due is None else ready.select("a").distinct().join(due.withColumnRenamed("node", "a"), "a", "left")
        front = written(known.select(F.col("a").alias("node"), (F.lit(0) if due is None else F.coalesce("layer", F.lit(0))).cast("bigint").alias("layer")))
        if front.isEmpty():
            return (edges.select(F.col("a").alias("node"), F.col("w").alias("layer")).limit(0) if done is None else _settled(done, due)), left
        offered = left.join(front.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), (F.col("layer") + F.col("w")).alias("layer"))
        due = written((offered if due is None else offered.union(due)).groupBy("node").agg(F.max("layer").alias("layer")))
        done = front if done is None else done.union(front)
        left = written(left.join(front.select(F.col("node").alias("a")), "a", "left_anti"))
    else:
        if not left.isEmpty():
            raise ValueError(f"the graph has more than {most_rounds} layers of branching nodes")
    return (edges.select(F.col("a").alias("node"), F.col("w").alias("layer")).limit(0) if done is None else _settled(done, due)), left


def _settled(done: DataFrame, due: DataFrame) -> DataFrame:
    return done.union(due).groupBy("node").agg(F.max("layer").alias("layer"))


def graph_layers(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """node, layer and state of every node of ``edges`` (a, b longs: a comes before b).

    state is ORDERED, and layer the number of edges of the longest way to the node; CYCLE, for nodes that can reach
    themselves; or BEHIND, for nodes that only a cycle leads to: layer is null for both. Chains are contracted first, so
    that their length costs log rounds; each further round peels the nodes that nothing blocks. More than ``most_rounds``
    of these stop the job.
    """
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    chain = written(_chains(edges))
    # An edge between chains, from the place of its begin in its chain.
    followers = chain.select(F.col("node").alias("b"), F.lit(True).alias("_within"))
    of = chain.select(F.col("node").alias("a"), "head", "steps")
    short = edges.join(followers, "b", "left_anti").join(of, "a", "left").select(F.coalesce("head", "a").alias("a"), "b", (F.coalesce("steps", F.lit(0)) + 1).alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    heads, left = _peeled(short, most_rounds)
    stuck = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    heads = heads.join(stuck.where("node IS NOT NULL"), "node", "left_anti")
    # Heads that no edge between chains touches begin their chain.
    lone = chain.select(F.col("head").alias("node")).distinct().join(short.select(F.col("a").alias("node")).union(short.select("b")).distinct(), "node", "left_anti").withColumn("layer", F.lit(0).cast("bigint"))
    heads = written(heads.unionByName(lone))
    ordered = written(heads.union(chain.join(heads.withColumnRenamed("node", "head"), "head").select("node", (F.col("layer") + F.col("steps")).alias("layer"))))
    rest = nodes.join(ordered, "node", "left_anti")
    among = edges.join(rest.withColumnRenamed("node", "a"), "a", "left_semi").join(rest.withColumnRenamed("node", "b"), "b", "left_semi")
    cycles = _on_cycles(among)
    stayed = rest.join(cycles, "node", "left").select("node", F.lit(None).cast("bigint").alias("layer"), F.when(F.col("cycle").isNotNull(), "CYCLE").otherwise("BEHIND").alias("state"), "cycle")
    return ordered.select("node", "layer", F.lit("ORDERED").alias("state"), F.lit(None).cast("bigint").alias("cycle")).unionByName(stayed)


def creation_order(tables: DataFrame, references: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Adds step and state to ``tables`` (name) by ``references`` (child, parent): a table is created after all that it refers to.

    A reference to itself or to a table that isn't among them doesn't count. Tables of a cycle are CYCLE: they are created
    without these keys, which are added at the end; those that refer to one, directly or not, are BEHIND and come after it.
    """
    of = lambda c: F.xxhash64(c)
    known = tables.select(of("name").alias("_id"))
    edges = references.where("child <> parent").select(of("parent").alias("a"), of("child").alias("b"))
    edges = edges.join(known.withColumnRenamed("_id", "a"), "a", "left_semi").join(known.withColumnRenamed("_id", "b"), "b", "left_semi")
    found = graph_layers(edges, most_rounds).select(F.col("node").alias("_id"), "layer", "state")
    x = tables.withColumn("_id", of("name")).join(found, "_id", "left").drop("_id")
    alone = F.col("state").isNull()
    return x.select(*tables.columns, F.when(alone, F.lit(0)).otherwise(F.col("layer")).cast("bigint").alias("step"), F.coalesce("state", F.lit("ORDERED")).alias("state"))
